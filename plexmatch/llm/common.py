"""Shared pieces: tables, materialised intermediate results, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}

BATCH_BYTES = 2 << 20  # of a record batch on its way to or from Python
HOT_LEAST, HOT_KEYS = 256, 10_000
FILE_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is named and all runs on this machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="plexmatch-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def store(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: the lineage ends there.

    rows: about how many it has, at most. Few rows are then not spread over as many files as a
    shuffle has partitions, but written by a task a core, or one for every FILE_ROWS of them. The
    files go by discard(), or when the driver's process ends.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{checkpoint_dir(spark)}/plexmatch-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of the plan just written
    out = spark.read.schema(df.schema).parquet(path)
    out._plexmatch_path = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete the files of store()'s results that nothing will read again, neither now nor in a retry."""
    for df in stored:
        _delete(df._plexmatch_path, _written.pop(df._plexmatch_path))


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(path, spark)
        except Exception:  # the session may be gone already; its folder goes with it
            return


def lean(spark: SparkSession) -> None:
    """Have record batches of BATCH_BYTES at most sent to Python: a worker's memory hangs on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def trimmed(run):
    """A function over batches that gives the memory it has freed back to the system at its end."""

    def trim(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return trim


def joined_by_size(left: DataFrame, right: DataFrame, keys: list[str], n: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row a key and in column n the number of left's rows with it.

    rows: how many left has in all. Keys with over rows / HOT_KEYS rows, and HOT_LEAST, meet left by a
    broadcast (there are at most HOT_KEYS of them), so that no task has to take a key's rows alone.
    """
    least = max(HOT_LEAST, rows // HOT_KEYS)
    hot = right.filter(F.col(n) > least)
    if not hot.limit(1).count():
        return left.join(right, keys, how)
    often = left.join(F.broadcast(hot), keys)
    seldom = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.filter(F.col(n) <= least), keys, how)
    return often.unionByName(seldom)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns in use; any other column, whatever its name, stays out of the plan."""
    lean(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])


def texts(column):
    """The column's texts as bytes; null counts as empty."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def sliced(batches, name: str, limit: int = 1 << 20):
    """Cut each record batch so that the texts of a piece hold about `limit` bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < n:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column, m: int):
    """crc32(doc_id as text) mod m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % m


def place(docs: DataFrame) -> Column:
    """What names a row of docs for good: its file, and its number there.

    Unlike numbers dealt out by partition, it stays the same however the next scan is cut, on more or
    fewer cores or after a lost executor. docs has to be read from Parquet files, as store() leaves it.
    """
    at = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at"))


def from_files(docs: DataFrame) -> DataFrame:
    """docs itself if place() can name its rows, that is, if it is a scan of Parquet files, filtered or projected; else its rows, written and read."""
    try:
        place(docs)
        docs.select(place(docs)).schema  # noqa: B018
        return docs
    except AnalysisException:
        return store(docs)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose place() `dropped` (column place) holds; all columns stay.

    The places are written first, so that Spark knows their size when it chooses how to join.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), place(docs).alias("place"))
    return whole.join(store(dropped.select("place")), "place", "left_anti").select("document.*")
