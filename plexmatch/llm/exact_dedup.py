"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition reduces its rows to a run sorted by digest. The runs then meet in
rounds: a cell is named by digits of the digest and digits of the source lane, and each
round trades one lane digit for one digest digit, so a cell merges at most RADIX lanes and
keeps of each digest the best row only. A group of any size therefore enters a cell as at
most RADIX rows; in the first round, where input partitions beyond the number of lanes share
lanes, as that many for each such turn. After the last round a cell holds a range of digests,
complete.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import from_files, only, place, shuffle_width, sliced, store, table, texts, trimmed, without

RADIX = 8
BLANKS = b" \t\n\x0b\x0c\r"
_RUN = "digest binary, norm_bytes long, cp long, row long, doc_id long, n long, lane int"


def _digests(lanes: int, carried: bool):
    """With `carried`, a row's column place goes along."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in sliced(batches, "text"):
            n = batch.num_rows
            norm = [t.translate(None, BLANKS) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(t).digest() for t in norm], pa.binary()),
                    pa.array([len(t) for t in norm], pa.int64()),
                    pc.fill_null(pc.utf8_length(batch.column("text")), 0).cast(pa.int64()),
                    pa.array(np.arange(seen, seen + n) + (part << 33), pa.int64()),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.ones(n, np.int64)),
                    pa.array(np.full(n, part % lanes, np.int32)),
                    *([batch.column("place")] if carried else []),
                ],
                names=["digest", "norm_bytes", "cp", "row", "doc_id", "n", "lane", *(["place"] if carried else [])],
            )
            seen += n

    return run


def _merge(batches):
    """Of each (lane digits, digest) in a sorted stream keep the first row and the sum of n.

    Rows join a group only if the whole digest and the length of the normalised text agree.
    """
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        key = np.frombuffer(b"".join(t["digest"].to_pylist()), np.uint64).reshape(-1, 4)
        key = np.column_stack([key, t["norm_bytes"].to_numpy().astype(np.uint64), t["lane"].to_numpy().astype(np.uint64)])
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        n = np.add.reduceat(t["n"].to_numpy(), first)
        out = t.take(pa.array(first))
        out = out.set_column(out.schema.get_field_index("n"), "n", pa.array(n)).to_batches()[0]
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def _merged(runs: DataFrame) -> DataFrame:
    ordered = runs.sortWithinPartitions("lane", "digest", "norm_bytes", F.desc("cp"), F.asc_nulls_last("doc_id"), "row")
    return ordered.mapInArrow(trimmed(_merge), _RUN)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", placed: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without BLANKS. Of equal texts the row with the most code
    points stays, then the smallest id (null ids last), then the first row read. A null text
    counts as empty; empty texts form one group; a repeated row is a group of its own copies,
    of which one row is kept; an empty table gives no rows; other columns are not read. With
    `placed`, docs has to be read from Parquet and each row's place() is returned as well.
    """
    spark = docs.sparkSession
    rounds = max(2, math.ceil(math.log(max(2, shuffle_width(spark)), RADIX)))
    lanes = RADIX**rounds
    source = only(docs, id_col, text_col)
    also = [place(source).alias("place")] if placed else []
    source = source.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *also)
    base = store(source.mapInArrow(trimmed(_digests(lanes, placed)), _RUN + ", place struct<file:bigint,at:bigint>" * placed))
    local = _merged(base.drop("place"))  # each partition's run, kept apart by lane
    runs = local
    for t in range(rounds):
        # the digest's digit t takes the place of the lane's digit t
        unit = RADIX**t
        digit = F.conv(F.hex(F.substring("digest", t + 1, 1)), 16, 10).cast("int") % RADIX
        lane = F.col("lane") - (F.floor(F.col("lane") / unit).cast("int") % RADIX) * unit + digit * unit
        runs = _merged(runs.withColumn("lane", lane.cast("int")).repartition("lane"))
    groups = runs.filter("n > 1").select("digest", "norm_bytes", F.col("row").alias("keep_row"), F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    # back down: a group's result goes to each lane that holds copies, and rows meet it by lane
    # (once each: with more input partitions than lanes, or files cut on reading, runs of one lane lie in several partitions)
    back = local.select("digest", "norm_bytes", "lane").join(groups, ["digest", "norm_bytes"]).dropDuplicates(["digest", "norm_bytes", "lane"])
    single = F.col("keep_row").isNull()
    return base.join(back, ["digest", "norm_bytes", "lane"], "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(single, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
        F.when(single, True).otherwise(F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["place"] if placed else []),
    )


def exact_deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns."""
    docs = from_files(docs)
    return without(docs, exact_dedup(docs, placed=True).filter("not kept"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
