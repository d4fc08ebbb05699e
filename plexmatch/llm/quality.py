"""Quality scores by nearest-neighbour voting in a latent semantic space.

Terms are hashed byte n-grams, weighted by inverse document frequency over the whole corpus, and a
few shares that describe a text's form. A truncated singular value decomposition of a bounded sample
of labelled rows gives the space. The sample's vectors and labels are broadcast; every document's
cosine with each of them is computed exactly, in blocks, and its nearest neighbours vote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, only, sliced, table, texts, trimmed
from .textkit import Words, byte_grams

FOLDS, HELD_OUT = 5, 0
BITS = 11  # 2**BITS buckets of byte n-grams
SHARES = 4
SHARE_WEIGHT = 1.5
LEARN_ROWS = 6000  # labelled rows learnt from, at most: those with the smallest hashed ids
RANK = 64
NEIGHBOURS = 25
SHARPNESS = 4.0  # a neighbour's weight is its cosine to this power
THRESHOLD = 0.3
BLOCK = 256
SEED = 11


def _frequencies(documents: list[bytes]):
    """Square roots of term shares: n-gram buckets, then the form shares; one row a text."""
    import numpy as np

    w = Words(documents)
    n, size = len(documents), 1 << BITS
    gram, owner = byte_grams(w.data, w.offsets, 3, BITS)
    tf = np.bincount((owner << BITS) + gram, minlength=n * size).reshape(n, size).astype(np.float32)
    total = np.maximum(1, np.diff(w.offsets))
    h, who = w.hashes(), w.owner()
    words = np.maximum(1, w.counts)
    again = np.flatnonzero((h[1:] == h[:-1]) & (who[1:] == who[:-1]))
    kind = np.zeros(256, np.int64)
    kind[65:91] = 1
    kind[48:58] = 2
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
    place = np.repeat(np.arange(n), np.diff(w.offsets))
    form = np.bincount(place * 4 + kind[w.data], minlength=4 * n).reshape(n, 4)[:, 1:]
    shares = np.column_stack([np.bincount(who[again], minlength=n) / words, form / total[:, None]]).astype(np.float32)
    return np.hstack([np.sqrt(tf / total[:, None]), SHARE_WEIGHT * np.sqrt(shares)])


def _blocks(batches):
    """Pieces of BLOCK rows at most and some megabytes of text."""
    for batch in sliced(batches, "text"):
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _document_frequency(batches):
    import numpy as np
    import pyarrow as pa

    total, n = np.zeros(1 << BITS, np.int64), 0
    for batch in _blocks(batches):
        total += (_frequencies(texts(batch.column("text")))[:, : 1 << BITS] > 0).sum(axis=0)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.r_[total, n])], names=["term", "n"])


def _features(batches):
    import numpy as np
    import pyarrow as pa

    for batch in _blocks(batches):
        f = _frequencies(texts(batch.column("text"))).astype(np.float16)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in f], pa.binary())], names=["doc_id", "label", "features"])


def _unit(x):
    import numpy as np

    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


def _vote(idf, axes, vectors, labels, prior: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in _blocks(batches):
            data = texts(batch.column("text"))
            score = np.full(batch.num_rows, prior)
            if len(vectors):
                latent = _unit((_frequencies(data) * idf) @ axes)
                near = latent @ vectors.T
                k = min(NEIGHBOURS, len(vectors))
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(float) ** SHARPNESS
                whole = weight.sum(axis=1)
                some = (whole > 0) & np.array([len(t) > 0 for t in data])
                score[some] = ((weight * labels[top]).sum(axis=1) / np.maximum(whole, 1e-12))[some]
            score = np.clip(score, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Labels are learnt from rows whose crc32(id as text) mod 5 is not 0, `learn_rows` of them at most;
    rows with a null id or label teach nothing, and the labels of a repeated id are averaged. A
    null, empty or featureless text scores the mean label; without any label that is 0.5. Null ids
    and repeated rows are scored as they come; an empty table gives no rows; other columns are not
    read. No document is shuffled: the model, of fixed size, goes to the documents.
    """
    import numpy as np

    d = only(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    taught = only(labels, id_col, label_col).toDF("doc_id", "label").dropna().withColumn("doc_id", F.col("doc_id").cast("long"))
    taught = taught.filter(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("label"))
    chosen = taught.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(learn_rows)
    sample = d.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(trimmed(_features), "doc_id long, label double, features binary")
    sample = sample.dropDuplicates(["doc_id", "features"]).limit(learn_rows).toPandas().sort_values("doc_id")
    df = np.zeros((1 << BITS) + 1)
    for r in d.select("text").mapInArrow(trimmed(_document_frequency), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]  # a row for each bucket
    idf = np.r_[np.log((1 + df[-1]) / (1 + df[:-1])) + 0.3, np.ones(SHARES)].astype(np.float32)

    width = len(idf)
    if len(sample):
        x = np.frombuffer(b"".join(sample["features"]), np.float16).reshape(-1, width).astype(np.float32) * idf
        rank = min(RANK, *x.shape)
        q = np.random.default_rng(SEED).standard_normal((width, min(rank + 16, width))).astype(np.float32)
        for _ in range(6):  # subspace iteration
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        axes = (q @ v.T)[:, :rank].astype(np.float32)
        vectors, marks = _unit(x @ axes), sample["label"].to_numpy(float)
    else:
        axes, vectors, marks = np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0)
    prior = float(marks.mean()) if len(marks) else 0.5
    scored = d.withColumn("held_out", crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT)
    return scored.mapInArrow(trimmed(_vote(idf, axes, vectors, marks, prior)), "doc_id long, held_out boolean, score double, predicted int")


def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
