"""Language-model scores of documents: a subword lattice beside an add-one word model.

The lattice model draws units independently, an end unit last; a document's probability is the sum
over all segmentations. No unit crosses a word boundary, so that sum is a product over words, and a
word's factor is worked out once for each distinct word of the corpus. Unit probabilities start from
the vocabulary's scores and are re-estimated on the learning rows by expected counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, only, sliced, store, table, texts, trimmed
from .lattice import Lattice, read_units
from .textkit import SHORT, Words, fold

FOLDS, HELD_OUT = 7, 2
EM_ROUNDS = 2
UNIT_SMOOTHING = 0.05
HEAD_WORDS = 300_000  # at most so many of the commonest words are broadcast; the others are joined
END_SHARE = 1e-3


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _distinct(batches):
    import numpy as np
    import pyarrow as pa

    for batch in sliced(batches, "text"):
        w = Words(texts(batch.column("text")))
        train = np.repeat(~np.asarray(batch.column("held_out")), w.counts)
        first, which = w.distinct(fold_case=True)
        n = np.bincount(which, train, minlength=len(first)).astype(np.int64)
        data = w.data.tobytes().lower()
        words = [data[s:e] for s, e in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n)], names=["word", "c"])


def _expect(units, log_p):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        lattice, total = Lattice(units, log_p), np.zeros(len(units))
        for batch in batches:
            total += lattice.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["unit", "uses"])

    return run


def _word_scores(units, log_p):
    def run(batches):
        import pyarrow as pa

        lattice = Lattice(units, log_p)
        for batch in batches:
            scores = lattice.log_prob(batch.column("word").to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(scores)], names=["word", "c", "lattice"])

    return run


class Head:
    """Common words in order of their hashes, with what tells each from any other word, and values of theirs."""

    def __init__(self, words: list[bytes], values):
        import numpy as np

        w = Words([b" ".join(words)])
        order = np.argsort(w.hashes())
        self.hashes = w.hashes()[order]
        self.first, self.last, self.size = (x[order] for x in w.keys())
        self.data, self.starts = w.data, w.starts[order]
        self.values = [v[order] for v in values]

    def find(self, w: Words):
        """(places in the head of the text's words, whether each is that word: by all its bytes)."""
        import numpy as np

        h = w.hashes(fold_case=True)
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool), h
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        first, last, size = w.keys(fold_case=True)
        hit = (self.hashes[at] == h) & (self.first[at] == first) & (self.last[at] == last) & (self.size[at] == size)
        long = np.flatnonzero(hit & (size > SHORT))
        if len(long):
            hit[long] = w.agree(long, self.data, self.starts[at[long]], fold_case=True)
        return at, hit, h


def _doc_scores(head, end):
    """Sums over head words, and the other words with their counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, "text"):
            n = batch.num_rows
            w = Words(texts(batch.column("text")))
            owner = w.owner()
            at, hit, h = head.find(w)
            sums = [np.bincount(owner[hit], v[at[hit]], minlength=n) + e for v, e in zip(head.values, end, strict=True)]
            rest = np.flatnonzero(~hit)
            rest = rest[np.lexsort((h[rest], owner[rest]))]
            same = (h[rest][1:] == h[rest][:-1]) & (owner[rest][1:] == owner[rest][:-1])
            same &= _equal_words(w, rest)
            first = np.flatnonzero(np.r_[True, ~same]) if len(rest) else np.zeros(0, np.int64)
            tf = np.diff(np.r_[first, len(rest)])
            one = rest[first]
            data = w.data.tobytes().lower()
            words = [data[s:e] for s, e in zip(w.starts[one].tolist(), w.ends[one].tolist(), strict=True)]
            offsets = pa.array(np.searchsorted(owner[one], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(w.counts.astype(np.int64) + 1),
                    pa.array(sums[0].astype(np.int64)),
                    *map(pa.array, sums[1:]),
                    pa.ListArray.from_arrays(offsets, pa.array(words, pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64))),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "tf"],
            )
            row += n

    return run


def _equal_words(w: Words, rest):
    """Whether each of words `rest` has the same bytes as the one before."""
    first, last, size = (x[rest] for x in w.keys(fold_case=True))
    good = (first[1:] == first[:-1]) & (last[1:] == last[:-1]) & (size[1:] == size[:-1])
    long = (good & (size[1:] > SHORT)).nonzero()[0]
    if len(long):
        good[long] = w.agree(rest[long + 1], fold(w.data), w.starts[rest[long]], fold_case=True)
    return good


def lm_scores(docs: DataFrame, vocabulary: str | None = None, em_rounds: int = EM_ROUNDS, head_words: int = HEAD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Tokens are the words of the text in lower case (A-Z only) and one end. base_score is the add-one
    word model in log10; score is log10 of the lattice model's marginal probability. A null text
    counts as empty: one token, the end. A null id counts as the empty string when folds are dealt.
    Repeated rows are scored, and counted, each on its own; an empty table gives no rows; other
    columns are not read. The common words' scores are broadcast, HEAD_WORDS at most; those of all
    other words meet their documents in a join, where each such word is rare.
    """
    import numpy as np

    spark = docs.sparkSession
    d = only(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    d = d.withColumn("held_out", crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT)
    counts = store(d.mapInArrow(trimmed(_distinct), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    train_docs = d.select("held_out").filter("not held_out").count()
    got = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n, v = (got[0] or 0) + train_docs, (got[1] or 0) + (train_docs > 0)
    below = math.log10(n + v + 1)

    units, log_p = read_units(vocabulary or default_vocabulary())
    end_p = math.log(END_SHARE)
    for _ in range(em_rounds if got[0] else 0):
        uses = np.full(len(units), UNIT_SMOOTHING)
        found = counts.filter("c > 0").mapInArrow(trimmed(_expect(units, log_p)), "unit long, uses double").groupBy("unit").agg(F.sum("uses").alias("uses"))
        for r in found.collect():  # a row for each unit of the vocabulary at most
            uses[r["unit"]] += r["uses"]
        whole = uses.sum() + train_docs + UNIT_SMOOTHING
        log_p, end_p = np.log(uses / whole), math.log((train_docs + UNIT_SMOOTHING) / whole)

    words = store(counts.mapInArrow(trimmed(_word_scores(units, log_p)), "word binary, c long, lattice double"))
    least, room = 1, head_words
    for r in words.filter("c > 0").groupBy("c").count().orderBy(F.desc("c")).limit(head_words + 1).collect():
        if r["count"] > room:
            least = r["c"] + 1
            break
        room -= r["count"]
    common = words.filter(F.col("c") >= least).select("word", "c", "lattice").toArrow()  # head_words rows at most
    base = np.log10(common["c"].to_numpy() + 1.0) - below
    head = Head(common["word"].to_pylist(), (np.ones(len(common)), base, common["lattice"].to_numpy()))
    end = (int(train_docs > 0), math.log10(train_docs + 1) - below, end_p / math.log(10))
    run = trimmed(_doc_scores(head, end))
    scored = store(d.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<binary>, tf array<long>"))
    rest = scored.select("row", F.explode(F.arrays_zip("words", "tf")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.tf").alias("tf"))
    tail = rest.join(words.filter(F.col("c") < least), "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"),
        F.sum(F.col("tf") * (F.log10(F.col("c") + 1) - below)).alias("b"),
        F.sum(F.col("tf") * F.col("lattice")).alias("s"),
    )
    add = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return scored.drop("words", "tf").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", add("n_known", "k"), F.lit(n).cast("long").alias("train_tokens"), add("base_score", "b"), add("score", "s")
    )


def op10_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
