"""Removal of repeated word windows, found with a compressed full-text index per shard.

A window is WINDOW consecutive words. Its anchor is the least hash among its runs of GRAM words, so
equal windows have equal anchors: windows whose anchor stands only once in the corpus are settled at
once, and all others are dealt to shards by anchor. A shard builds an index over the distinct
passages it receives and streams them against it; backward search gives the matching statistics that
tell which windows stand twice or more. Shards hold about SHARD_WORDS words at any corpus size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, joined_by_size, only, sliced, store, table, texts, trimmed
from .fm_index import FMIndex, repeated_windows
from .textkit import BASE, BLANK, Words, mix

WINDOW, GRAM = 35, 16
LONGEST_RUN = 24  # windows in a passage at most
SHARD_WORDS = 1_000_000
HOT = 20_000  # an anchor with more occurrences sends each window on its own, dealt by content
WORD_BYTES = 8  # all of a word's hash; unequal windows would have to differ in colliding words only


def _slide(x, width: int, pick):
    """pick (minimum or maximum) over every `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def window_anchors(hashes, places, window: int = WINDOW, gram: int = GRAM):
    """(anchor of each window start, whether that window lies in one text, gram hashes)."""
    import numpy as np

    n = len(hashes)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    roll = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        roll = roll * np.uint64(BASE) + hashes[j : j + len(roll)]
    roll = mix(roll)
    least = _slide(roll, window - gram + 1, np.minimum)
    end = np.repeat(places[1:], np.diff(places))
    return least, np.arange(len(least)) + window <= end[: len(least)], roll


def _scan(window: int, gram: int):
    """Of every row: words, the digest of all words, and the anchor of each place where one stands."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, "text"):
            n = batch.num_rows
            w = Words(texts(batch.column("text")))
            least, good, grams = window_anchors(w.hashes(), w.places, window, gram)
            span = window - gram + 1
            # a gram is an anchor if it is the least of some window around it
            shown = np.zeros(len(grams) + span - 1, np.uint64)
            shown[span - 1 : span - 1 + len(least)] = np.where(good, least, 0)
            at = np.flatnonzero(_slide(shown, span, np.maximum)[: len(grams)] == grams) if len(grams) else np.zeros(0, np.int64)
            owner = np.searchsorted(w.places, at, side="right") - 1
            offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
            # words joined by one space
            inside = ~BLANK[w.data]
            keep = inside.copy()
            inner = np.flatnonzero(np.diff(w.owner()) == 0) + 1  # words that are not their text's first
            keep[w.starts[inner] - 1] = True
            out = np.where(inside, w.data, np.uint8(32))[keep]
            cut = np.r_[0, np.cumsum(keep)][w.offsets]
            data = out.tobytes()
            sha = [hashlib.sha256(data[a:b]).digest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("md5"), pa.array(w.counts.astype(np.int64)), pa.array(sha, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(grams[at].view(np.int64)))],
                names=["row", "doc_id", "md5", "n_words", "sha", "anchors"],
            )
            row += n

    return run


def _passages(window: int, gram: int):
    """Runs of windows with one repeated anchor, as packed word hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, "text"):
            w = Words(texts(batch.column("text")))
            h = w.hashes()
            least, good, _ = window_anchors(h, w.places, window, gram)
            owner = w.owner()[: len(least)]
            hot = np.zeros(len(least), bool)
            for column, to in (("anchors", good), ("hot", hot)):
                lists = batch.column(column)
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                pairs = np.sort(mix(values + of.astype(np.uint64) * np.uint64(BASE)))
                mine = mix(least + owner.astype(np.uint64) * np.uint64(BASE))
                at = np.minimum(np.searchsorted(pairs, mine), max(0, len(pairs) - 1))
                to &= (pairs[at] == mine) if len(pairs) else False
                if column == "anchors" and len(lists):
                    hot |= good
            i = np.flatnonzero(good)
            if not len(i):
                continue
            new = np.r_[True, (np.diff(i) != 1) | (least[i][1:] != least[i][:-1]) | (owner[i][1:] != owner[i][:-1])] | hot[i]
            first = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            new |= (np.arange(len(i)) - first[run_of]) % LONGEST_RUN == 0
            first = np.flatnonzero(new)
            start, windows = i[first], np.diff(np.r_[first, len(i)])
            data = h.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()
            words = [data[WORD_BYTES * s : WORD_BYTES * (s + k + window - 1)] for s, k in zip(start.tolist(), windows.tolist(), strict=True)]
            seg = [hashlib.md5(x).digest() for x in words]
            route = np.where(hot[start], np.frombuffer(b"".join(seg), np.int64)[::2], least[start].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(owner[start])), pa.array(start - w.places[owner[start]]), pa.array(windows), pa.array(seg, pa.binary()), pa.array(route), pa.array(words, pa.binary())],
                names=["row", "start", "windows", "seg", "route", "words"],
            )

    return run


def _shard(window: int):
    def run(t):
        import numpy as np
        import pyarrow as pa

        t = t.combine_chunks()
        words = t["words"].to_pylist()
        length = np.array([len(x) // WORD_BYTES for x in words], np.int64)
        wide = np.zeros((int(length.sum()), 8), np.uint8)
        wide[:, :WORD_BYTES] = np.frombuffer(b"".join(words), np.uint8).reshape(-1, WORD_BYTES)
        del words
        _, number = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        number = number.astype(np.int64) + 1
        index = FMIndex(number, length, window + LONGEST_RUN)
        start = np.cumsum(length) - length
        windows = length - window + 1
        masks = (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)
        once = np.flatnonzero(t["n"].to_numpy() == 1)  # of a passage that stands twice, all windows do
        masks[once] = repeated_windows(index, number, start[once], length[once], window)
        some = pa.array(np.flatnonzero(masks))
        return pa.table({"seg": t["seg"].take(some), "mask": pa.array(masks.view(np.int64)).take(some), "n": t["n"].take(some)})

    return run


def _removed(window: int):
    """Words covered by repeated windows taken out of the texts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, "text"):
            w = Words(texts(batch.column("text")))
            edge = np.zeros(len(w.starts) + 1, np.int64)
            for i, found in enumerate(batch.column("found").to_pylist()):
                for x in found:
                    at, mask = w.places[i] + x["start"], x["mask"]
                    while mask:
                        low = (mask & -mask).bit_length() - 1
                        edge[at + low] += 1
                        edge[at + low + window] -= 1
                        mask &= mask - 1
            covered = np.cumsum(edge)[:-1] > 0
            data = w.data.tobytes()
            gone, sha = [], []
            for a, b in zip(w.places[:-1], w.places[1:], strict=True):
                left = np.flatnonzero(~covered[a:b]) + a
                gone.append(int(b - a - len(left)))
                sha.append(hashlib.sha256(b" ".join([data[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)])).digest())
            yield pa.RecordBatch.from_arrays([batch.column("md5"), pa.array(gone, pa.int64()), pa.array(sha, pa.binary())], names=["md5", "gone", "left_sha"])

    return run


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row.

    A word goes if a window that covers it stands at another place too, in any text or its own. Null
    and empty texts have no words; a text of fewer words than a window keeps all; copies of one text
    are worked out once, and texts, anchors and passages that stand very often are met by broadcasts of
    bounded size; null ids and repeated rows count like any row; an empty table gives no rows;
    other columns are not read.
    """
    import math

    d = only(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    d = d.withColumn("md5", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    base = store(d.mapInArrow(trimmed(_scan(window, gram)), "row long, doc_id long, md5 binary, n_words long, sha binary, anchors array<long>"))
    rows = base.count()
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    reps = store(base.groupBy("md5").agg(head.alias("head"), F.count("*").alias("copies"), F.max("n_words").alias("words")).select("md5", "copies", "words", F.col("head.row").alias("row"), F.col("head.doc_id").alias("id")), rows)

    # one text of each group of copies speaks for it
    spread = base.select("row", "anchors").join(reps.select("row"), "row", "left_semi").select("row", F.explode("anchors").alias("anchor"))
    spread = store(spread)
    many = spread.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    marked = joined_by_size(spread.dropDuplicates(["row", "anchor"]), store(many), ["anchor"], "n", spread.count())
    marked = marked.groupBy("row").agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("n") > hot, F.col("anchor"))).alias("hot"))
    asked = reps.join(marked, "row").select("row", "id", F.col("md5").alias("key"), "anchors", "hot")
    found = d.join(asked, (d["md5"] == asked["key"]) & d["doc_id"].eqNullSafe(asked["id"])).select("row", "md5", "text", "anchors", "hot")
    found = store(found.dropDuplicates(["row"]))

    passages = store(found.select("row", "text", "anchors", "hot").mapInArrow(trimmed(_passages(window, gram)), "row long, start long, windows long, seg binary, route long, words binary"))
    distinct = store(passages.groupBy("seg").agg(F.first("route").alias("route"), F.first("words").alias("words"), F.count("*").alias("n")))
    total = distinct.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, math.ceil(total / WORD_BYTES / SHARD_WORDS))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    masks = store(dealt.groupBy("shard").applyInArrow(_shard(window), "seg binary, mask long, n long"))
    discard(spread, distinct)

    hits = joined_by_size(passages.select("row", "start", "seg"), masks, ["seg"], "n", passages.count()).groupBy("row").agg(F.collect_list(F.struct("start", "mask")).alias("found"))
    taken = found.select("row", "md5", "text").join(hits, "row").mapInArrow(trimmed(_removed(window)), "md5 binary, gone long, left_sha binary").withColumn("copies", F.lit(1).cast("long"))
    copied = reps.filter((F.col("copies") > 1) & (F.col("words") >= window)).select("md5", F.col("words").alias("gone"), F.unhex(F.sha2(F.lit("").cast("binary"), 256)).alias("left_sha"), "copies")
    single = reps.filter("copies = 1").select("md5")
    changed = store(taken.join(single, "md5", "left_semi").unionByName(copied), rows)
    discard(reps, found, passages, masks)
    base = base.select("doc_id", "md5", "n_words", "sha")
    long = joined_by_size(base.filter(F.col("n_words") >= window), changed, ["md5"], "copies", rows, "left")
    short = base.filter(F.col("n_words") < window).select("*", F.lit(0).cast("long").alias("gone"), F.lit(None).cast("binary").alias("left_sha"))
    out = long.drop("copies").unionByName(short)
    return out.select("doc_id", "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.lower(F.hex(F.coalesce("left_sha", "sha"))).alias("kept_sha256"))


def op3_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"))


OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
p AS (SELECT r, unnest(range(0, len(w) - {WINDOW - 1})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
g AS (SELECT r, i, md5(array_to_string(w[i + 1 : i + {WINDOW}], ' ')) AS h FROM p),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS j FROM m),
q AS (SELECT r, list(j) AS js FROM c GROUP BY r),
k AS (SELECT d.doc_id, d.w, coalesce(q.js, []) AS js FROM d LEFT JOIN q USING (r)),
o AS (SELECT doc_id, w, js, list_filter(w, lambda x, i: NOT list_contains(js, i - 1)) AS keep FROM k)
SELECT doc_id, len(w)::BIGINT AS n_words, len(js)::BIGINT AS n_removed, sha256(array_to_string(keep, ' ')) AS kept_sha256 FROM o
"""
