"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Words are the runs of letters and digits of the lower-cased text. A seed hashes the words that a
mask selects and ignores the others, so a substituted word in an ignored place does not hide a hit.
Seeds of documents meet those of benchmark items by hash; each hit fixes an alignment, and around
it the words are compared one by one. An item is found in a document if, in some alignment, WINDOW
consecutive words of the item (all of a shorter item) agree with the document in SHARE of places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, store, table

#: Fixed masks; every one holds two selected words next to each other, which a bitmap looks up first.
#: Wherever SHARE lets words of a WINDOW be substituted, one of these misses them all.
MASKS = ("11011011", "111010011", "1100110101")
#: Masks of items shorter than WINDOW, likewise (four words in a row, or two pairs about one place; the
#: others are for items of five words). Still shorter items have to agree in all words.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
WINDOW, SHARE = 13, 0.8
LEAST_WORDS = 5
BLOCK_SEEDS = 500_000
MAX_BITS = 24
_SPLIT = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda x: x != "")


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _anchor(mask: str) -> int:
    """Place of the mask's first two selected words next to each other."""
    return mask.index("11")


def _seed(h: Column, i: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(h, i + o) for o in _offsets(mask)])


def _places(h: Column, span: int) -> Column:
    return F.when(F.size(h) >= span, F.sequence(F.lit(0), F.size(h) - span)).otherwise(F.array().cast("array<int>"))


def _bitmap(values: list[int], bits: int) -> Column:
    """A literal array of 64-bit words with a bit set for each value's low bits."""
    words = [0] * (1 << (bits - 6))
    for x in values:
        x &= (1 << bits) - 1
        words[x >> 6] |= 1 << (x & 63)
    return F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in words)), ",").cast("array<bigint>")


def _has(bitmap: Column, bits: int, x: Column) -> Column:
    low = x.bitwiseAND(F.lit((1 << bits) - 1))
    word = F.get(bitmap, F.shiftright(low, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, low.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _fixed(column: Column) -> Column:
    """The column as a one-row generator's output: worked out once, never copied into what uses it."""
    return F.explode(F.array(column))


def _bits(n: int) -> int:
    return min(MAX_BITS, max(12, math.ceil(math.log2(max(1, n))) + 5))


def _seeds(items: DataFrame, least_words: int) -> tuple[DataFrame, list[str]]:
    """(item, q, mask, seed, pair) of every place q of an item where a mask of its length fits, and the masks in use."""
    size = F.size("b")
    fits = {m: size >= WINDOW for m in MASKS} | {m: (size < WINDOW) & (size >= LEAST_WORDS) for m in SHORT_MASKS}
    for n in range(least_words, LEAST_WORDS):
        fits["1" * n] = fits.get("1" * n, F.lit(False)) | (size == n)
    some = items.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(m) for m, c in fits.items()]).first()
    masks = [m for m in fits if some[m]] or [MASKS[0]]
    out = None
    for k, m in enumerate(masks):
        placed = items.filter(fits[m]).select("item", "b", F.explode(_places(F.col("b"), len(m))).alias("q"))
        at = F.col("q") + _anchor(m)
        one = placed.select("item", "q", F.lit(k).alias("mask"), _seed(F.col("b"), F.col("q"), m).alias("seed"), F.xxhash64(F.get("b", at), F.get("b", at + 1)).alias("pair"))
        out = one if out is None else out.unionByName(one)
    return out, masks


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", least_words: int = LEAST_WORDS, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, text_md5, item_id, item_words, window, matched.

    matched is the largest number of agreeing words in a window of the item (WINDOW words, or all of a
    shorter item); the item is found where SHARE of them agree, whichever these are. Whole texts are
    searched, for items of at least `least_words` words (two or more; shorter phrases stand in texts by
    chance). Null and empty texts hold nothing. Rows with the same id and text count as one document;
    rows with a null id are told apart by text_md5. Either table may be empty: no rows. Other columns
    are not read. Items are taken in blocks of about `block_seeds` seeds, each block against all
    documents, so seeds, bitmaps and items that are broadcast have the same bound whatever the benchmark's size.
    """
    words = F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))
    items = only(benchmark, item_col, "text").toDF("item_id", "text").select("item_id", words.alias("b")).filter(F.size("b") >= max(2, least_words)).dropDuplicates(["item_id", "b"])
    items = store(items.withColumn("item", F.monotonically_increasing_id()))
    seeds, masks = _seeds(items, max(2, least_words))
    blocks = max(1, math.ceil(seeds.count() / block_seeds))
    d = only(docs, id_col, text_col).toDF("doc_id", "text")
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), _fixed(words).alias("h"))
    out = None
    for k in range(blocks):
        mine = F.pmod(F.xxhash64("item"), F.lit(blocks)) == k
        one = _found(d, items.filter(mine), store(seeds.filter(mine)), masks)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "text_md5", "item_id", "item_words", "window").agg(F.max("matched").alias("matched"))


def _found(d: DataFrame, items: DataFrame, seeds: DataFrame, masks: list[str]) -> DataFrame:
    """Alignments of documents (doc_id, text_md5, word hashes h) with items in which a window agrees."""
    marks = seeds.select("seed", "pair").collect()  # a block of seeds
    bits = _bits(len(marks))
    pairs, known = _bitmap([r["pair"] for r in marks], bits), _bitmap([r["seed"] for r in marks], bits)
    h, reach = F.col("h"), WINDOW - 1
    at = F.filter(_places(h, min(len(m) - _anchor(m) for m in masks)), lambda i: _has(pairs, bits, F.xxhash64(F.get(h, i), F.get(h, i + 1))))
    rows = d.select("doc_id", "text_md5", "h", _fixed(at).alias("at"))

    def hits_of(k: int, mask: str) -> Column:
        starts = F.transform("at", lambda i: i - _anchor(mask)) if _anchor(mask) else F.col("at")
        fits = F.filter(starts, lambda i: (i >= 0) & (i + len(mask) <= F.size(h)) if _anchor(mask) else i + len(mask) <= F.size(h))
        return F.filter(F.transform(fits, lambda i: F.struct(i.alias("p"), F.lit(k).alias("mask"), _seed(h, i, mask).alias("seed"))), lambda x: _has(known, bits, x["seed"]))

    hits = F.concat(*[hits_of(k, m) for k, m in enumerate(masks)])
    rows = rows.select("doc_id", "text_md5", "h", _fixed(hits).alias("hits")).filter(F.size("hits") > 0)
    # a hit takes along the words of all windows it may lie in
    first = lambda x: F.greatest(F.lit(0), x["p"] - reach)
    near = F.transform("hits", lambda x: F.struct(x["seed"].alias("seed"), x["mask"].alias("mask"), (x["p"] - first(x)).alias("p"), F.slice(h, first(x) + 1, F.lit(2 * reach + max(map(len, masks)))).alias("near")))
    hits = rows.select("doc_id", "text_md5", F.explode(near).alias("x")).select("doc_id", "text_md5", "x.*")
    aligned = hits.join(F.broadcast(seeds.drop("pair")), ["seed", "mask"]).join(F.broadcast(items), "item")

    size, window = F.size("b"), F.least(F.size("b"), F.lit(WINDOW))
    span = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1)
    low, high = F.greatest(F.lit(0), F.col("q") - reach), F.least(size, F.col("q") + span + reach)
    there = lambda j: F.col("p") - F.col("q") + low + j
    same = F.transform(F.slice("b", low + 1, high - low), lambda w, j: F.when((there(j) >= 0) & (F.get("near", F.greatest(F.lit(0), there(j))) == w), 1).otherwise(0))
    checked = aligned.select("doc_id", "text_md5", "item_id", size.alias("item_words"), window.alias("window"), _fixed(same).alias("same"))

    def step(a: Column, j: Column) -> Column:
        now = a["now"] + F.get("same", j) - F.when(j >= F.col("window"), F.get("same", j - F.col("window"))).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    best = F.aggregate(F.sequence(F.lit(0), F.size("same") - 1), start, step, lambda a: a["best"])
    checked = checked.select("doc_id", "text_md5", "item_id", "item_words", "window", _fixed(best).alias("matched"))
    return checked.filter(F.col("matched") >= F.ceil(F.col("window") * SHARE))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in which an item of the benchmark is found; all columns stay."""
    bad = store(contaminated(docs, benchmark).select("text_md5").distinct())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    return whole.join(bad, "text_md5", "left_anti").select("document.*")


def op9_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    """By the definition, without seeds: alignments by any words that agree, all windows of those that agree often enough."""
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    spread = lambda src, key, at: f"SELECT {key}, w[i + 1] AS x, i AS {at} FROM (SELECT {key}, w, unnest(range(len(w))) AS i FROM {src})"
    return f"""
WITH d AS (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS text_md5, {words} AS w FROM documents),
dr AS (SELECT *, row_number() OVER () AS r FROM d),
b AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark),
br AS (SELECT *, row_number() OVER () AS k, least(len(w), {WINDOW}) AS win FROM b WHERE len(w) >= {LEAST_WORDS}),
ds AS ({spread('dr', 'r', 'p')}),
bs AS ({spread('br', 'k', 'q')}),
c AS (SELECT r, k, p - q AS diag, count(*) AS n FROM ds JOIN bs USING (x) GROUP BY ALL),
e AS (SELECT doc_id, text_md5, item_id, len(br.w) AS item_words, win,
      [CASE WHEN diag + j >= 0 AND dr.w[diag + j + 1] = br.w[j + 1] THEN 1 ELSE 0 END FOR j IN range(len(br.w))] AS same
      FROM c JOIN dr USING (r) JOIN br USING (k) WHERE n >= ceil(win * {SHARE})),
f AS (SELECT *, list_max([list_sum(same[j + 1 : j + win]) FOR j IN range(len(same) - win + 1)]) AS matched FROM e)
SELECT doc_id, text_md5, item_id, item_words::INT AS item_words, win::INT AS "window", max(matched)::INT AS matched
FROM f WHERE matched >= ceil(win * {SHARE}) GROUP BY ALL
"""


OP9_SQL = _oracle()
