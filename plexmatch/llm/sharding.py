"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, store, table

ROUNDS = 6
PRIME = 2147483647
BUCKETS = 4096
COPIES = 4096  # of one row, unfolded at once
SHARDS = 24
SEED = 20240229


def _keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Multiplier and addend of each round, by a linear congruence from the seed."""
    x, out = seed % PRIME, []
    for _ in range(rounds):
        x = (x * 48271 + 11) % PRIME
        y = (x * 48271 + 11) % PRIME
        out.append((x or 1, y))
        x = y
    return out


def _sides(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and a * b - n < a: the walk seldom has to go on."""
    b = 1
    while b * b < n:
        b = b * 2
    lo, hi = b // 2, b  # the least b with b * b >= n
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if mid * mid >= n else (mid + 1, hi)
    b = max(1, lo)
    return max(1, -(-n // b)), b


def permuted(x: int, n: int, seed: int = SEED) -> int:
    """Place of row x among n, as the DataFrame form computes it."""
    a, b = _sides(n)
    while True:
        x = _step(x, a, b, _keys(seed))
        if x < n:
            return x


def _step(x: int, a: int, b: int, keys: list[tuple[int, int]]) -> int:
    left, right = x // b, x % b
    for i, (m, c) in enumerate(keys):
        t = ((right if i % 2 == 0 else left) * m + c) % PRIME
        t = t * t % PRIME + t
        if i % 2 == 0:
            left = (left + t) % a
        else:
            right = (right + t) % b
    return left * b + right


def _walks(n: int, seed: int) -> int:
    """How often the longest walk from inside [0, n) applies the permutation.

    Fewer than a points lie outside, so this follows at most sqrt(n) points on the driver.
    """
    a, b = _sides(n)
    keys = _keys(seed)
    after = {x: _step(x, a, b, keys) for x in range(n, a * b)}
    heads = set(after) - set(after.values())  # entered from inside only
    longest = 1
    for x in heads:
        k = 1
        while x in after:
            x, k = after[x], k + 1
        longest = max(longest, k)
    return longest


def permute(df: DataFrame, row: str, out: str, n: int, seed: int = SEED) -> DataFrame:
    """Add `out`, the place of `row` under the permutation of [0, n)."""
    a, b = _sides(n)
    df = df.withColumn(out, F.col(row))
    for walk in range(_walks(n, seed)):
        df = df.withColumns({"_l": F.expr(f"`{out}` div {b}L"), "_r": F.col(out) % b})
        for i, (m, c) in enumerate(_keys(seed)):
            source, target, side = ("_r", "_l", a) if i % 2 == 0 else ("_l", "_r", b)
            df = df.withColumn("_t", (F.col(source) * m + c) % PRIME)
            df = df.withColumn(target, (F.col(target) + (F.col("_t") * F.col("_t")) % PRIME + F.col("_t")) % side)
        stepped = F.col("_l") * b + F.col("_r")
        df = df.withColumn(out, stepped if walk == 0 else F.when(F.col(out) < n, F.col(out)).otherwise(stepped))
    return df.drop("_l", "_r", "_t")


def number_rows(df: DataFrame) -> tuple[DataFrame, int]:
    """Global row numbers (column `row_no`, from 0 without gaps) and the number of rows.

    The order is by bucket (a remainder of id plus text checksum), id, size, checksum, so it depends
    on the rows alone, not on files or partitions. Rows that agree in all three are counted before
    the shuffle and unfolded at the end in blocks; no bucket needs more than its own distinct rows.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)) % BUCKETS + F.col("text_crc32"), F.lit(BUCKETS))
    rows = store(df.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("bucket", bucket.cast("int")))
    totals = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # BUCKETS rows at most
    starts, total = [], 0
    for k in range(BUCKETS):
        starts.append((k, total))
        total += totals.get(k, 0)
    offsets = spark.createDataFrame(starts, "bucket int, start long")
    order = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "size", "text_crc32")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = rows.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(offsets), "bucket")
    blocks = first.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))))
    if rows.filter(F.col("n") > COPIES).limit(1).count():
        blocks = blocks.repartition("bucket", "text_crc32", "block")  # copies of one row are unfolded in many tasks
    copy = F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("n"), F.col("block") * COPIES + COPIES) - 1))
    numbered = blocks.withColumn("copy", copy).withColumn("row_no", F.col("start") + F.col("before") + F.col("copy"))
    return numbered.select("doc_id", "size", "text_crc32", "row_no"), total


def feistel_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no, place for every row.

    place is the row's position in a reproducible shuffle; shard = place mod shards and
    slot = place div shards, so shards differ by one row at most (law `rows`) and anyone who
    knows row number, row count and seed can compute them. Size: UTF-8 bytes plus 8; a null text
    has none, an empty one likewise. Null ids sort first; repeated rows get places of their own;
    an empty table gives no rows; other columns are not read.
    """
    d = only(docs, id_col, text_col).toDF("doc_id", "text")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = d.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows, n = number_rows(keyed)
    return permute(rows, "row_no", "place", max(1, n), seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_no", "place")


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    crc = """list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
      lambda c, x: xor(c // 256, t.t[(xor(c % 256, x) + 1)::INT]))"""
    table_sql = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))"
    ctes = [
        f"t AS ({table_sql})",
        f"k AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, xor({crc}, 4294967295) AS text_crc32 FROM documents, t)",
        f"b AS (SELECT *, (coalesce(doc_id, 0) % {BUCKETS} + text_crc32) % {BUCKETS} AS bucket FROM k)",
        "o AS (SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no FROM b)",
        "m AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS mb FROM documents)",
        "w0 AS (SELECT o.*, row_no AS place, n, mb, (n + mb - 1) // mb AS ma FROM o, m)",
    ]
    for walk in range(1, 7):
        ctes.append(f"w{walk}_0 AS (SELECT *, place // mb AS l, place % mb AS r FROM w{walk - 1})")
        for i, (m, c) in enumerate(_keys(SEED)):
            source, target, side, other = ("r", "l", "ma", "r") if i % 2 == 0 else ("l", "r", "mb", "l")
            t = f"(({source} * {m} + {c}) % {PRIME})"
            ctes.append(f"w{walk}_{i + 1} AS (SELECT * EXCLUDE (l, r), {other}, ({target} + ({t} * {t}) % {PRIME} + {t}) % {side} AS {target} FROM w{walk}_{i})")
        stepped = "l * mb + r"
        new = stepped if walk == 1 else f"CASE WHEN place < n THEN place ELSE {stepped} END"
        ctes.append(f"w{walk} AS (SELECT * EXCLUDE (l, r, place), {new} AS place FROM w{walk}_{ROUNDS})")
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {SHARDS})::INT AS shard, place // {SHARDS} AS slot, NULL::INT AS grown_shard, row_no, place FROM w6"


OP1_SQL = _oracle()
