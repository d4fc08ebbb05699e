"""A Bloom filter over rows in blocks: a row's places lie in one block, so building and testing send each row once."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_HASHES, MOST_HASHES = 3, 128
BROADCAST_BITS = 1 << 26  # a filter of up to 8 MB goes to every task; a larger one is joined
PLACE = 15  # a block has 2**15 bits: its share of the rows varies by 2 % where a filter has 1 % false positives
WORDS = (1 << PLACE) // 64


@dataclass(frozen=True)
class Shape:
    hashes: int
    bits: int

    @classmethod
    def of(cls, n: int, fpp: float) -> Shape:
        """k = -ln f / ln 2, between LEAST_HASHES and MOST_HASHES; m = -n ln f / (ln 2)**2."""
        k = min(MOST_HASHES, max(LEAST_HASHES, round(-math.log(fpp) / math.log(2))))
        return cls(k, max(64, math.ceil(-max(1, n) * math.log(fpp) / math.log(2) ** 2)))

    @property
    def blocks(self) -> int:
        return -(-self.bits >> PLACE)


class BloomFilter:
    """blocks: (_block, _words), every block of the filter as an array of 64-bit words."""

    def __init__(self, blocks: DataFrame, shape: Shape, seed: int):
        self.blocks, self.shape, self.seed = blocks, shape, seed

    @staticmethod
    def _block(shape: Shape, seed: int, columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(shape.blocks))

    @staticmethod
    def _places(shape: Shape, seed: int, columns: list[Column]) -> list[tuple[Column, Column]]:
        """Word and bit of each place in the block; a 64-bit hash gives four places."""
        per = 64 // PLACE
        hashes = [F.xxhash64(F.lit(seed + 1 + i), *columns) for i in range(-(-shape.hashes // per))]
        some = [F.shiftrightunsigned(hashes[i // per], PLACE * (i % per)).bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int") for i in range(shape.hashes)]
        return [(F.shiftright(p, 6), p.bitwiseAND(F.lit(63))) for p in some]

    @classmethod
    def build(cls, df: DataFrame, columns: list[str], n: int, fpp: float = 0.01, seed: int = 0) -> BloomFilter:
        """A filter for about n different rows, with fpp false positives among others."""
        shape, keys = Shape.of(n, fpp), [F.col(c) for c in columns]
        dealt = df.select(cls._block(shape, seed, keys).alias("_block"), *keys).repartition("_block")
        bits = F.array(*[F.struct(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits")) for word, bit in cls._places(shape, seed, keys)])
        words = dealt.select("_block", F.inline(bits)).groupBy("_block", "word").agg(F.bit_or("bits").alias("bits"))
        held = words.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("s"))
        by_word = F.map_from_entries("s")  # only where some word has no bit, as in small filters
        dense = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.try_element_at(by_word, w), F.lit(0).cast("bigint")))
        return cls(held.select("_block", F.when(F.size("s") == WORDS, F.col("s.bits")).otherwise(dense).alias("_words")), shape, seed)

    def may_contain(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Rows of df whose columns may be in the filter; no row that is in it is lost."""
        keys = [F.col(c) for c in columns]
        blocks = F.broadcast(self.blocks) if self.shape.bits <= BROADCAST_BITS else self.blocks.hint("shuffle_hash")
        asked = df.withColumn("_block", self._block(self.shape, self.seed, keys)).join(blocks, "_block")
        for word, bit in self._places(self.shape, self.seed, keys):
            asked = asked.filter(F.call_function("shiftrightunsigned", F.get("_words", word), bit).bitwiseAND(F.lit(1)) == 1)
        return asked.drop("_block", "_words")
