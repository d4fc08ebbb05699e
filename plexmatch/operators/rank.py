"""Global sort and rank over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialise import cut

PLACE_BITS = 33  # of monotonically_increasing_id(), below the partition


def global_rank(df: DataFrame, keys: list[str], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """df in the order of keys with a column of ranks from 0, without a sort in one task.

    Rows are dealt to ranges by sampled splitters and sorted there; a range's first rank is the
    number of rows in the ranges before it. Equal keys are ranked in the order in which they happened to
    be written, once: the sorted rows go to the shared folder before ranks are read off them, so a
    task that is run again gives the same ranks. A run of its own may rank them otherwise.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = {r["part"]: r["n"] for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    starts, total = [], 0
    for k in sorted(sizes):
        starts.append((k, total))
        total += sizes[k]
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    ranked = dealt.withColumn("_part", part.cast("long")).join(F.broadcast(offsets), "_part")
    return ranked.withColumn(out, F.col("_start") + place).drop("_at", "_part", "_start")


def ranked_lines(df: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """`<rank> <content>` lines, column value."""
    return global_rank(df.withColumn("_content", content), keys, "_rank").select(F.concat_ws(" ", F.col("_rank").cast("string"), F.col("_content")).alias("value"))
