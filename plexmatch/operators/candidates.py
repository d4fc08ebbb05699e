"""Candidate filters: label and degree, then refinement over the pattern's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from .graph import Graph
from .materialise import cut


def by_label_and_degree(graph: Graph, pattern: Pattern) -> dict[int, DataFrame]:
    """vid of the data vertices with a query vertex's label and at least its degree."""
    out, total = {}, {}
    for u, label in pattern.labels.items():
        least = pattern.degree(u)
        if label not in total:
            total[label] = graph.total_degrees(label)
        out[u] = total[label].filter(F.col("deg") >= least).select(F.col("src").alias("vid")) if least else graph.vertices(label)
    return out


def _together(candidates: dict[int, DataFrame]) -> DataFrame:
    out = None
    for u, df in candidates.items():
        one = df.select(F.lit(u).alias("u"), "vid")
        out = one if out is None else out.unionByName(one)
    return out


def refine(graph: Graph, pattern: Pattern, candidates: dict[int, DataFrame], rounds: int = 2) -> dict[int, DataFrame]:
    """Drop candidates of u without a neighbour among the candidates of some neighbour of u, `rounds` times over.

    Vertices take turns, each seeing what the turns before have left. A turn's result is written to the
    shared folder, so that no plan holds more than one turn.
    """
    for _ in range(rounds):
        for u in pattern.labels:
            mine = candidates[u]
            for v in pattern.neighbours[u]:
                edge = graph.edges(pattern.labels[u], pattern.labels[v]).select(F.col("src").alias("vid"), "dst")
                alive = edge.join(candidates[v].select(F.col("vid").alias("dst")), "dst", "left_semi").select("vid")
                mine = mine.join(alive, "vid", "left_semi")
            candidates = candidates | {u: cut(mine)}
    return candidates


def sizes(candidates: dict[int, DataFrame]) -> DataFrame:
    """(query_vertex, candidates), in one job."""
    empty = [F.struct(F.lit(u).alias("query_vertex"), F.lit(0).cast("long").alias("candidates")) for u in candidates]
    counts = _together(candidates).groupBy(F.col("u").alias("query_vertex")).agg(F.count("*").alias("candidates"))
    spark = counts.sparkSession
    return counts.unionByName(spark.range(1).select(F.inline(F.array(*empty)))).groupBy("query_vertex").agg(F.max("candidates").alias("candidates"))
