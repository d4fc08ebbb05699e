"""Edges on disk, laid out for matching: a directory for each label pair, optionally bucketed by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


def write_graph(graph: Graph, path: str, overwrite: bool = False) -> None:
    """Vertices and edges as Parquet under path; a slice later reads its own directory only."""
    mode = "overwrite" if overwrite else "errorifexists"
    graph.all_vertices().write.mode(mode).partitionBy("label").parquet(f"{path}/vertices")
    graph.all_edges().write.mode(mode).partitionBy("src_label", "dst_label").parquet(f"{path}/edges")


def open_graph(spark: SparkSession, path: str, labels: list[str] | None = None) -> Graph:
    """A graph that write_graph() has written. Label filters prune directories."""
    strings = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(strings)
    spark.conf.set(strings, "false")  # a label such as 7 stays a string
    try:
        vertices, edges = spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")
    finally:
        spark.conf.set(strings, before)
    return Graph.from_edges(vertices, edges, labels)


def write_bucketed(graph: Graph, a: str, b: str, name: str, buckets: int) -> DataFrame:
    """One slice as a table bucketed and sorted by src: joins on src of equally bucketed slices need no shuffle."""
    graph.edges(a, b).write.mode("overwrite").bucketBy(buckets, "src").sortBy("src").saveAsTable(name)
    return graph.edges(a, b).sparkSession.table(name).select(F.col("src"), F.col("dst"))
