"""Graph files that keep arriving: adjacency lines read as a stream, edge counts kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adjacency import parse_lines


def stream_edges(spark: SparkSession, path: str, label_mode: str = "first_char") -> DataFrame:
    """Streaming (src, dst, dst_label) of adjacency files as they land in a directory."""
    return parse_lines(spark.readStream.schema("value string").text(path), label_mode)[1]


def label_degrees(edges: DataFrame) -> DataFrame:
    """Streaming (src, dst_label, deg), for output mode `complete` or `update`."""
    return edges.groupBy("src", "dst_label").agg(F.count("*").alias("deg"))
