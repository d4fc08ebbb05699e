"""Adjacency-list text: `<vid> <label> (<neighbour> <its label>)*`, one vertex a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, prepare
from ..plans.pattern import LABEL_MODES


def _label(token: Column, mode: str) -> Column:
    if mode not in LABEL_MODES:
        raise ValueError(f"label_mode must be one of {LABEL_MODES}, not {mode!r}")
    return F.substring(token, 1, 1) if mode == "first_char" else token


def _id(token: Column) -> Column:
    """The number that a token begins with, null if there is none or it does not fit 64 bits."""
    return F.nullif(F.regexp_extract(token, r"^([+-]?[0-9]+)", 1), F.lit("")).try_cast("bigint")


def _fields(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments, with their fields t."""
    t = F.split(F.trim(F.translate("value", "\t\r", "  ")), " +")
    return lines.select("value", t.alias("t")).filter((F.get("t", F.lit(0)) != "") & ~F.startswith(F.get("t", F.lit(0)), F.lit("#")))


def parse_lines(lines: DataFrame, label_mode: str = "first_char") -> tuple[DataFrame, DataFrame]:
    """(vertices(vid, label), listed(src, dst, dst_label)) from a column `value` of lines.

    Blank lines and lines that begin with # are skipped; fields are parted by blanks and tabs. An id
    is the number a token begins with. Lines without an id or a label, and neighbours without an id
    or a label, are left out; rejected_lines() returns such lines.
    """
    parts = _fields(lines)
    rows = parts.select(_id(F.get("t", F.lit(0))).alias("vid"), _label(F.get("t", F.lit(1)), label_mode).alias("label"), "t").filter("vid IS NOT NULL AND label IS NOT NULL")
    pairs = F.when(F.size("t") > 3, F.transform(F.sequence(F.lit(2), F.size("t") - 2, F.lit(2)), lambda i: F.struct(_id(F.get("t", i)).alias("dst"), _label(F.get("t", i + 1), label_mode).alias("dst_label"))))
    listed = rows.select(F.col("vid").alias("src"), F.explode(pairs).alias("n")).select("src", "n.dst", "n.dst_label").filter("dst IS NOT NULL")
    return rows.select("vid", "label"), listed


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(value, reason): lines that parse_lines() leaves out in whole or in part."""
    odd = F.exists(F.transform(F.when(F.size("t") > 2, F.sequence(F.lit(2), F.size("t") - 1, F.lit(2))).otherwise(F.array().cast("array<int>")), lambda i: _id(F.get("t", i))), lambda x: x.isNull())
    reason = F.when(_id(F.get("t", F.lit(0))).isNull(), "no id").when(F.size("t") < 2, "no label").when(odd, "neighbour without id").when(F.size("t") % 2 == 1, "neighbour without label")
    return _fields(lines).select("value", reason.alias("reason")).filter("reason IS NOT NULL")


def read_graph(spark: SparkSession, path: str | list[str], label_mode: str = "first_char", symmetrise: bool = True) -> Graph:
    """A graph from one or several files or directories, on any file system Spark reads."""
    vertices, listed = parse_lines(spark.read.text(path), label_mode)
    vertices = vertices.dropDuplicates(["vid"])
    return Graph.from_edges(vertices, prepare(vertices, listed.select("src", "dst"), symmetrise))


def wrong_labels(lines: DataFrame, label_mode: str = "first_char") -> DataFrame:
    """Listed neighbours whose label differs from the neighbour's own line: (src, dst, dst_label, label)."""
    vertices, listed = parse_lines(lines, label_mode)
    return listed.join(vertices.hint("merge"), F.col("dst") == F.col("vid")).filter("dst_label <> label").select("src", "dst", "dst_label", "label")


def to_lines(graph: Graph) -> DataFrame:
    """The graph as adjacency-list lines, column value."""
    near = F.transform("nbs", lambda n: F.concat_ws(" ", n["dst"].cast("string"), n["dst_label"]))
    return graph.neighbour_lists().select(F.concat_ws(" ", F.col("vid").cast("string"), "label", F.array_join(near, " ")).alias("line")).select(F.rtrim("line").alias("value"))
