"""Registered queries over files written for them: graphs and patterns as text, part files, stores, the command line.

Files go to a folder of the query's own under the shared folder.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .functions import scalar
from .operators import vertex_program
from .operators.counter import count
from .operators.graph import Graph
from .operators.materialise import shared_folder
from .operators.matcher import match
from .plans.pattern import Pattern
from .plans.planner import plan
from .plans.report import batch, summary
from .sources import edge_store, sinks
from .sources.adjacency import read_graph, rejected_lines, to_lines
from .sources.patterns import read_pattern, read_patterns
from .sources.tables import star_graph
from .streaming.edges import label_degrees, stream_edges

PATTERN_FILES = {
    "cycle.txt": "0 n 1 c 4 s\n1 c 0 n 2 o\n2 o 1 c 3 p\n3 p 2 o 4 s\n4 s 3 p 0 n\n",
    "edge.txt": "7 c 9 n\n9 n 7 c\n",
    "star.txt": "0 o 1 p\n1 p\n2\tp 0 o\n",
}
ODD_LINES = ("# a graph", "", "1 a 2 b 3 c", "2x b 1 a", "x a 2 b", "3 c y b 1 a", "4", "5 a 1", "99999999999999999999 a")


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/plexmatch-query-{uuid.uuid4().hex}"


def _text_graph(spark: SparkSession, sf: str) -> Graph:
    """The star graph written as adjacency lines and read from those files."""
    at = f"{folder(spark)}/graph"
    sinks.write_lines(to_lines(star_graph(spark, sf)), at, lines_per_file=20_000)
    if not sinks.exists(spark, at) or sinks.exists(spark, f"{at}-none"):
        raise FileNotFoundError(at)
    return read_graph(spark, at)


def _uploaded(spark: SparkSession, files: dict[str, str]) -> str:
    """A directory of small files made on the driver and copied to the shared folder."""
    at = folder(spark)
    with tempfile.TemporaryDirectory() as local:
        for name, text in files.items():
            with open(os.path.join(local, name), "w") as f:
                f.write(text)
        sinks.upload(spark, local, at)
    return at


def text_graph_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Edges by label pair of a graph read from text files."""
    return _text_graph(spark, sf).pair_histogram()


def text_graph_match(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern file's mappings in a graph read from text files."""
    pattern = read_pattern(f"{_uploaded(spark, PATTERN_FILES)}/cycle.txt", spark)
    return match(_text_graph(spark, sf), plan(pattern))


def pattern_directory(spark: SparkSession, sf: str) -> DataFrame:
    """Each file of a directory of patterns, counted."""
    out, g = None, star_graph(spark, sf)
    for p in read_patterns(_uploaded(spark, PATTERN_FILES), spark):
        one = count(g, plan(p)).select(F.lit(p.name).alias("filename"), F.lit(len(p.labels)).alias("vertices"), F.lit(len(p.edges)).alias("edges"), "mapping_count")
        out = one if out is None else out.unionByName(one)
    return out


def part_files(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of part names in files of 300 lines at most: how many come back, and whether an existing folder is refused and, if asked, overwritten."""
    at, lines = folder(spark), spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("value"))
    sinks.write_lines(lines.union(lines), at)
    refused = False
    try:
        sinks.write_lines(lines, at)
    except AnalysisException:
        refused = True
    sinks.write_lines(lines, at, overwrite=True, lines_per_file=300)
    back = spark.read.text(at)
    per = back.groupBy(back.metadataColumn("_metadata")["file_path"].alias("file")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("lines"), (F.max("n") <= 300).alias("bounded")).select("lines", "bounded", F.lit(refused).alias("refused"))


def edge_store_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Edges by label pair of a graph written to the edge store and opened again."""
    at = folder(spark)
    edge_store.write_graph(star_graph(spark, sf), at)
    return edge_store.open_graph(spark, at).pair_histogram()


def fastq_put(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of FASTQ text, four lines a record, after they have been put."""
    at, c = folder(spark), F.col
    part = spark.read.parquet(f"{sf}/part.parquet")
    records = part.select("p_partkey", F.posexplode(F.array(F.concat(F.lit("@"), c("p_partkey").cast("string")), c("p_name"), F.lit("+"), F.lit("@II+"))).alias("i", "value"))
    sinks.write_lines(records.coalesce(1).sortWithinPartitions("p_partkey", "i"), f"{at}/reads")
    sinks.put_fastq(spark, f"{at}/reads", f"{at}/put", lines_per_file=500)
    return spark.read.text(f"{at}/put")


def lines_left_out(spark: SparkSession, sf: str) -> DataFrame:
    return rejected_lines(spark.createDataFrame([(x,) for x in ODD_LINES], "value string"))


def command_line(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the match dump that the command line writes for the star graph and a pattern file, with their numbers."""
    at = folder(spark)
    sinks.write_lines(to_lines(star_graph(spark, sf)), f"{at}/graph")
    pattern = _uploaded(spark, {"path.txt": "0 r 1 n\n1 n 0 r 2 s\n2 s 1 n\n"})
    with contextlib.redirect_stdout(io.StringIO()):
        cli.main(["-d", f"{at}/graph", "-q", pattern, "-input", "spark", "-out", f"{at}/out", "-report", "long", "-filter", "on", "-leaf", "off"])
    return spark.read.text(f"{at}/out").groupBy("value").agg(F.count("*").alias("n"))


def single_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the command line reports for two orders: (name, matching_order, mapping_count)."""
    at = folder(spark)
    sinks.write_lines(to_lines(star_graph(spark, sf)), f"{at}/graph")
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        cli.main(["-d", f"{at}/graph", "-q", _uploaded(spark, {"edge.txt": PATTERN_FILES["edge.txt"]}), "-input", "spark", "-order", "dad", "-pseudo", "off", "-preprocess", "off"])
    found = re.findall(r"^(\S+) (\S+): Mapping count = (\d+) ", said.getvalue(), re.MULTILINE)
    return spark.createDataFrame([(a, b, int(n)) for a, b, n in found], "name string, matching_order string, mapping_count bigint")


def batch_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a batch: mappings, and whether there is an average time."""
    total = summary(batch(star_graph(spark, sf), [Pattern.of("cn", "01"), Pattern.of("rns", "01 12")], "dad"))
    return spark.createDataFrame([(total["mappings"], total["average_time"] > 0)], "mappings bigint, timed boolean")


def plan_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The printed plan of a pattern with a back edge, rivals and countable leaves."""
    text = plan(Pattern.of("acbc", "01 12 23 30")).describe() + "\n" + plan(Pattern.of("nssc", "01 02 03")).describe()
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, line string")


def pattern_helpers(spark: SparkSession, sf: str) -> DataFrame:
    """Of every ordered pair of a pattern's vertices: edge, ancestor, place in the order."""
    p = Pattern.of("cbbab", "01 02 03 34")
    the_plan = plan(p)
    rows = [(u, v, p.has_edge(u, v), the_plan.is_ancestor(u, v), the_plan.order.index(u), p.degree(u)) for u in p.labels for v in p.labels if u != v]
    return spark.createDataFrame(rows, "u int, v int, edge boolean, ancestor boolean, place int, degree int")


def combined_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs, and combined hashes, that differ; a pair turned round has another hash."""
    pairs = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey")
    h = scalar.hash_combine(F.col("l_orderkey"), F.col("l_partkey"))
    turned = scalar.hash_combine(F.col("l_partkey"), F.col("l_orderkey"))
    return pairs.agg(F.count_distinct("l_orderkey", "l_partkey").alias("pairs"), F.count_distinct(h).alias("hashes"), F.sum(((h == turned) & (F.col("l_orderkey") != F.col("l_partkey"))).cast("bigint")).alias("turned_alike"))


def added_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Nations made by their customers at run time: mail sent before they are there is lost, later mail is counted.

    Superstep 1 writes to the nations and adds them; superstep 2 writes again; in superstep 3 each
    nation counts its mail. Every superstep also writes to a vertex that never exists.
    """
    g = star_graph(spark, sf)
    to_nation = g.edges("c", "n")
    start = g.vertices("c").select("vid", F.lit(0).cast("bigint").alias("mail"), F.lit(False).alias("made"))

    def compute(rows: DataFrame, step: int) -> vertex_program.Step:
        writers = rows.filter("NOT made")
        sent = vertex_program.multicast(writers, to_nation, F.lit(1).cast("bigint"))
        lost = writers.select(F.lit(-1).cast("bigint").alias("dst"), F.lit(1).cast("bigint").alias("payload"))
        got = rows.withColumn("mail", F.when(F.col("made"), F.coalesce(F.col("inbox").cast("bigint"), F.lit(0).cast("bigint"))).otherwise(F.col("mail")))
        new = to_nation.select(F.col("dst").alias("vid")).distinct().withColumns({"mail": F.lit(0).cast("bigint"), "made": F.lit(True)}) if step == 1 else None
        return vertex_program.Step(got, sent.unionByName(lost), new)

    return vertex_program.run(start, compute, 3, combiner=F.sum).filter("made").select("vid", "mail")


def controlled_program(spark: SparkSession, sf: str) -> DataFrame:
    """The least vertex of each component of regions, nations and suppliers: stopped by an aggregate that no longer changes, woken once."""
    g = star_graph(spark, sf)
    vertices = g.vertices("r").unionByName(g.vertices("n")).unionByName(g.vertices("s"))
    edges = g.edges("n", "r").unionByName(g.edges("r", "n")).unionByName(g.edges("n", "s")).unionByName(g.edges("s", "n"))
    seen: list[int] = []

    def compute(rows: DataFrame, step: int, totals: dict) -> vertex_program.Step:
        mail = F.coalesce(F.col("inbox").cast("bigint"), F.col("least"))
        state = rows.withColumn("least", F.least("least", mail)).withColumn("round", F.lit(totals.get("last", 0) + 1).cast("bigint"))
        return vertex_program.Step(state, vertex_program.multicast(state, edges, F.col("least")))

    def control(step: int, totals: dict) -> str | None:
        seen.append(totals["total"])
        if len(seen) > 2 and seen[-1] == seen[-2]:
            return vertex_program.STOP
        return vertex_program.WAKE_ALL if step == 1 else None

    start = vertices.select("vid", F.col("vid").alias("least"), F.lit(0).cast("bigint").alias("round"))
    done = vertex_program.run(start, compute, 20, combiner=F.min, aggregators={"total": F.sum("least"), "last": F.max("round")}, control=control)
    return done.select("vid", "least")


def streamed_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours by label of each nation, from adjacency files read as a stream."""
    at = folder(spark)
    g = star_graph(spark, sf)
    near = g.edges("n", "c").groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda v: F.concat(v.cast("string"), F.lit(" c"))), " ").alias("nbs"))
    sinks.write_lines(near.select(F.concat_ws(" ", F.col("src").cast("string"), F.lit("n"), "nbs").alias("value")), f"{at}/graph")
    name = f"degrees_{uuid.uuid4().hex}"
    query = label_degrees(stream_edges(spark, f"{at}/graph")).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


QUERIES = {
    "s_text_graph_scan": text_graph_scan,
    "s_text_graph_match": text_graph_match,
    "s_pattern_directory": pattern_directory,
    "s_part_files": part_files,
    "s_edge_store": edge_store_pairs,
    "s_fastq_put": fastq_put,
    "s_rejected_lines": lines_left_out,
    "s_command_line": command_line,
    "s_single_report": single_report,
    "s_streamed_degrees": streamed_degrees,
    "p_batch_totals": batch_totals,
    "p_plan_lines": plan_lines,
    "x_pattern_helpers": pattern_helpers,
    "x_hash_combine": combined_hashes,
    "v_added_vertices": added_vertices,
    "v_controlled": controlled_program,
}


def oracles(pattern_sql, slice_sql, pair_sql: str) -> dict[str, str]:
    """The SQL of these queries; pattern_sql, slice_sql and pair_sql are the pieces that other queries' SQL is made of."""
    counted = lambda p: f"(SELECT count(*) FROM ({pattern_sql(p, '*')}))::BIGINT"
    cycle, edge, star = (Pattern.parse(PATTERN_FILES[f], name=f) for f in ("cycle.txt", "edge.txt", "star.txt"))
    path = pattern_sql(Pattern.of("rns", "01 12"), "*")
    helpers = Pattern.of("cbbab", "01 02 03 34")
    places, above = {0: 0, 3: 1, 4: 2, 1: 3, 2: 4}, {(0, 1), (0, 2), (0, 3), (0, 4), (3, 4)}
    return {
        "s_text_graph_scan": pair_sql,
        "s_text_graph_match": pattern_sql(cycle, "*"),
        "s_pattern_directory": " UNION ALL ".join(f"SELECT '{p.name}' AS filename, {len(p.labels)} AS vertices, {len(p.edges)} AS edges, {counted(p)} AS mapping_count" for p in (cycle, edge, star)),
        "s_part_files": "SELECT count(*)::BIGINT AS lines, true AS bounded, true AS refused FROM part",
        "s_edge_store": pair_sql,
        "s_fastq_put": "SELECT p_name AS value FROM part",
        "s_rejected_lines": "SELECT * FROM (VALUES ('x a 2 b', 'no id'), ('3 c y b 1 a', 'neighbour without id'), ('4', 'no label'), ('5 a 1', 'neighbour without label'), ('99999999999999999999 a', 'no id')) t(value, reason)",
        "s_command_line": f"WITH m AS ({path}) SELECT value, count(*)::BIGINT AS n FROM (SELECT '# Match' AS value FROM m UNION ALL SELECT '0 ' || u_0 FROM m UNION ALL SELECT '1 ' || u_1 FROM m UNION ALL SELECT '2 ' || u_2 FROM m) GROUP BY value",
        "s_streamed_degrees": f"SELECT src, 'c' AS dst_label, count(*)::BIGINT AS deg FROM {slice_sql('n', 'c')} GROUP BY src",
        "s_single_report": " UNION ALL ".join(f"SELECT 'edge.txt' AS name, '{o}' AS matching_order, {counted(edge)} AS mapping_count" for o in ("degree", "anti-degree")),
        "p_batch_totals": f"SELECT 2 * ({counted(Pattern.of('cn', '01'))} + {counted(Pattern.of('rns', '01 12'))})::BIGINT AS mappings, true AS timed",
        "p_plan_lines": "SELECT * FROM (VALUES (0, '0:a'), (1, '  1:c'), (2, '    2:b'), (3, '      3:c (adjacent to 0, differs from 1)'), (4, '0:n'), (5, '  1:s (countable leaf)'), (6, '  2:s (differs from 1, countable leaf)'), (7, '  3:c (countable leaf)')) t(line_no, line)",
        "x_pattern_helpers": "SELECT * FROM (VALUES " + ", ".join(f"({u}, {v}, {helpers.has_edge(u, v)}, {(u, v) in above}, {places[u]}, {helpers.degree(u)})" for u in range(5) for v in range(5) if u != v) + ") t(u, v, edge, ancestor, place, degree)",
        "x_hash_combine": "SELECT n AS pairs, n AS hashes, 0::BIGINT AS turned_alike FROM (SELECT count(DISTINCT (l_orderkey, l_partkey))::BIGINT AS n FROM lineitem)",
        "v_added_vertices": f"SELECT dst AS vid, count(*)::BIGINT AS mail FROM {slice_sql('c', 'n')} GROUP BY dst",
        "v_controlled": f"""
WITH m AS (SELECT dst AS root, src AS vid FROM {slice_sql('n', 'r')} UNION ALL SELECT a.dst, b.src FROM {slice_sql('n', 'r')} a JOIN {slice_sql('s', 'n')} b ON b.dst = a.src UNION ALL SELECT DISTINCT r_regionkey::BIGINT * 8, r_regionkey::BIGINT * 8 FROM region)
SELECT vid, min(vid) OVER (PARTITION BY root) AS least FROM m""",
    }
