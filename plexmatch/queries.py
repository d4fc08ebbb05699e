"""Registered queries over the driver tables, each with the SQL that says what it has to return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import file_queries
from .functions import scalar
from .operators import aggregates, candidates, vertex_program
from .operators.bloom import BloomFilter
from .operators.counter import conflict_count, count, tree_count
from .operators.graph import Graph, prepare
from .operators.matcher import match, prefixes
from .operators.materialise import cut
from .operators.rank import global_rank, ranked_lines
from .plans.pattern import Pattern
from .plans.planner import ORDERS, plan
from .plans.report import batch_report
from .sources.adjacency import parse_lines, to_lines, wrong_labels
from .sources.sinks import match_lines
from .sources.tables import CODES, EDGES, VERTICES, star_graph

PATTERNS = {
    "edge_cn": Pattern.of("cn", "01", "edge_cn"),
    "path_rnc": Pattern.of("rnc", "01 12", "path_rnc"),
    "path_cops": Pattern.of("cops", "01 12 23", "path_cops"),
    "star2_op": Pattern.of("opp", "01 02", "star2_op"),
    "star3_op": Pattern.of("oppp", "01 02 03", "star3_op"),
    "star2_ns": Pattern.of("nss", "01 02", "star2_ns"),
    "wedge_opo": Pattern.of("opo", "01 12", "wedge_opo"),
    "branch_rnsc": Pattern.of("rnsc", "01 12 13", "branch_rnsc"),
    "cycle5": Pattern.of("ncops", "01 12 23 34 40", "cycle5"),
    "cycle4_opop": Pattern.of("opop", "01 12 23 30", "cycle4_opop"),
    "bowtie": Pattern.of("copoc", "01 12 23 34", "bowtie"),
    "conf_coop": Pattern.of("coop", "01 02 23", "conf_coop"),
    "conf_psp": Pattern.of("opsp", "01 12 23", "conf_psp"),
}

#: The toy graph of the golden counts: labels by vertex, and undirected edges. Fixed values.
TOY_LABELS = {"a": (1, 7, 11), "b": (3, 5, 9, 12, 14), "c": (2, 4, 15), "d": (6, 8, 10, 13)}
TOY_EDGES = "1-2 1-4 1-5 2-3 2-5 3-4 3-5 3-13 4-5 4-9 6-7 6-9 6-10 7-8 7-10 7-11 8-9 8-10 9-10 11-12 11-14 11-15 12-13 12-15 13-14 13-15 14-15"


def toy_graph(spark: SparkSession) -> Graph:
    vertices = spark.createDataFrame([(v, a) for a, ids in TOY_LABELS.items() for v in ids], "vid bigint, label string")
    edges = spark.createDataFrame([tuple(map(int, e.split("-"))) for e in TOY_EDGES.split()], "src bigint, dst bigint")
    return Graph.from_edges(vertices, prepare(vertices, edges), sorted(TOY_LABELS))


# ---- SQL pieces ----


def _slice(a: str, b: str) -> str:
    turned = (a, b) not in EDGES
    name, x, y, _ = EDGES[(b, a) if turned else (a, b)]
    src, dst = (y, x) if turned else (x, y)
    return f"(SELECT DISTINCT {src}::BIGINT * {CODES} + {VERTICES[a][0]} AS src, {dst}::BIGINT * {CODES} + {VERTICES[b][0]} AS dst FROM {name})"


def _vertices(a: str) -> str:
    code, name, key = VERTICES[a]
    return f"(SELECT {key}::BIGINT * {CODES} + {code} AS vid, '{a}' AS label FROM {name})"


_ALL_EDGES = " UNION ALL ".join(f"SELECT src, dst, '{a}' AS src_label, '{b}' AS dst_label FROM {_slice(a, b)}" for a, b in [*EDGES, *[(b, a) for a, b in EDGES]])
_ALL_VERTICES = " UNION ALL ".join(f"SELECT * FROM {_vertices(a)}" for a in VERTICES)
_TOY = (
    "v(vid, label) AS (VALUES " + ", ".join(f"({v}::BIGINT, '{a}')" for a, ids in TOY_LABELS.items() for v in ids) + "), "
    "e0(src, dst) AS (VALUES " + ", ".join(f"({e.split('-')[0]}::BIGINT, {e.split('-')[1]}::BIGINT)" for e in TOY_EDGES.split()) + "), "
    "e AS (SELECT * FROM e0 UNION ALL SELECT dst, src FROM e0)"
)


def pattern_sql(p: Pattern, select: str, injective: bool = True) -> str:
    """Plain joins over all edges of the pattern, with <> between equal labels."""
    ids = list(p.labels)
    sources, where, homes = [], [], {}
    for i, e in enumerate(sorted(map(sorted, p.edges), key=lambda e: (ids.index(e[0]), ids.index(e[1])))):
        u, v = e
        sources.append(f"{_slice(p.labels[u], p.labels[v])} e{i}")
        for x, side in ((u, "src"), (v, "dst")):
            if x in homes:
                where.append(f"e{i}.{side} = {homes[x]}")
            else:
                homes[x] = f"e{i}.{side}"
    if injective:
        where += [f"{homes[u]} <> {homes[v]}" for i, u in enumerate(ids) for v in ids[:i] if p.labels[u] == p.labels[v]]
    cols = ", ".join(f"{homes[u]} AS {p.column(u)}" for u in ids)
    return f"SELECT {select if select != '*' else cols} FROM {', '.join(sources)}" + (f" WHERE {' AND '.join(where)}" if where else "")


def _listed(name: str):
    return lambda spark, sf: match(star_graph(spark, sf), plan(PATTERNS[name]))


def _counted(name: str, **how):
    return lambda spark, sf: count(star_graph(spark, sf), plan(PATTERNS[name]), **how)


# ---- queries ----


def degree_table(spark: SparkSession, sf: str) -> DataFrame:
    return star_graph(spark, sf).degree_table()


def label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return star_graph(spark, sf).label_histogram()


def pair_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return star_graph(spark, sf).pair_histogram()


def vertex_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = star_graph(spark, sf).neighbour_lists()
    return rows.select("vid", "label", "degree", F.array_join(F.transform("nbs", lambda n: F.concat(n["dst"].cast("string"), n["dst_label"])), " ").alias("nbs"))


def ldf_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf)
    return candidates.sizes(candidates.by_label_and_degree(g, PATTERNS["star3_op"]))


def refined_candidates(spark: SparkSession, sf: str) -> DataFrame:
    g, p = star_graph(spark, sf), PATTERNS["branch_rnsc"]
    return candidates.sizes(candidates.refine(g, p, candidates.by_label_and_degree(g, p), rounds=1))


def candidate_order(spark: SparkSession, sf: str) -> DataFrame:
    g, p = star_graph(spark, sf), PATTERNS["cycle5"]
    found = candidates.refine(g, p, candidates.by_label_and_degree(g, p), rounds=1)
    held = {r["query_vertex"]: r["candidates"] for r in candidates.sizes(found).collect()}
    return match(g, plan(p, "candidate", held), candidates=found)


def homomorphisms(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf)
    return count(g, plan(PATTERNS["cycle4_opop"]), injective=False)


def prefix_counts(spark: SparkSession, sf: str, upto: int = 3) -> DataFrame:
    """Distinct prefixes after each of the first `upto` vertices of path c-o-p-s in file order, of the columns still needed."""
    g = star_graph(spark, sf)
    out = None
    for i, (u, rows) in enumerate(prefixes(g, plan(PATTERNS["path_cops"], "file"), upto)):
        one = rows.agg(F.count("*").alias("prefixes")).select(F.lit(i).alias("place"), F.lit(u).alias("query_vertex"), "prefixes")
        out = one if out is None else out.unionByName(one)
    return out


def prefix_counts_whole(spark: SparkSession, sf: str) -> DataFrame:
    """prefix_counts() after all four vertices; the last one's rows are pairs (part, supplier), as nothing else is still needed."""
    return prefix_counts(spark, sf, 4)


def toy_cycle(spark: SparkSession, sf: str) -> DataFrame:
    return match(toy_graph(spark), plan(Pattern.of("acbc", "01 12 23 30")))


def toy_leaf_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return count(toy_graph(spark), plan(Pattern.of("cbbab", "01 02 03 34")))


def toy_edges_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Listed neighbours with a wrong label in three lines of text."""
    lines = spark.createDataFrame([("# graph",), ("1 a 2 b\t3 c",), ("2 b 1 a",), ("",), ("3 b 1 a",)], "value string")
    return wrong_labels(lines)


def global_rank_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    return global_rank(orders, ["o_totalprice", "o_orderkey"])


def ranked_content(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name")
    return ranked_lines(parts, ["p_name", "p_partkey"], F.col("p_name"))


def match_records(spark: SparkSession, sf: str) -> DataFrame:
    p = PATTERNS["path_rnc"]
    return match_lines(match(star_graph(spark, sf), plan(p)), p)


def report(spark: SparkSession, sf: str) -> DataFrame:
    names = ("edge_cn", "branch_rnsc", "star2_ns")
    return batch_report(spark, star_graph(spark, sf), [PATTERNS[n] for n in names], "dad", times=False)


def conflict_masks(spark: SparkSession, sf: str) -> DataFrame:
    return conflict_count(star_graph(spark, sf), plan(Pattern.of("nsss", "01 02 03")))


def order_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The same count whatever the order, with folding and merging on and off."""
    g, p = star_graph(spark, sf), PATTERNS["branch_rnsc"]
    out = None
    for order in ORDERS:
        held = dict.fromkeys(p.labels, 1) if order == "candidate" else None
        for folding in (True, False):
            one = count(g, plan(p, order, held), folding=folding, merging=folding).select(F.lit(order).alias("matching_order"), F.lit(folding).alias("folding"), "mapping_count")
            out = one if out is None else out.unionByName(one)
    return out


def trees(spark: SparkSession, sf: str) -> DataFrame:
    return tree_count(star_graph(spark, sf), plan(PATTERNS["conf_coop"]))


def least_reachable(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf)
    some = [("n", "r"), ("r", "n"), ("s", "n"), ("n", "s")]
    vertices = g.vertices("r").unionByName(g.vertices("n")).unionByName(g.vertices("s"))
    edges = None
    for a, b in some:
        edges = g.edges(a, b) if edges is None else edges.unionByName(g.edges(a, b))
    return vertex_program.least_reachable(vertices, edges, 3)


def least_reachable_whole(spark: SparkSession, sf: str, supersteps: int = 3) -> DataFrame:
    """least_reachable() over all vertices and edges."""
    g = star_graph(spark, sf)
    return vertex_program.least_reachable(g.all_vertices().select("vid"), g.all_edges().select("src", "dst"), supersteps)


def bloom_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Edges o-p that a filter over edges of returned lines lets through, then checked exactly; a null key is a key too."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    back = cut(lines.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct())
    sieve = BloomFilter.build(back, ["l_orderkey", "l_partkey"], back.count(), 0.01)
    return sieve.may_contain(lines.select("l_orderkey", "l_partkey"), ["l_orderkey", "l_partkey"]).intersect(back)


def text_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Graph to adjacency lines and back: edges by label pair."""
    _, listed = parse_lines(to_lines(star_graph(spark, sf)))
    vertices, _ = parse_lines(to_lines(star_graph(spark, sf)))
    return prepare(vertices, listed.select("src", "dst"), symmetrise=False).groupBy("src_label", "dst_label").agg(F.count("*").alias("n"))


def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    size = F.length("c_name")
    return c.select(
        "c_custkey",
        scalar.falling_factorial(F.col("c_nationkey").cast("bigint"), 3).alias("chosen"),
        scalar.all_different(F.array(F.col("c_nationkey").cast("bigint"), F.col("c_custkey") % 25)).alias("different"),
        scalar.not_contains(F.array(F.lit(1), F.lit(2), F.lit(3)), F.col("c_nationkey")).alias("missing"),
        scalar.owner(F.col("c_custkey"), 7).alias("worker"),
        scalar.parse_id(F.concat(F.col("c_custkey").cast("string"), F.lit("x"))).alias("id"),
        scalar.first_char(F.col("c_mktsegment")).alias("initial"),
        scalar.before([F.col("c_nationkey").cast("bigint"), F.col("c_custkey")], [size.cast("bigint"), F.lit(100).cast("bigint")]).alias("earlier"),
        scalar.conflict_mask([F.col("c_nationkey") > 10, F.col("c_custkey") % 2 == 0, F.col("c_acctbal") < 0]).alias("mask"),
    )


def whole_table_reductions(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return aggregates.reductions(c, F.col("c_custkey"), F.col("c_nationkey") == 3)


def user_aggregator(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("q", F.col("l_quantity").cast("bigint")).withColumn("n", F.col("l_linenumber").cast("bigint"))
    return aggregates.SumOfProducts("q", "n").over(lines, "l_returnflag").select("l_returnflag", "total", F.round("mean", 6).alias("mean"))


def wide_count(spark: SparkSession, sf: str) -> DataFrame:
    """A count in decimal(38,0), shown as text."""
    n = count(star_graph(spark, sf), plan(PATTERNS["star3_op"]), kind="decimal(38,0)")
    return n.select(F.col("mapping_count").cast("string").alias("mapping_count"))


QUERIES = {
    "m_edge_cn": _listed("edge_cn"),
    "m_path_rnc": _listed("path_rnc"),
    "c_path_cops": _counted("path_cops"),
    "c_star2_op": _counted("star2_op"),
    "c_star3_op": _counted("star3_op"),
    "m_star2_ns": _listed("star2_ns"),
    "c_wedge_opo": _counted("wedge_opo"),
    "m_branch_rnsc": _listed("branch_rnsc"),
    "m_cycle5": _listed("cycle5"),
    "m_cycle4_opop": _listed("cycle4_opop"),
    "c_bowtie": _counted("bowtie"),
    "c_conf_coop": _counted("conf_coop"),
    "c_conf_psp": _counted("conf_psp"),
    "c_cycle5": _counted("cycle5"),
    "c_wide_star": wide_count,
    "g_degree_table": degree_table,
    "g_label_histogram": label_histogram,
    "g_pair_histogram": pair_histogram,
    "g_vertex_values": vertex_values,
    "f_ldf_counts": ldf_counts,
    "f_refined_candidates": refined_candidates,
    "f_candidate_order": candidate_order,
    "f_bloom_semi_join": bloom_semi_join,
    "c_homomorphisms": homomorphisms,
    "p_prefix_counts": prefix_counts,
    "p_prefix_counts_whole": prefix_counts_whole,
    "t_toy_cycle": toy_cycle,
    "t_toy_leaf_conflict": toy_leaf_conflict,
    "t_wrong_labels": toy_edges_checked,
    "r_global_rank": global_rank_orders,
    "r_ranked_lines": ranked_content,
    "s_match_records": match_records,
    "s_text_round_trip": text_round_trip,
    "p_batch_report": report,
    "a_conflict_masks": conflict_masks,
    "a_tree_count": trees,
    "a_reductions": whole_table_reductions,
    "a_user_aggregator": user_aggregator,
    "p_order_comparison": order_comparison,
    "v_least_reachable": least_reachable,
    "v_least_reachable_whole": least_reachable_whole,
    "x_scalar_functions": scalar_functions,
}

_P = PATTERNS
_CN = lambda n: pattern_sql(_P[n], "count(*)::BIGINT AS mapping_count")
_REPORT = " UNION ALL ".join(
    f"SELECT {no}::INT AS query_no, '{order}' AS \"order\", {v}::INT AS vertices, {e}::INT AS edges, {d}::INT AS depth, {mb}::INT AS max_branch, {c}::INT AS conflicts, (SELECT count(*) FROM ({pattern_sql(_P[n], '*')}))::BIGINT AS mappings, ({t})::BIGINT AS trees, '{n}' AS filename"
    for no, n, v, e, per, t in (
        (0, "edge_cn", 2, 1, {"degree": (2, 0, 0), "anti-degree": (2, 0, 0)}, f"SELECT count(DISTINCT src) FROM {_slice('c', 'n')}"),
        (1, "branch_rnsc", 4, 3, {"degree": (2, 1, 0), "anti-degree": (3, 1, 0)}, f"SELECT count(DISTINCT a.src) FROM {_slice('n', 'r')} a, {_slice('n', 's')} b, {_slice('n', 'c')} c WHERE a.src = b.src AND a.src = c.src"),
        (2, "star2_ns", 3, 2, {"degree": (2, 1, 1), "anti-degree": (3, 0, 0)}, f"SELECT count(*) FROM (SELECT src FROM {_slice('n', 's')} GROUP BY src HAVING count(*) > 1)"),
    )
    for order, (d, mb, c) in per.items()
)

ORACLES = {
    "m_edge_cn": pattern_sql(_P["edge_cn"], "*"),
    "m_path_rnc": pattern_sql(_P["path_rnc"], "*"),
    "c_path_cops": _CN("path_cops"),
    "c_star2_op": _CN("star2_op"),
    "c_star3_op": _CN("star3_op"),
    "m_star2_ns": pattern_sql(_P["star2_ns"], "*"),
    "c_wedge_opo": _CN("wedge_opo"),
    "m_branch_rnsc": pattern_sql(_P["branch_rnsc"], "*"),
    "m_cycle5": pattern_sql(_P["cycle5"], "*"),
    "m_cycle4_opop": pattern_sql(_P["cycle4_opop"], "*"),
    "c_bowtie": _CN("bowtie"),
    "c_conf_coop": _CN("conf_coop"),
    "c_conf_psp": f"SELECT sum(a.n * (b.m - 1))::BIGINT AS mapping_count FROM (SELECT src, dst FROM {_slice('p', 's')}) x JOIN (SELECT src, count(*) AS n FROM {_slice('p', 'o')} GROUP BY src) a ON x.src = a.src JOIN (SELECT src, count(*) AS m FROM {_slice('s', 'p')} GROUP BY src) b ON x.dst = b.src",
    "c_cycle5": _CN("cycle5"),
    "c_wide_star": pattern_sql(_P["star3_op"], "count(*)::VARCHAR AS mapping_count"),
    "g_degree_table": f"SELECT src AS vid, src_label AS label, dst_label AS nbr_label, count(*)::BIGINT AS deg FROM ({_ALL_EDGES}) GROUP BY ALL",
    "g_label_histogram": f"SELECT label, count(*)::BIGINT AS n FROM ({_ALL_VERTICES}) GROUP BY label",
    "g_pair_histogram": f"SELECT src_label, dst_label, count(*)::BIGINT AS n FROM ({_ALL_EDGES}) GROUP BY ALL",
    "g_vertex_values": f"SELECT vid, label, coalesce(degree, 0)::BIGINT AS degree, coalesce(nbs, '') AS nbs FROM ({_ALL_VERTICES}) LEFT JOIN (SELECT src AS vid, count(*) AS degree, string_agg(dst::VARCHAR || dst_label, ' ' ORDER BY dst) AS nbs FROM ({_ALL_EDGES}) GROUP BY src) USING (vid)",
    "f_ldf_counts": f"SELECT q AS query_vertex, (SELECT count(*) FROM (SELECT src FROM ({_ALL_EDGES}) WHERE src_label = l GROUP BY src HAVING count(*) >= k))::BIGINT AS candidates FROM (VALUES (0, 'o', 3), (1, 'p', 1), (2, 'p', 1), (3, 'p', 1)) t(q, l, k)",
    "f_refined_candidates": f"""
WITH e AS ({_ALL_EDGES}), d AS (SELECT src AS vid, src_label AS label, count(*) AS deg FROM e GROUP BY ALL),
r0 AS (SELECT vid FROM d WHERE label = 'r' AND deg >= 1), n0 AS (SELECT vid FROM d WHERE label = 'n' AND deg >= 3),
s0 AS (SELECT vid FROM d WHERE label = 's' AND deg >= 1), c0 AS (SELECT vid FROM d WHERE label = 'c' AND deg >= 1),
r1 AS (SELECT vid FROM r0 WHERE vid IN (SELECT src FROM e JOIN n0 ON dst = n0.vid)),
n1 AS (SELECT vid FROM n0 WHERE vid IN (SELECT src FROM e JOIN r1 ON dst = r1.vid) AND vid IN (SELECT src FROM e JOIN s0 ON dst = s0.vid) AND vid IN (SELECT src FROM e JOIN c0 ON dst = c0.vid)),
s1 AS (SELECT vid FROM s0 WHERE vid IN (SELECT src FROM e JOIN n1 ON dst = n1.vid)), c1 AS (SELECT vid FROM c0 WHERE vid IN (SELECT src FROM e JOIN n1 ON dst = n1.vid))
SELECT 0 AS query_vertex, count(*)::BIGINT AS candidates FROM r1 UNION ALL SELECT 1, count(*) FROM n1 UNION ALL SELECT 2, count(*) FROM s1 UNION ALL SELECT 3, count(*) FROM c1""",
    "f_candidate_order": pattern_sql(_P["cycle5"], "*"),
    "f_bloom_semi_join": "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'",
    "c_homomorphisms": pattern_sql(_P["cycle4_opop"], "count(*)::BIGINT AS mapping_count", injective=False),
    "p_prefix_counts": f"SELECT 0 AS place, 0 AS query_vertex, count(*)::BIGINT AS prefixes FROM {_vertices('c')} UNION ALL SELECT 1, 1, count(DISTINCT dst) FROM {_slice('c', 'o')} UNION ALL SELECT 2, 2, count(DISTINCT b.dst) FROM {_slice('c', 'o')} a JOIN {_slice('o', 'p')} b ON a.dst = b.src",
    "p_prefix_counts_whole": f"SELECT 0 AS place, 0 AS query_vertex, count(*)::BIGINT AS prefixes FROM {_vertices('c')} UNION ALL SELECT 1, 1, count(DISTINCT dst) FROM {_slice('c', 'o')} UNION ALL SELECT 2, 2, count(DISTINCT b.dst) FROM {_slice('c', 'o')} a JOIN {_slice('o', 'p')} b ON a.dst = b.src UNION ALL SELECT 3, 3, count(DISTINCT (x.src, x.dst)) FROM {_slice('c', 'o')} a JOIN {_slice('o', 'p')} b ON a.dst = b.src JOIN {_slice('p', 's')} x ON b.dst = x.src",
    "t_toy_cycle": f"WITH {_TOY} SELECT e1.src AS u_0, e1.dst AS u_1, e2.dst AS u_2, e3.dst AS u_3 FROM e e1 JOIN e e2 ON e1.dst = e2.src JOIN e e3 ON e2.dst = e3.src JOIN e e4 ON e3.dst = e4.src AND e4.dst = e1.src JOIN v v0 ON v0.vid = e1.src JOIN v v1 ON v1.vid = e1.dst JOIN v v2 ON v2.vid = e2.dst JOIN v v3 ON v3.vid = e3.dst WHERE v0.label = 'a' AND v1.label = 'c' AND v2.label = 'b' AND v3.label = 'c' AND e1.dst <> e3.dst",
    "t_toy_leaf_conflict": f"WITH {_TOY} SELECT count(*)::BIGINT AS mapping_count FROM e e1 JOIN e e2 ON e1.src = e2.src JOIN e e3 ON e1.src = e3.src JOIN e e4 ON e3.dst = e4.src JOIN v v0 ON v0.vid = e1.src JOIN v v1 ON v1.vid = e1.dst JOIN v v2 ON v2.vid = e2.dst JOIN v v3 ON v3.vid = e3.dst JOIN v v4 ON v4.vid = e4.dst WHERE v0.label = 'c' AND v1.label = 'b' AND v2.label = 'b' AND v3.label = 'a' AND v4.label = 'b' AND e1.dst <> e2.dst AND e1.dst <> e4.dst AND e2.dst <> e4.dst",
    "t_wrong_labels": "SELECT 1::BIGINT AS src, 3::BIGINT AS dst, 'c' AS dst_label, 'b' AS label",
    "r_global_rank": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders",
    "r_ranked_lines": "SELECT (row_number() OVER (ORDER BY p_name, p_partkey) - 1)::VARCHAR || ' ' || p_name AS value FROM part",
    "s_match_records": f"SELECT '# Match' || chr(10) || '0 ' || u_0 || chr(10) || '1 ' || u_1 || chr(10) || '2 ' || u_2 AS value FROM ({pattern_sql(_P['path_rnc'], '*')})",
    "s_text_round_trip": f"SELECT src_label, dst_label, count(*)::BIGINT AS n FROM ({_ALL_EDGES}) GROUP BY ALL",
    "p_batch_report": _REPORT,
    "a_conflict_masks": f"SELECT ((a.dst = b.dst)::INT + 2 * (a.dst = c.dst)::INT + 4 * (b.dst = c.dst)::INT)::BIGINT AS mask, count(*)::BIGINT AS mappings FROM {_slice('n', 's')} a, {_slice('n', 's')} b, {_slice('n', 's')} c WHERE a.src = b.src AND a.src = c.src GROUP BY 1",
    "a_tree_count": f"SELECT count(*)::BIGINT AS trees FROM {_slice('c', 'o')} a JOIN (SELECT src, count(*) AS n FROM {_slice('c', 'o')} GROUP BY src) b ON a.src = b.src JOIN (SELECT DISTINCT src FROM {_slice('o', 'p')}) p ON a.dst = p.src WHERE n > 1",
    "a_reductions": "SELECT sum(c_custkey)::BIGINT AS total, bit_or(c_custkey)::BIGINT AS bits, bool_or(c_nationkey = 3) AS \"any\" FROM customer",
    "a_user_aggregator": "SELECT l_returnflag, sum(l_quantity::BIGINT * l_linenumber)::BIGINT AS total, round(sum(l_quantity::BIGINT * l_linenumber)::DOUBLE / count(*), 6) AS mean FROM lineitem GROUP BY 1",
    "p_order_comparison": " UNION ALL ".join(f"SELECT '{o}' AS matching_order, {f} AS folding, (SELECT count(*) FROM ({pattern_sql(_P['branch_rnsc'], '*')}))::BIGINT AS mapping_count" for o in ORDERS for f in ("true", "false")),
    "v_least_reachable": f"""
WITH v AS (SELECT vid FROM {_vertices('r')} UNION ALL SELECT vid FROM {_vertices('n')} UNION ALL SELECT vid FROM {_vertices('s')}),
e AS (SELECT src, dst FROM ({_ALL_EDGES}) WHERE src_label IN ('r', 'n', 's') AND dst_label IN ('r', 'n', 's')),
a AS (SELECT vid, least(vid, coalesce((SELECT min(src) FROM e WHERE dst = vid), vid)) AS least FROM v)
SELECT vid, least(least, coalesce((SELECT min(b.least) FROM e JOIN a b ON e.src = b.vid WHERE e.dst = a.vid), least)) AS least FROM a""",
    "v_least_reachable_whole": f"""
WITH v AS (SELECT vid FROM ({_ALL_VERTICES})),
e AS (SELECT src, dst FROM ({_ALL_EDGES}) UNION ALL SELECT vid, vid FROM v),
a AS (SELECT e.dst AS vid, min(e.src) AS least FROM e JOIN v ON v.vid = e.dst GROUP BY 1)
SELECT e.dst AS vid, min(a.least) AS least FROM e JOIN a ON e.src = a.vid JOIN v ON v.vid = e.dst GROUP BY 1""",
    "x_scalar_functions": "SELECT c_custkey, CASE WHEN c_nationkey < 3 THEN 0 ELSE c_nationkey::BIGINT * (c_nationkey - 1) * (c_nationkey - 2) END AS chosen, c_nationkey <> c_custkey % 25 AS different, c_nationkey NOT IN (1, 2, 3) AS missing, (c_custkey % 7)::INT AS worker, c_custkey AS id, substr(c_mktsegment, 1, 1) AS initial, (c_nationkey < length(c_name) OR (c_nationkey = length(c_name) AND c_custkey < 100)) AS earlier, ((c_nationkey > 10)::INT + 2 * (c_custkey % 2 = 0)::INT + 4 * (c_acctbal < 0)::INT)::BIGINT AS mask FROM customer",
}

QUERIES |= file_queries.QUERIES
ORACLES |= file_queries.oracles(pattern_sql, _slice, ORACLES["g_pair_histogram"])
