"""A graph over relational tables: key columns become vertices and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph

#: label -> (code, table, key column); vid = key * CODES + code.
CODES = 8
VERTICES = {
    "r": (0, "region", "r_regionkey"),
    "n": (1, "nation", "n_nationkey"),
    "c": (2, "customer", "c_custkey"),
    "s": (3, "supplier", "s_suppkey"),
    "o": (4, "orders", "o_orderkey"),
    "p": (5, "part", "p_partkey"),
}
#: (label, label) -> (table, key column of each); is the first the table's key, so that it has one row and one such neighbour?
EDGES = {
    ("n", "r"): ("nation", "n_nationkey", "n_regionkey", True),
    ("c", "n"): ("customer", "c_custkey", "c_nationkey", True),
    ("s", "n"): ("supplier", "s_suppkey", "s_nationkey", True),
    ("o", "c"): ("orders", "o_orderkey", "o_custkey", True),
    ("o", "p"): ("lineitem", "l_orderkey", "l_partkey", False),
    ("p", "s"): ("lineitem", "l_partkey", "l_suppkey", False),
}


def vid(column: str, label: str):
    return F.col(column).cast("bigint") * CODES + VERTICES[label][0]


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, orders and parts; a slice reads the two columns it needs."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def vertices(label: str) -> DataFrame:
        _, name, key = VERTICES[label]
        return read(name).select(vid(key, label).alias("vid"))

    def slices(a: str, b: str) -> DataFrame:
        if (a, b) not in EDGES and (b, a) not in EDGES:
            return spark.createDataFrame([], "src bigint, dst bigint")
        turned = (a, b) not in EDGES
        name, x, y, unique = EDGES[(b, a) if turned else (a, b)]
        src, dst = (y, x) if turned else (x, y)
        rows = read(name).filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(vid(src, a).alias("src"), vid(dst, b).alias("dst"))
        return rows if unique else rows.distinct()

    def all_vertices() -> DataFrame:
        out = None
        for label in VERTICES:
            one = vertices(label).select("vid", F.lit(label).alias("label"))
            out = one if out is None else out.unionByName(one)
        return out

    def all_edges() -> DataFrame:
        """Each table's pairs made distinct once, then turned both ways."""
        out = None
        for a, b in EDGES:
            ways = [F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.lit(p).alias("src_label"), F.lit(q).alias("dst_label")) for x, y, p, q in (("src", "dst", a, b), ("dst", "src", b, a))]
            one = slices(a, b).select(F.inline(F.array(*ways)))
            out = one if out is None else out.unionByName(one)
        return out

    return Graph(vertices, slices, all_vertices, all_edges, list(VERTICES), [*EDGES, *[(b, a) for a, b in EDGES]], single={pair for pair, (*_, unique) in EDGES.items() if unique})
