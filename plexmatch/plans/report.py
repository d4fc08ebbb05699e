"""Reports: one query, or many queries under several orders."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..operators.counter import count, tree_count
from ..operators.graph import Graph
from .pattern import Pattern
from .planner import orders_of, plan

PLAIN = "query_no int, order string, vertices int, edges int, depth int, max_branch int, conflicts int, mappings bigint, trees bigint, filename string"
TIMES = "plan_time double, compute_time double, match_time double, enum_time double, comm_time double, total_time double"


def batch(graph: Graph, patterns: list[Pattern], order: str = "default", times: bool = True) -> list[dict]:
    """A row for each pattern and order, times in seconds.

    match_time is that of finding the trees of the factorised result, enum_time that of counting the
    mappings they stand for, compute_time the sum of both. comm_time is null: Spark overlaps exchange
    and computation, so there is no such share of the time.
    """
    rows = []
    for no, pattern in enumerate(patterns):
        for one in orders_of(order):
            t0 = time.perf_counter()
            p = plan(pattern, one)
            t1 = time.perf_counter()
            n = count(graph, p).first()["mapping_count"]
            t2 = time.perf_counter()
            trees = tree_count(graph, p).first()["trees"]
            t3 = time.perf_counter()
            row = {"query_no": no, "order": one, **p.properties(), "mappings": n, "trees": trees, "filename": pattern.name}
            rows.append(row | ({"plan_time": t1 - t0, "compute_time": t3 - t1, "match_time": t3 - t2, "enum_time": t2 - t1, "comm_time": None, "total_time": t3 - t0} if times else {}))
    return rows


def batch_report(spark: SparkSession, graph: Graph, patterns: list[Pattern], order: str = "default", times: bool = True) -> DataFrame:
    schema = PLAIN + (", " + TIMES if times else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in batch(graph, patterns, order, times)], schema)


def summary(rows: list[dict]) -> dict:
    """Average compute time and all mappings over a batch."""
    return {"average_time": sum(r["compute_time"] for r in rows) / len(rows) if rows else 0.0, "mappings": sum(r["mappings"] for r in rows)}
