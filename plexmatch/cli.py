"""Command line: count or list a pattern's mappings in a graph given as adjacency text."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators.candidates import by_label_and_degree, refine, sizes
from .operators.counter import count
from .operators.matcher import match
from .plans.planner import orders_of, plan
from .sources.adjacency import read_graph
from .sources.patterns import read_patterns
from .sources.sinks import write_mappings


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="plexmatch", description=__doc__)
    p.add_argument("-d", "--data", required=True, help="graph: adjacency text, any path Spark reads")
    p.add_argument("-q", "--query", required=True, help="pattern file or directory")
    p.add_argument("-out", "--out", help="write the mappings there")
    p.add_argument("-input", "--input", choices=("local", "spark"), default="local", help="where the pattern is read from")
    p.add_argument("-report", "--report", choices=("short", "long"), default="short")
    p.add_argument("-order", "--order", default="degree")
    p.add_argument("-preprocess", "--preprocess", choices=("on", "off"), default="on", help="keep the prepared edges in memory")
    p.add_argument("-filter", "--filter", choices=("on", "off"), default="off", help="refine candidates before listing")
    p.add_argument("-pseudo", "--pseudo", choices=("on", "off"), default="on", help="fold leaves when counting")
    p.add_argument("-leaf", "--leaf", choices=("on", "off"), default="on", help="accepted for old command lines; leaves are folded by -pseudo")
    p.add_argument("-other", "--other", choices=("on", "off"), default="on", help="accepted for old command lines; without effect")
    p.add_argument("--labels", choices=("first_char", "full"), default="first_char")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("plexmatch").getOrCreate()
    began = time.perf_counter()
    graph = read_graph(spark, a.data, a.labels)
    if a.preprocess == "on":
        graph.persist()
    if a.report == "long":
        print(f"options: {vars(a)}")
        print(f"vertices: {graph.all_vertices().count()}, edges: {graph.all_edges().count()}, loaded in {time.perf_counter() - began:.2f} s")
    for pattern in read_patterns(a.query, spark if a.input == "spark" else None, a.labels):
        for order in orders_of(a.order):
            began = time.perf_counter()  # of this pattern and order
            candidates = refine(graph, pattern, by_label_and_degree(graph, pattern)) if a.filter == "on" or order == "candidate" else None
            held = {r["query_vertex"]: r["candidates"] for r in sizes(candidates).collect()} if order == "candidate" else None
            the_plan = plan(pattern, order, held)
            if a.report == "long":
                print(the_plan.describe())
                print(the_plan.properties())
            if a.out:
                write_mappings(match(graph, the_plan, candidates=candidates), pattern, a.out)
            total = count(graph, the_plan, folding=a.pseudo == "on").first()["mapping_count"]
            print(f"{pattern.name} {order}: Mapping count = {total} ({time.perf_counter() - began:.2f} s)")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
