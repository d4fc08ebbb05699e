"""Twins: query vertices of one label that have the same two neighbours, found by meeting in the middle.

A 4-cycle is two twins between two corners. Expanding a path around it and testing the last edge lists
every path of three edges; wedges (corner, twin, corner) listed once and joined on both corners list
only what closes, and a count needs no more than the number of wedges of each pair of corners.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..plans.planner import Plan
from .graph import Graph


@dataclass(frozen=True)
class Twins:
    corners: tuple[int, int]
    label: str
    members: tuple[int, ...]


def twins_of(graph: Graph, pattern: Pattern, apart: set[int] = frozenset()) -> Twins | None:
    """The largest group of two twins or more between corners that no edge joins; none of them in `apart`.

    Among groups of one size the label with the most vertices is taken: its vertices have fewer
    neighbours each, hence there are fewer wedges.
    """
    found: dict[tuple[tuple[int, int], str], list[int]] = {}
    for u in pattern.labels:
        if pattern.degree(u) == 2 and u not in apart and not pattern.has_edge(*pattern.neighbours[u]):
            found.setdefault((pattern.neighbours[u], pattern.labels[u]), []).append(u)
    groups = [Twins(corners, label, tuple(members)) for (corners, label), members in found.items() if len(members) > 1]
    most = [g for g in groups if len(g.members) == max(len(x.members) for x in groups)]
    if len({g.label for g in most}) > 1:
        size = {label: graph.vertices(label).count() for label in {g.label for g in most}}
        most.sort(key=lambda g: -size[g.label])
    return most[0] if most else None


def wedges(graph: Graph, pattern: Pattern, g: Twins, injective: bool) -> DataFrame:
    """(_a, _m, _b): every middle vertex with two neighbours that fit the corners."""
    a, b = (pattern.labels[u] for u in g.corners)
    left = graph.edges(g.label, a).select(F.col("src").alias("_m"), F.col("dst").alias("_a"))
    right = graph.edges(g.label, b).select(F.col("src").alias("_n"), F.col("dst").alias("_b"))
    on = F.col("_m") == F.col("_n")
    if injective and a == b:
        on = on & (F.col("_a") != F.col("_b"))
    return left.join(right, on).select("_a", "_m", "_b")


def plan_around(pattern: Pattern, g: Twins, also: tuple[int, ...] = ()) -> Plan:
    """A plan that has the corners (and `also`) placed first, then every other vertex but the twins next to a placed one."""
    order, parent = [*g.corners, *also], dict.fromkeys([*g.corners, *also])
    rest = [u for u in pattern.labels if u not in g.members and u not in order]
    while rest:
        u = next(u for u in rest if any(v in parent and v not in g.members for v in pattern.neighbours[u]))
        parent[u] = next(v for v in order if v not in g.members and pattern.has_edge(u, v))
        order.append(u)
        rest.remove(u)
    return Plan(pattern, tuple(order), parent, dict.fromkeys(order, 0))


def listed(graph: Graph, pattern: Pattern, g: Twins) -> DataFrame:
    """Corners and twins as columns, all different where labels are equal.

    Only pairs of corners with enough wedges go on, and those collect their middles: k twins make at
    least n (n - 1) rows of n middles, so an array is never what is too large.
    """
    all_wedges = wedges(graph, pattern, g, True)
    enough = all_wedges.groupBy("_a", "_b").agg(F.count("*").alias("n")).filter(F.col("n") >= len(g.members)).select("_a", "_b")
    middles = all_wedges.join(enough, ["_a", "_b"], "left_semi").groupBy("_a", "_b").agg(F.collect_list("_m").alias("_all"))
    a, b = (pattern.column(u) for u in g.corners)
    out = middles.select(F.col("_a").alias(a), F.col("_b").alias(b), "_all")
    for i, u in enumerate(g.members):
        out = out.withColumn(pattern.column(u), F.explode("_all"))
        for v in g.members[:i]:
            out = out.filter(F.col(pattern.column(u)) != F.col(pattern.column(v)))
    return out.drop("_all")
