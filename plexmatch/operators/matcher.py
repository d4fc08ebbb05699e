"""Enumeration: a plan compiled to joins, one column for each query vertex."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import Plan
from .graph import Graph
from .materialise import cut
from .twins import listed, plan_around, twins_of

TASK_ROWS = 1 << 22  # a key of which a join makes more rows is dealt to several tasks


def place(partial: DataFrame, graph: Graph, the_plan: Plan, u: int, injective: bool = True, candidates: dict[int, DataFrame] | None = None, keep: set[int] | None = None, dealt: bool = False) -> DataFrame:
    """Add the column of vertex u: expand the tree edge, keep it apart from rivals, test back edges.

    keep: vertices to compare u with, where some columns have been dropped already. dealt: see _deal().
    """
    pattern, label, parent = the_plan.pattern, the_plan.pattern.labels, the_plan.parent[u]
    mine, above = pattern.column(u), pattern.column(parent)
    step = graph.edges(label[parent], label[u]).select(F.col("src").alias("_from"), F.col("dst").alias(mine))
    if candidates and u in candidates:
        step = step.join(candidates[u].select(F.col("vid").alias(mine)), mine, "left_semi")
    on, backs = F.col(above) == F.col("_from"), the_plan.back_edges(u)
    for v in [v for v in backs if (label[u], label[v]) in graph.single]:
        # the step's rows take their one such neighbour along, so that only what closes is joined at all
        step = step.join(graph.edges(label[u], label[v]).select(F.col("src").alias(mine), F.col("dst").alias(f"_back_{v}")), mine)
        on, backs = on & (F.col(pattern.column(v)) == F.col(f"_back_{v}")), [x for x in backs if x != v]
    if injective:
        for v in the_plan.rivals(u):
            if keep is None or v in keep:
                on = on & (F.col(pattern.column(v)) != F.col(mine))
    if dealt and (both := _deal(partial, step, above)):
        (partial, step), on = both, on & (F.col("_share") == F.col("_copy"))
    out = partial.join(step, on).drop("_from", "_share", "_copy", *[f"_back_{v}" for v in the_plan.back_edges(u)])
    for v in backs:
        edge = graph.edges(label[v], label[u]).select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
        out = out.join(edge, (F.col(pattern.column(v)) == F.col("_a")) & (F.col(mine) == F.col("_b")), "left_semi")
    return out


def _deal(partial: DataFrame, step: DataFrame, above: str) -> tuple[DataFrame, DataFrame] | None:
    """Both sides of a join on `above` and _from, dealt by the rows it makes; None if no key makes many.

    A key of a rows and b rows makes a b, however few bytes a and b are. Where that is over TASK_ROWS,
    its rows in `partial` are dealt to shares (_share), and each share meets a copy of its rows in
    `step` (_copy).
    """
    sizes = partial.groupBy(F.col(above).alias("_key")).agg(F.count("*").alias("_a")).join(step.groupBy(F.col("_from").alias("_key")).agg(F.count("*").alias("_b")), "_key")
    shares = F.least(F.col("_a"), F.ceil(F.col("_a").cast("double") * F.col("_b") / TASK_ROWS))
    hubs = cut(sizes.select("_key", shares.alias("_n")).filter("_n > 1"))  # one for every TASK_ROWS rows of the result at most
    total = hubs.agg(F.sum("_n")).first()[0]
    if not total:
        return None
    tasks = max(int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 2)
    hubs, n = F.broadcast(hubs), F.coalesce("_n", F.lit(1))
    share = F.pmod(F.xxhash64(*partial.columns), n)
    left = partial.join(hubs, F.col(above) == F.col("_key"), "left").select(*partial.columns, share.alias("_share"))
    right = step.join(hubs, F.col("_from") == F.col("_key"), "left").select(*step.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("_copy"))
    return left.repartition(tasks, above, "_share"), right.repartition(tasks, "_from", "_copy")


def _leaves_last(graph: Graph, the_plan: Plan) -> tuple[Plan, set[int]]:
    """The plan with its leaves placed last, and those of them that meet rows a sibling has multiplied.

    Leaves that a vertex has one of at most come first. Of the others the label with most vertices
    does, so that the last join runs through the shorter lists, which files keep small.
    """
    pattern, leaves = the_plan.pattern, the_plan.pseudo_children()
    many = [u for u in leaves if (pattern.labels[the_plan.parent[u]], pattern.labels[u]) not in graph.single]
    again = {u for u in many if sum(the_plan.parent[v] == the_plan.parent[u] for v in many) > 1}
    if not again:
        return the_plan, again
    size = {label: graph.vertices(label).count() for label in {pattern.labels[u] for u in many}}
    last = [u for u in leaves if u not in many] + sorted(many, key=lambda u: -size[pattern.labels[u]])
    first = {the_plan.parent[u]: u for u in reversed(last) if u in again}
    order = [u for u in the_plan.order if u not in leaves] + last
    return replace(the_plan, order=tuple(order)), again - set(first.values())


def root(graph: Graph, the_plan: Plan, candidates: dict[int, DataFrame] | None = None) -> DataFrame:
    u = the_plan.order[0]
    source = candidates[u] if candidates and u in candidates else graph.vertices(the_plan.pattern.labels[u])
    return source.select(F.col("vid").alias(the_plan.pattern.column(u)))


def match(graph: Graph, the_plan: Plan, injective: bool = True, candidates: dict[int, DataFrame] | None = None, meet: bool = True) -> DataFrame:
    """Every mapping as a row, columns u_<id> in the pattern's order; injective=False: homomorphisms.

    meet: list twins (see there) by joining wedges on their corners, whatever the plan's order; the
    other vertices are placed next to them. Not for homomorphisms, of which every wedge closes.
    """
    pattern = the_plan.pattern
    twins = twins_of(graph, pattern) if meet and injective and not candidates else None
    if twins:
        out, the_plan = listed(graph, pattern, twins), plan_around(pattern, twins, twins.members)
        first = 2 + len(twins.members)
        dealt = set()
    else:
        the_plan, dealt = _leaves_last(graph, the_plan)
        out, first = root(graph, the_plan, candidates), 1
    for u in the_plan.order[first:]:
        out = place(out, graph, the_plan, u, injective, candidates, dealt=u in dealt)
    return out.select(*[pattern.column(u) for u in pattern.labels])


def prefixes(graph: Graph, the_plan: Plan, upto: int) -> list[tuple[int, DataFrame]]:
    """After each of the first `upto` vertices: the distinct partial mappings, of the columns later steps need."""
    out, found = root(graph, the_plan), []
    for i, u in enumerate(the_plan.order[:upto]):
        if i:
            out = place(out, graph, the_plan, u)
        out = out.select(*[the_plan.pattern.column(v) for v in needed(the_plan, i)]).distinct() if i + 1 < len(the_plan.order) else out
        found.append((u, out))
    return found


def needed(the_plan: Plan, i: int) -> list[int]:
    """Of the vertices placed up to place i, those a later one is joined to, tested against or compared with."""
    later = the_plan.order[i + 1 :]
    wanted = {the_plan.parent[v] for v in later} | {x for v in later for x in the_plan.back_edges(v)} | {x for v in later for x in the_plan.rivals(v)}
    return [u for u in the_plan.order[: i + 1] if u in wanted]
