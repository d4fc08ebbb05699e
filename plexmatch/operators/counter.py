"""Counting without listing: leaves folded into degrees, dropped columns summed away.

A leaf group is the leaves of one label at one core vertex. It contributes the falling factorial of
its size over the image's neighbours of that label, less the core vertices of that label that are
such neighbours: those joined to it in the pattern always are, others are looked up. That is exact if
no folded group at another vertex has the label, so for each label one vertex's leaves are folded and
other leaves stay in the core. The core is joined step by step; a column that nothing later needs is
dropped and equal rows are merged into one with their sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import falling_factorial
from ..plans.pattern import Pattern
from ..plans.planner import Plan, plan
from .graph import Graph
from .matcher import match, needed, place, root
from .twins import Twins, plan_around, twins_of, wedges


@dataclass(frozen=True)
class LeafGroup:
    parent: int
    label: str
    size: int


def fold(pattern: Pattern, first: int, injective: bool = True) -> tuple[list[int], list[LeafGroup]]:
    """(core vertices, leaf groups). first: the vertex to keep when both ends of an edge are leaves."""
    groups: dict[tuple[int, str], list[int]] = {}
    for u in pattern.labels:
        if pattern.degree(u) == 1 and len(pattern.labels) > 1 and not (len(pattern.labels) == 2 and u == first):
            groups.setdefault((pattern.neighbours[u][0], pattern.labels[u]), []).append(u)
    if injective:
        best: dict[str, tuple[int, str]] = {}
        for key, leaves in groups.items():
            if key[1] not in best or len(leaves) > len(groups[best[key[1]]]):
                best[key[1]] = key
        groups = {k: v for k, v in groups.items() if best[k[1]] == k}
    folded = {u for v in groups.values() for u in v}
    return [u for u in pattern.labels if u not in folded], [LeafGroup(p, label, len(v)) for (p, label), v in groups.items()]


def core_pattern(pattern: Pattern, core: list[int]) -> Pattern:
    return Pattern({u: pattern.labels[u] for u in core}, frozenset(e for e in pattern.edges if e <= set(core)), pattern.name)


def _strangers(pattern: Pattern, g: LeafGroup) -> list[int]:
    """Core vertices of the group's label that may or may not be neighbours of its parent's image."""
    return [x for x in pattern.labels if pattern.labels[x] == g.label and x != g.parent and not pattern.has_edge(x, g.parent)]


def _weigh(rows: DataFrame, graph: Graph, core: Pattern, g: LeafGroup, kind: str, injective: bool) -> DataFrame:
    """Multiply cnt by the group's number of ways; rows without a way go."""
    label = core.labels[g.parent]
    degrees = graph.degrees(label, g.label).select(F.col("src").alias("_v"), F.col("deg").alias("_deg"))
    rows = rows.join(degrees, F.col(core.column(g.parent)) == F.col("_v")).drop("_v")
    free = F.col("_deg")
    if injective:
        free = free - sum(core.has_edge(x, g.parent) and core.labels[x] == g.label for x in core.labels)
        for x in _strangers(core, g):
            edge = graph.edges(label, g.label).select(F.col("src").alias("_a"), F.col("dst").alias("_b"), F.lit(1).alias(f"_near_{x}"))
            rows = rows.join(edge, (F.col(core.column(g.parent)) == F.col("_a")) & (F.col(core.column(x)) == F.col("_b")), "left").drop("_a", "_b")
            free = free - F.coalesce(F.col(f"_near_{x}"), F.lit(0))
        ways = falling_factorial(free, g.size, kind)
    else:
        ways = F.lit(1).cast(kind)
        for _ in range(g.size):
            ways = (ways * free.cast(kind)).cast(kind)
    near = [f"_near_{x}" for x in _strangers(core, g)] if injective else []
    return rows.withColumn("cnt", (F.col("cnt") * ways).cast(kind)).filter("cnt > 0").drop("_deg", *near)


def _foldable_twins(graph: Graph, small: Pattern, groups: list[LeafGroup], injective: bool) -> Twins | None:
    """Twins of the core that can be counted from the number of wedges of each pair of corners alone.

    As for leaves: where mappings are injective, no folded leaf may have their label, and every other
    core vertex of that label has to be a neighbour of both corners.
    """
    twins = twins_of(graph, small, {g.parent for g in groups})
    if twins and injective:
        others = [x for x in small.labels if small.labels[x] == twins.label and x not in twins.members and x not in twins.corners]
        if any(g.label == twins.label for g in groups) or any(not small.has_edge(x, c) for x in others for c in twins.corners):
            return None
    return twins


def _corner_pairs(graph: Graph, small: Pattern, twins: Twins, kind: str, injective: bool) -> DataFrame:
    """The corners' columns and cnt, the number of ways to choose the twins."""
    a, b = (small.column(u) for u in twins.corners)
    rows = wedges(graph, small, twins, injective).groupBy(F.col("_a").alias(a), F.col("_b").alias(b)).agg(F.count("*").alias("_deg"))
    free, size = F.col("_deg"), len(twins.members)
    if injective:
        corners = set(twins.corners)
        free = free - sum(x not in twins.members and corners <= set(small.neighbours[x]) and small.labels[x] == twins.label for x in small.labels)
        ways = falling_factorial(free, size, kind)
    else:
        ways = F.lit(1).cast(kind)
        for _ in range(size):
            ways = (ways * free.cast(kind)).cast(kind)
    return rows.select(a, b, ways.alias("cnt")).filter("cnt > 0")


def count(graph: Graph, the_plan: Plan, injective: bool = True, folding: bool = True, merging: bool = True, kind: str = "bigint", order: str = "degree") -> DataFrame:
    """One row, mapping_count. kind: bigint, or decimal(38,0) where counts may pass 2**63."""
    pattern = the_plan.pattern
    if folding:
        core, groups = fold(pattern, the_plan.order[0], injective)
        small = core_pattern(pattern, core)
        inner = plan(small, order) if set(core) != set(pattern.labels) else the_plan
    else:
        groups, small, inner = [], pattern, the_plan
    if not folding and not merging:
        return match(graph, the_plan, injective).agg(F.count("*").cast(kind).alias("mapping_count"))

    twins = _foldable_twins(graph, small, groups, injective) if folding and merging else None
    if twins:
        inner, first = plan_around(small, twins), 2
        rows = _corner_pairs(graph, small, twins, kind, injective)
    else:
        first, rows = 1, root(graph, inner).withColumn("cnt", F.lit(1).cast(kind))
    pending = list(groups)
    for i, u in enumerate(inner.order):
        if i + 1 < first:
            continue  # a corner, there from the start
        if i >= first:
            rows = place(rows, graph, inner, u, injective)
        here = set(inner.order[: i + 1])
        for g in [g for g in pending if g.parent in here and (not injective or set(_strangers(small, g)) <= here)]:
            rows = _weigh(rows, graph, small, g, kind, injective)
            pending.remove(g)
        wanted = set(needed(inner, i)) if injective else {inner.parent[v] for v in inner.order[i + 1 :]} | {x for v in inner.order[i + 1 :] for x in inner.back_edges(v)}
        wanted |= {x for g in pending for x in (g.parent, *_strangers(small, g))} & here
        have = [v for v in inner.order[: i + 1] if small.column(v) in rows.columns]
        keep = [v for v in have if v in wanted]
        if merging and i + 1 < len(inner.order) and len(keep) < len(have):
            rows = rows.groupBy(*[small.column(v) for v in keep]).agg(F.sum("cnt").cast(kind).alias("cnt"))
    return rows.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast(kind).alias("mapping_count"))


def tree_count(graph: Graph, the_plan: Plan) -> DataFrame:
    """One row, trees: images of the core, that is the groups a factorised result holds before expansion."""
    core, groups = fold(the_plan.pattern, the_plan.order[0])
    small = core_pattern(the_plan.pattern, core)
    rows = match(graph, plan(small, "degree")).withColumn("cnt", F.lit(1).cast("bigint"))
    for g in groups:
        rows = _weigh(rows, graph, small, g, "bigint", True)
    return rows.agg(F.count("*").alias("trees"))


def _closed(pairs: list[tuple[int, int]], most: int) -> dict[int, dict[int, int]] | None:
    """Each set of pairs that can coincide alone, as a mask, with its classes (vertex -> first vertex); None if there are more than `most`."""

    def closure(mask: int) -> tuple[int, dict[int, int]]:
        home = {u: u for p in pairs for u in p}
        for i, (u, v) in enumerate(pairs):
            if mask >> i & 1 and home[u] != home[v]:
                keep, gone = sorted((home[u], home[v]))
                home = {x: keep if h == gone else h for x, h in home.items()}
        return sum(1 << i for i, (u, v) in enumerate(pairs) if home[u] == home[v]), home

    found, todo = dict([closure(0)]), [0]
    while todo:
        mask = todo.pop()
        for i in range(len(pairs)):
            more, home = closure(mask | 1 << i)
            if more not in found:
                found[more] = home
                todo.append(more)
                if len(found) > most:
                    return None
    return found


def _quotient(pattern: Pattern, home: dict[int, int]) -> Pattern | None:
    """The pattern with each class made one vertex; None if an edge lies in a class, which no mapping allows."""
    edges = {frozenset(home.get(u, u) for u in e) for e in pattern.edges}
    return None if any(len(e) < 2 for e in edges) else Pattern({u: a for u, a in pattern.labels.items() if home.get(u, u) == u}, frozenset(edges))


def _alike(p: Pattern, q: Pattern) -> bool:
    """Whether the patterns are one up to the names of vertices."""
    sort = lambda x: sorted((x.labels[u], x.degree(u)) for u in x.labels)
    ids = list(p.labels)

    def go(to: dict[int, int]) -> bool:
        if len(to) == len(ids):
            return True
        u = ids[len(to)]
        fits = (v for v in q.labels if v not in to.values() and (p.labels[u], p.degree(u)) == (q.labels[v], q.degree(v)) and all(p.has_edge(u, w) == q.has_edge(v, x) for w, x in to.items()))
        return any(go(to | {u: v}) for v in fits)

    return len(p.edges) == len(q.edges) and sort(p) == sort(q) and go({})


def conflict_count(graph: Graph, the_plan: Plan, most_sets: int = 256) -> DataFrame:
    """(mask, mappings): homomorphisms by which conflicting pairs coincide; mask 0 in bit i: pair i differs.

    Nothing is listed: homomorphisms by which at least some pairs coincide are those of the pattern
    with these pairs merged, which count() folds, and what exactly these pairs give follows by
    inclusion and exclusion. A pattern with over `most_sets` sets of pairs that can coincide alone
    has too many such counts for one plan; its homomorphisms are listed.
    """
    from ..functions.scalar import conflict_mask

    pattern, kind = the_plan.pattern, "decimal(38,0)"
    pairs = [(c.first, c.second) for c in the_plan.conflicts()]
    closed = _closed(pairs, most_sets) if len(pairs) <= 63 else None
    if closed is None:
        flags = [F.col(pattern.column(u)) == F.col(pattern.column(v)) for u, v in pairs]
        return match(graph, the_plan, injective=False).groupBy(conflict_mask(flags).alias("mask")).agg(F.count("*").alias("mappings"))

    # exactly(m) = at least(m) - the sum of exactly(t) over larger t, here as factors of each at least(t)
    factors: dict[int, dict[int, int]] = {}
    for m in sorted(closed, key=int.bit_count, reverse=True):
        mine = {m: 1}
        for larger in [t for t in factors if t & m == m]:
            for t, f in factors[larger].items():
                mine[t] = mine.get(t, 0) - f
        factors[m] = mine
    merged: list[tuple[Pattern, dict[int, int]]] = []
    for t, home in closed.items():
        if (q := _quotient(pattern, home)) is None:
            continue
        if (known := next((f for p, f in merged if _alike(p, q)), None)) is None:
            merged.append((q, known := {}))
        for m, f in factors.items():
            known[m] = known.get(m, 0) + f.get(t, 0)
    out = None
    for q, known in merged:
        shares = F.explode(F.array(*[F.struct(F.lit(m).cast("bigint").alias("mask"), F.lit(f).cast("bigint").alias("f")) for m, f in known.items() if f]))
        one = count(graph, plan(q), injective=False, kind=kind).select("mapping_count", shares.alias("share"))
        out = one if out is None else out.unionByName(one)
    sums = out.groupBy(F.col("share.mask").alias("mask")).agg(F.sum((F.col("mapping_count") * F.col("share.f").cast("decimal(19,0)")).cast(kind)).alias("n"))
    return sums.filter("n > 0").select("mask", F.col("n").cast("bigint").alias("mappings"))
