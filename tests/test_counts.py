import random

import pytest
from pyspark.sql import functions as F

from brute import mappings
from plexmatch.operators.counter import conflict_count, count, fold, tree_count
from plexmatch.operators.graph import Graph, prepare
from plexmatch.operators.matcher import match
from plexmatch.plans.pattern import Pattern
from plexmatch.plans.planner import ORDERS, plan
from plexmatch.queries import TOY_EDGES, TOY_LABELS, toy_graph

GOLDEN = [
    ("a", "", 3, 3), ("b", "", 5, 5), ("ac", "01", 3, 3), ("bd", "01", 6, 6), ("dd", "01", 4, 4),
    ("acb", "01 12", 7, 7), ("cbc", "01 12", 4, 11), ("bcb", "01 12", 10, 17), ("acb", "01 12 02", 4, 4), ("bdd", "01 12 02", 4, 4),
    ("acbc", "01 12 23 30", 4, 11), ("cbb", "01 02", 10, 17), ("dbb", "01 02", 6, 12), ("bccd", "01 02 03", 2, 9), ("cbbab", "01 02 03 34", 2, 21),
    ("accbb", "01 02 13 24", 8, 29), ("bddb", "01 12 23", 0, 4), ("add", "01 02", 6, 9), ("abcb", "01 12 23 30", 2, 6), ("acbd", "01 12 02 23", 2, 2),
]


@pytest.fixture(scope="module")
def toy(spark):
    g = toy_graph(spark)
    g.pairs = [(a, b) for a in g.labels for b in g.labels]
    yield g.persist()
    g.unpersist()


def graph_of(spark, labels, edges):
    v = spark.createDataFrame(list(labels.items()), "vid bigint, label string")
    e = spark.createDataFrame(list(edges), "src bigint, dst bigint") if edges else spark.createDataFrame([], "src bigint, dst bigint")
    return Graph.from_edges(v, prepare(v, e), sorted(set(labels.values())))


@pytest.mark.parametrize(("labels", "edges", "mono", "homo"), GOLDEN)
def test_golden(toy, labels, edges, mono, homo):
    p = plan(Pattern.of(labels, edges))
    assert count(toy, p).first()[0] == mono
    assert count(toy, p, injective=False).first()[0] == homo


def test_listing_agrees_with_search(toy):
    labels = {v: a for a, ids in TOY_LABELS.items() for v in ids}
    edges = [tuple(map(int, e.split("-"))) for e in TOY_EDGES.split()]
    for code, pairs in (("acbc", "01 12 23 30"), ("cbbab", "01 02 03 34"), ("b", "")):
        p = Pattern.of(code, pairs)
        assert sorted(map(tuple, match(toy, plan(p)).collect())) == sorted(mappings(labels, edges, p))


def test_random_graphs(spark):
    rng = random.Random(5)
    for _ in range(5):
        n = rng.randint(5, 8)
        labels = {v: rng.choice("ab") for v in range(n)}
        edges = {(a, b) for a in range(n) for b in range(a) if rng.random() < 0.5}
        g = graph_of(spark, labels, edges)
        m = rng.randint(3, 5)
        pairs = {(rng.randrange(i), i) for i in range(1, m)} | ({(0, m - 1)} if rng.random() < 0.4 else set())
        p = Pattern({i: rng.choice("ab") for i in range(m)}, frozenset(map(frozenset, pairs)))
        want = len(mappings(labels, edges, p))
        order = rng.choice([o for o in ORDERS if o != "candidate"])
        assert count(g, plan(p, order), order="degree").first()[0] == want
        assert count(g, plan(p, order), folding=False).first()[0] == want
        assert count(g, plan(p, order), folding=False, merging=False).first()[0] == want
        assert count(g, plan(p, order), injective=False).first()[0] == len(mappings(labels, edges, p, False)) >= want


def test_one_label_in_two_groups_is_folded_once():
    core, groups = fold(Pattern.of("abbcb", "01 02 03 34"), 0)
    assert [(g.parent, g.label, g.size) for g in groups] == [(0, "b", 2)]
    assert set(core) == {0, 3, 4}


def test_repeats_self_loops_and_strangers_are_dropped(spark):
    v = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "vid bigint, label string")
    e = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (1, 2), (1, 3), (1, 9)], "src bigint, dst bigint")
    g = Graph.from_edges(v, prepare(v, e))
    assert g.labels == ["a", "b"]
    assert count(g, plan(Pattern.of("aa", "01"))).first()[0] == 2
    assert g.all_edges().count() == 4


def test_empty_graph_and_missing_label(spark):
    g = graph_of(spark, {1: "a"}, [])
    assert count(g, plan(Pattern.of("aa", "01"))).first()[0] == 0
    assert count(g, plan(Pattern.of("z"))).first()[0] == 0
    assert tree_count(g, plan(Pattern.of("aa", "01"))).first()[0] == 0


def test_wide_counts(spark):
    hub = {0: "h"} | {i: "x" for i in range(1, 3001)}
    g = graph_of(spark, hub, [(0, i) for i in range(1, 3001)])
    n = count(g, plan(Pattern.of("hxxxxxxx", "01 02 03 04 05 06 07")), kind="decimal(38,0)").first()[0]
    want = 1
    for i in range(7):
        want *= 3000 - i
    assert int(n) == want > 2**63


@pytest.mark.parametrize(
    ("code", "pairs"),
    [
        ("abab", "01 12 23 30"),  # two pairs of twins to choose from
        ("aaaa", "01 12 23 30"),  # corners and twins of one label
        ("abbba", "01 02 03 41 42 43"),  # three twins
        ("abab", "01 12 23 30 02"),  # corners joined by an edge: no twins there
        ("ababb", "01 12 23 30 04"),  # a leaf of the twins' label at a corner
        ("ababa", "01 12 23 30 14"),  # a leaf at a twin
        ("abababa", "01 12 23 30 04 45 56"),  # a path that leaves a corner, with the twins' label on it
        ("aabba", "02 12 03 13 24"),
    ],
)
def test_twins(spark, code, pairs):
    rng = random.Random(code + pairs)
    labels = {v: rng.choice("ab") for v in range(9)}
    edges = {(a, b) for a in range(9) for b in range(a) if rng.random() < 0.5}
    g, p = graph_of(spark, labels, edges), Pattern.of(code, pairs)
    want = sorted(mappings(labels, edges, p))
    assert sorted(map(tuple, match(g, plan(p)).collect())) == want
    assert count(g, plan(p)).first()[0] == len(want)
    assert count(g, plan(p), injective=False).first()[0] == len(mappings(labels, edges, p, False))


@pytest.mark.parametrize(
    ("code", "pairs"),
    [
        ("abbb", "01 02 03"),  # leaves of one vertex
        ("abbcb", "01 02 03 34"),  # leaves of two vertices
        ("aabab", "01 12 03 34"),  # merging pairs closes cycles
        ("aaaa", "01 02 13"),  # merged pairs may bring the ends of an edge together
        ("abab", "01 12 23 30"),
        ("abcd", "01 12 23"),  # no conflict
    ],
)
def test_conflict_masks(spark, code, pairs):
    rng = random.Random(code + pairs)
    labels = {v: "abcd"[v % 4] if code == "abcd" else rng.choice("abc") for v in range(9)}
    edges = {(a, b) for a in range(9) for b in range(a) if rng.random() < 0.6}
    g, p = graph_of(spark, labels, edges), Pattern.of(code, pairs)
    want = {}
    for m in mappings(labels, edges, p, False):
        mask = sum(1 << i for i, c in enumerate(plan(p).conflicts()) if m[c.first] == m[c.second])
        want[mask] = want.get(mask, 0) + 1
    assert dict(map(tuple, conflict_count(g, plan(p)).collect())) == want
    assert dict(map(tuple, conflict_count(g, plan(p), most_sets=0).collect())) == want


def test_conflict_masks_are_not_listed(spark):
    """8 x 10**9 homomorphisms of one hub."""
    leaves = spark.range(1, 2001).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    v = spark.range(2001).select(F.col("id").alias("vid"), F.when(F.col("id") == 0, "h").otherwise("x").alias("label"))
    got = dict(map(tuple, conflict_count(Graph.from_edges(v, prepare(v, leaves)), plan(Pattern.of("hxxx", "01 02 03"))).collect()))
    n = 2000
    assert got == {0: n * (n - 1) * (n - 2), 1: n * (n - 1), 2: n * (n - 1), 4: n * (n - 1), 7: n}


@pytest.mark.parametrize(("code", "pairs"), [("habb", "01 02 03"), ("habbc", "01 02 03 14"), ("bhab", "01 12 13"), ("bbbb", "01 02 03")])
def test_hubs_are_dealt_by_the_rows_they_make(spark, monkeypatch, code, pairs):
    """No task makes far more rows than its share, and the rows are those of a search."""
    from plexmatch.operators import matcher

    monkeypatch.setattr(matcher, "TASK_ROWS", 50, raising=False)
    rng = random.Random(code)
    labels = {0: "h", 1: "h"} | {v: "aabbbc"[v % 6] for v in range(2, 32)}
    edges = {(0, v) for v in range(2, 30)} | {(1, v) for v in range(26, 32)} | {(v, w) for v in range(2, 32) for w in range(2, v) if rng.random() < 0.1}
    edges |= {(2, v) for v in labels if labels[v] == "b"}
    got = match(graph_of(spark, labels, edges), plan(Pattern.of(code, pairs)))
    per = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    want = sorted(mappings(labels, edges, Pattern.of(code, pairs)))
    assert sorted(map(tuple, got.collect())) == want
    assert max(per) < max(400, sum(per) / 4), (per, len(want))
