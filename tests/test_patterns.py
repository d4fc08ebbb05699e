import pytest

from plexmatch.plans.pattern import Pattern
from plexmatch.plans.planner import BUNDLES, ORDERS, orders_of, plan


def test_parse_takes_edges_from_either_end():
    a = Pattern.parse("1 a 2 c\n2 c\n3\tb 2 c\n\n")
    assert a.labels == {1: "a", 2: "c", 3: "b"}
    assert a.edges == {frozenset((1, 2)), frozenset((2, 3))}


def test_label_modes():
    assert Pattern.parse("1 abc").labels == {1: "a"}
    assert Pattern.parse("1 abc", "full").labels == {1: "abc"}
    with pytest.raises(ValueError, match="label_mode"):
        Pattern.parse("1 abc", "other")


def test_disconnected_and_broken_patterns_are_refused():
    with pytest.raises(ValueError, match="not connected"):
        Pattern.of("ab")
    with pytest.raises(ValueError):
        Pattern.of("")
    with pytest.raises(ValueError):
        Pattern.parse("1")


def test_orders():
    p = Pattern.of("abbc", "01 02 13")
    assert plan(p, "degree").order[0] == 0
    assert plan(p, "anti-degree").order[0] == 2
    assert plan(p, "random").order[0] == 0
    assert plan(p, "candidate", {0: 9, 1: 5, 2: 7, 3: 1}).order[0] == 3
    assert plan(p, "shuffle", seed=1).order == plan(p, "shuffle", seed=1).order
    for order in ORDERS:
        assert set(plan(p, order, dict.fromkeys(p.labels, 1)).order) == set(p.labels)
    assert orders_of("dad") == BUNDLES["dad"]
    with pytest.raises(ValueError, match="unknown order"):
        plan(p, "nonsense")
    with pytest.raises(ValueError):
        plan(p, "dad")
    with pytest.raises(ValueError):
        plan(p, "candidate")


def test_tree_facts():
    p = plan(Pattern.of("cbbab", "01 02 03 34"))
    assert p.order[0] == 0 and p.parent[4] == 3
    assert set(p.pseudo_children()) == {1, 2, 4}
    assert p.properties() == {"vertices": 5, "edges": 4, "depth": 3, "max_branch": 1, "conflicts": 3}
    assert "differs from" in p.describe()
    square = plan(Pattern.of("acbc", "01 12 23 30"))
    assert sum(len(square.back_edges(u)) for u in square.order) == 1
    assert square.is_ancestor(square.order[0], square.order[3])
