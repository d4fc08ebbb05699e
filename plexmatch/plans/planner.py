"""Matching orders, the depth-first pattern tree, and what can be told from it."""

from __future__ import annotations

import random
from dataclasses import dataclass

from .pattern import Pattern

ORDERS = ("degree", "anti-degree", "file", "ri", "candidate", "shuffle")
ALIASES = {"random": "file"}
#: Names for several orders at once.
BUNDLES = {"dad": ("degree", "anti-degree"), "rdr": ("file", "degree", "ri"), "default": ("file", "degree", "ri", "anti-degree")}


def orders_of(name: str) -> tuple[str, ...]:
    """The orders a name stands for."""
    if name in BUNDLES:
        return BUNDLES[name]
    name = ALIASES.get(name, name)
    if name not in ORDERS:
        raise ValueError(f"unknown order {name!r}; choose from {(*ORDERS, *ALIASES, *BUNDLES)}")
    return (name,)


@dataclass(frozen=True)
class Conflict:
    """Two vertices of one label in different branches, and where the branches part."""

    first: int
    second: int
    ancestor: int


@dataclass(frozen=True)
class Plan:
    pattern: Pattern
    order: tuple[int, ...]  # depth first
    parent: dict[int, int | None]
    level: dict[int, int]

    def children(self, u: int) -> list[int]:
        return [v for v in self.order if self.parent[v] == u]

    def ancestors(self, u: int) -> list[int]:
        out = []
        while (u := self.parent[u]) is not None:
            out.append(u)
        return out

    def is_ancestor(self, u: int, v: int) -> bool:
        return u in self.ancestors(v)

    def back_edges(self, u: int) -> list[int]:
        """Earlier neighbours other than the parent."""
        before = self.order[: self.order.index(u)]
        return [v for v in before if v != self.parent[u] and self.pattern.has_edge(u, v)]

    def rivals(self, u: int) -> list[int]:
        """Earlier vertices of the same label that no edge keeps apart already."""
        before = self.order[: self.order.index(u)]
        return [v for v in before if self.pattern.labels[v] == self.pattern.labels[u] and not self.pattern.has_edge(u, v)]

    def pseudo_children(self) -> list[int]:
        """Leaves of the tree without a back edge: they can be counted without being listed."""
        return [u for u in self.order[1:] if not self.children(u) and not self.back_edges(u)]

    def branch_vertices(self) -> list[int]:
        return [u for u in self.order if len(self.children(u)) > 1]

    def branch_number(self, u: int) -> int:
        return sum(len(self.children(a)) > 1 for a in self.ancestors(u))

    def conflicts(self) -> list[Conflict]:
        out = []
        for i, u in enumerate(self.order):
            for v in self.order[:i]:
                if self.pattern.labels[u] == self.pattern.labels[v] and not self.is_ancestor(v, u):
                    common = next(a for a in self.ancestors(u) if a in self.ancestors(v))
                    out.append(Conflict(v, u, common))
        return out

    def properties(self) -> dict[str, int]:
        return {
            "vertices": len(self.order),
            "edges": len(self.pattern.edges),
            "depth": max(self.level.values()) + 1,
            "max_branch": max(map(self.branch_number, self.order)),
            "conflicts": len(self.conflicts()),
        }

    def describe(self) -> str:
        lines = []
        for u in self.order:
            notes = [f"adjacent to {v}" for v in self.back_edges(u)] + [f"differs from {v}" for v in self.rivals(u)]
            if u in self.pseudo_children():
                notes.append("countable leaf")
            lines.append("  " * self.level[u] + f"{u}:{self.pattern.labels[u]}" + (f" ({', '.join(notes)})" if notes else ""))
        return "\n".join(lines)


def plan(pattern: Pattern, order: str = "degree", sizes: dict[int, int] | None = None, seed: int = 0) -> Plan:
    """Root and depth-first tree by one order. sizes: candidates of each vertex, for order `candidate`."""
    (order,) = orders_of(order) if order not in BUNDLES else ("",)
    if not order:
        raise ValueError("a bundle names several orders; plan them one by one")
    places = {u: i for i, u in enumerate(pattern.labels)}
    if order == "shuffle":
        mixed = list(places)
        random.Random(seed).shuffle(mixed)
        places = {u: i for i, u in enumerate(mixed)}
    if order == "candidate" and sizes is None:
        raise ValueError("order 'candidate' needs the candidates' sizes")

    def key(u: int, placed: list[int]) -> tuple:
        if order in ("degree", "anti-degree"):
            return (-pattern.degree(u) if order == "degree" else pattern.degree(u), places[u])
        if order == "ri":
            return (-sum(v in placed for v in pattern.neighbours[u]), -pattern.degree(u), places[u])
        if order == "candidate":
            return (sizes[u], places[u])
        return (places[u],)

    placed: list[int] = []
    parent: dict[int, int | None] = {}
    level: dict[int, int] = {}

    def visit(u: int, above: int | None) -> None:
        parent[u], level[u] = above, 0 if above is None else level[above] + 1
        placed.append(u)
        while rest := [v for v in pattern.neighbours[u] if v not in parent]:
            visit(min(rest, key=lambda v: key(v, placed)), u)

    visit(min(pattern.labels, key=lambda u: key(u, placed)), None)
    return Plan(pattern, tuple(placed), parent, level)
