"""Query patterns: small connected undirected graphs with labelled vertices."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

LABEL_MODES = ("first_char", "full")


def read_label(token: str, mode: str) -> str:
    if mode not in LABEL_MODES:
        raise ValueError(f"label_mode must be one of {LABEL_MODES}, not {mode!r}")
    return token[:1] if mode == "first_char" else token


@dataclass(frozen=True)
class Pattern:
    """labels: query vertex -> label, in file order; edges: unordered pairs of query vertices."""

    labels: dict[int, str]
    edges: frozenset[frozenset[int]]
    name: str = ""
    neighbours: dict[int, tuple[int, ...]] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        if not self.labels:
            raise ValueError("a pattern needs a vertex")
        near: dict[int, list[int]] = {u: [] for u in self.labels}
        for e in self.edges:
            if len(e) != 2 or not e <= set(self.labels):
                raise ValueError(f"edge {sorted(e)} must join two different vertices of the pattern")
        for u in self.labels:
            near[u] = [v for v in self.labels if frozenset((u, v)) in self.edges]
        object.__setattr__(self, "neighbours", {u: tuple(v) for u, v in near.items()})
        reached, todo = set(), [next(iter(self.labels))]
        while todo:
            u = todo.pop()
            if u not in reached:
                reached.add(u)
                todo += near[u]
        if len(reached) < len(self.labels):
            raise ValueError(f"the pattern is not connected: {sorted(set(self.labels) - reached)} cannot be reached")

    @classmethod
    def of(cls, labels: str | Iterable[str], edges: str = "", name: str = "") -> Pattern:
        """Pattern.of("acb", "01 12"): labels by position, edges as pairs of positions."""
        pairs = (re.findall(r"\d+", e) if "-" in e else list(e) for e in edges.split())
        return cls(dict(enumerate(labels)), frozenset(frozenset(map(int, p)) for p in pairs), name)

    @classmethod
    def parse(cls, text: str, label_mode: str = "first_char", name: str = "") -> Pattern:
        """Lines `<id> <label> (<neighbour> <its label>)*`; an edge may be listed by either end."""
        rows = [re.split(r"[ \t]+", line.strip()) for line in text.splitlines() if line.strip()]
        for r in rows:
            if len(r) < 2:
                raise ValueError(f"a line needs an id and a label: {' '.join(r)!r}")
        labels = {int(r[0]): read_label(r[1], label_mode) for r in rows}
        edges = {frozenset((int(r[0]), int(v))) for r in rows for v in r[2::2] if int(v) != int(r[0])}
        return cls(labels, frozenset(edges), name)

    def has_edge(self, u: int, v: int) -> bool:
        return frozenset((u, v)) in self.edges

    def degree(self, u: int) -> int:
        return len(self.neighbours[u])

    def column(self, u: int) -> str:
        return f"u_{u}"
