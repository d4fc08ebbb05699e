"""The data graph: labelled vertices, symmetric edges, and slices of edges by label pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Graph:
    """vertices(vid, label) and edges in slices (src, dst), one for each ordered pair of labels.

    A slice is made when a plan asks for it, so a query reads the label pairs it needs and no others.
    Whole-graph operators read all edges in one pass.
    """

    def __init__(
        self,
        vertices: Callable[[str], DataFrame],
        slices: Callable[[str, str], DataFrame],
        all_vertices: Callable[[], DataFrame],
        all_edges: Callable[[], DataFrame],
        labels: list[str] | None = None,
        pairs: list[tuple[str, str]] | None = None,
        whole: DataFrame | None = None,
        single: set[tuple[str, str]] = frozenset(),
    ):
        """pairs: the label pairs that have a slice of their own, if they are known.

        single: pairs (a, b) where a vertex of label a is known to have one neighbour of label b at most.

        whole: the table all slices are cut from, which persist() keeps in memory; without it, it
        keeps each slice that has been asked for.
        """
        self._vertices, self._slices, self._all_vertices, self._all_edges = vertices, slices, all_vertices, all_edges
        self._labels, self.pairs, self.single, self._whole, self._persists, self._kept = labels, pairs, single, whole, False, {}

    @classmethod
    def from_edges(cls, vertices: DataFrame, edges: DataFrame, labels: list[str] | None = None) -> Graph:
        """From vertices(vid, label) and edges(src, dst, src_label, dst_label) as prepare() leaves them."""
        return cls(
            lambda a: vertices.filter(F.col("label") == a).select("vid"),
            lambda a, b: edges.filter((F.col("src_label") == a) & (F.col("dst_label") == b)).select("src", "dst"),
            lambda: vertices.select("vid", "label"),
            lambda: edges.select("src", "dst", "src_label", "dst_label"),
            labels,
            whole=edges,
        )

    @property
    def labels(self) -> list[str]:
        """All labels in order; looked up in the vertices if they were not given. No operator needs them."""
        if self._labels is None:
            self._labels = sorted(r["label"] for r in self.all_vertices().select("label").distinct().collect())
        return self._labels

    def vertices(self, label: str) -> DataFrame:
        """vid of every vertex with the label."""
        return self._vertices(label)

    def edges(self, a: str, b: str) -> DataFrame:
        """(src, dst) of all edges from label a to label b, each once, without self-loops."""
        if not self._persists or self._whole is not None:
            return self._slices(a, b)
        if (a, b) not in self._kept:
            self._kept[(a, b)] = self._slices(a, b).persist()
        return self._kept[(a, b)]

    def persist(self) -> Graph:
        """Keep edges in memory across queries: all of them in one table where there is one, else the slices in use."""
        self._persists = True
        if self._whole is not None:
            self._whole.persist()
        return self

    def unpersist(self) -> None:
        for df in (*self._kept.values(), *([self._whole] if self._whole is not None else [])):
            df.unpersist()
        self._persists, self._kept = False, {}

    def all_edges(self) -> DataFrame:
        """(src, dst, src_label, dst_label), every edge in both directions."""
        return self._all_edges()

    def all_vertices(self) -> DataFrame:
        """(vid, label)"""
        return self._all_vertices()

    def degrees(self, a: str, b: str) -> DataFrame:
        """(src, deg): neighbours of label b of each vertex of label a that has one."""
        return self.edges(a, b).groupBy("src").agg(F.count("*").alias("deg"))

    def total_degrees(self, label: str) -> DataFrame:
        """(src, deg): all neighbours of each vertex of the label that has one."""
        if self.pairs is not None:
            out = None
            for a, b in self.pairs:
                if a == label:
                    out = self.degrees(a, b) if out is None else out.unionByName(self.degrees(a, b))
            if out is not None:
                return out.groupBy("src").agg(F.sum("deg").alias("deg"))
        return self.all_edges().filter(F.col("src_label") == label).groupBy("src").agg(F.count("*").alias("deg"))

    def degree_table(self) -> DataFrame:
        """(vid, label, nbr_label, deg) over all label pairs."""
        return self.all_edges().groupBy(F.col("src").alias("vid"), F.col("src_label").alias("label"), F.col("dst_label").alias("nbr_label")).agg(F.count("*").alias("deg"))

    def label_histogram(self) -> DataFrame:
        return self.all_vertices().groupBy("label").agg(F.count("*").alias("n"))

    def pair_histogram(self) -> DataFrame:
        return self.all_edges().groupBy("src_label", "dst_label").agg(F.count("*").alias("n"))

    def neighbour_lists(self) -> DataFrame:
        """(vid, label, degree, nbs): one row a vertex, neighbours as structs in order.

        Joined by merging, as in prepare(): the lists are many times what Spark guesses from the files.
        """
        lists = self.all_edges().groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree"), F.array_sort(F.collect_list(F.struct("dst", "dst_label"))).alias("nbs"))
        return self.all_vertices().join(lists.hint("merge"), "vid", "left").withColumns({"degree": F.coalesce("degree", F.lit(0).cast("long")), "nbs": F.coalesce("nbs", F.array().cast("array<struct<dst:bigint,dst_label:string>>"))})


def prepare(vertices: DataFrame, edges: DataFrame, symmetrise: bool = True) -> DataFrame:
    """edges(src, dst) made ready: labels from the vertex table, both directions, no repeats, no self-loops.

    Edges to vertices that are not in the table are dropped. Spark guesses the size of edges from the
    files or text they are unfolded from, a small part of it, and would broadcast them through the
    driver: so both joins merge.
    """
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst")
    if symmetrise:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = e.dropDuplicates()
    v = vertices.select("vid", "label").hint("merge")
    out = e.join(v.select(F.col("vid").alias("src"), F.col("label").alias("src_label")), "src")
    return out.join(v.select(F.col("vid").alias("dst"), F.col("label").alias("dst_label")), "dst").select("src", "dst", "src_label", "dst_label")
