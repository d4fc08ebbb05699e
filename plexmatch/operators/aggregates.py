"""Whole-table reductions and user aggregators."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reductions(df: DataFrame, value: Column, flag: Column) -> DataFrame:
    """One row: sum, bitwise or, and logical or over all rows, reduced partially before the exchange."""
    return df.agg(F.sum(value).alias("total"), F.bit_or(value).alias("bits"), F.bool_or(flag).alias("any"))


class Aggregator(ABC):
    """A user aggregator over rows as Spark sees it: partial state, merging, finish, all as columns."""

    @abstractmethod
    def partial(self) -> dict[str, Column]:
        """Aggregates worked out in each task."""

    @abstractmethod
    def finish(self, state: dict[str, Column]) -> dict[str, Column]:
        """The result's columns from the merged state."""

    def over(self, df: DataFrame, *keys: str) -> DataFrame:
        state = self.partial()
        rows = df.groupBy(*keys).agg(*[c.alias(f"_{k}") for k, c in state.items()])
        return rows.select(*keys, *[c.alias(k) for k, c in self.finish({k: F.col(f"_{k}") for k in state}).items()])


class SumOfProducts(Aggregator):
    """Sum of a * b, and its share per row."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b

    def partial(self) -> dict[str, Column]:
        return {"s": F.sum(F.col(self.a) * F.col(self.b)), "n": F.count("*")}

    def finish(self, state: dict[str, Column]) -> dict[str, Column]:
        return {"total": state["s"], "mean": state["s"] / state["n"]}
