"""Metrics, trends and statistics by name; users add their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranks
from tidemark.operators.cube import takes_cube

Operator = Callable[..., DataFrame]


class Registry:
    """Named functions of a DataFrame and settings."""

    def __init__(self, **operators: Operator) -> None:
        self._operators: dict[str, Operator] = dict(operators)

    def register(self, name: str, operator: Operator) -> None:
        if not callable(operator):
            raise TypeError(f"{name} is not callable")
        self._operators[name] = operator

    def remove(self, name: str) -> bool:
        return self._operators.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self._operators)

    def supports(self, name: str) -> bool:
        return name in self._operators

    def takes_cube(self, name: str) -> bool:
        return name in self._operators and takes_cube(self._operators[name])

    def calculate(self, name: str, t: DataFrame, **settings: object) -> DataFrame:
        if name not in self._operators:
            raise KeyError(f"no such operator: {name}")
        return self._operators[name](t, **settings)


def statistics(df: DataFrame, *columns: str) -> DataFrame:
    """count, mean, sd, least, quartiles and largest of columns, a row each."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    rows = long.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    medians = ranks.ranked(long, "value", ("column",)).groupBy("column").agg(ranks.between("value", 0.5).alias("median"))
    return ranks.met(rows, medians, ("column",), "left").select("column", "n", "mean", "sd", "min", "median", "max")


def distributions(df: DataFrame, *columns: str) -> DataFrame:
    """column, value, n: counts of each column's values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))
