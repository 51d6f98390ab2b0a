"""A cube of tickets that whole analyses share, and what lets the same operators take either.

A cell is an hour of creation, status, severity, assignee, group and resolution
time; it holds its number of tickets, ``n_rows``, and its first and last moment of
creation. Distributions, volumes, trends, means and exact quantiles follow from
cells, so one scan of the tickets feeds them all. Operators marked :func:`cubed`
take tickets or a cube.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C

N = "n_rows"
KEYS = ("status", "severity", "assignee", "resolver_group")


def cube(t: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", "created_date").cast(t.schema["created_date"].dataType)
    rows = t.select(hour.alias("_hour"), "created_date", *KEYS, C.resolution_hours().alias("h"), C.is_resolved().alias("is_resolved"))
    cells = rows.groupBy("_hour", *KEYS, "h", "is_resolved").agg(F.count("*").alias(N), F.min("created_date").alias("first_created"), F.max("created_date").alias("last_created"))
    return cells.withColumnRenamed("_hour", "created_date")


def cubed(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Marks an operator that takes a cube in place of tickets."""
    operator.takes_cube = True
    return operator


def takes_cube(operator: Callable[..., DataFrame]) -> bool:
    return getattr(operator, "takes_cube", False)


def is_cube(t: DataFrame) -> bool:
    return N in t.columns


def weight(t: DataFrame) -> list[str]:
    """The column with the number of tickets of a row, if there is one: to be kept by projections."""
    return [N] if is_cube(t) else []


def tally(t: DataFrame, where: Column | None = None) -> Column:
    """How many tickets, or those of them that fulfil a condition."""
    if not is_cube(t):
        return F.count("*") if where is None else F.count_if(where)
    return F.coalesce(F.sum(N if where is None else F.when(where, F.col(N))), F.lit(0))


def mean(t: DataFrame, x: Column) -> Column:
    return F.sum(x * F.col(N)) / F.sum(F.when(x.isNotNull(), F.col(N))) if is_cube(t) else F.avg(x)


def done(t: DataFrame) -> Column:
    return F.col("is_resolved") if is_cube(t) else C.is_resolved()


def ends(t: DataFrame) -> tuple[Column, Column]:
    """The first and the last moment of creation."""
    return (F.min("first_created"), F.max("last_created")) if is_cube(t) else (F.min("created_date"), F.max("created_date"))
