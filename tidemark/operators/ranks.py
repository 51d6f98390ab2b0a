"""Exact ranks and quantiles by counting, for groups of any size. (E, F, I1)

Equal values are counted first, before anything is shuffled. Distinct values fall
into 64 bins an octave; counts are summed in order within a bin, and the bins'
sums, few a group, across bins. So a group with all the rows is as many tasks as
it has bins, and none holds its values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.cube import tally


def met(a: DataFrame, b: DataFrame, names: Sequence[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """The join of rows that are equal in the named columns, null as well; other columns must have different names."""
    other = b.select(*[F.col(n).alias(f"_r{i}") for i, n in enumerate(names)], *[c for c in b.columns if c not in names])
    on = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"_r{i}")) for i, n in enumerate(names)], F.lit(True))
    return a.join(other, on if also is None else on & also, how).drop(*[f"_r{i}" for i in range(len(names))])


def _bin(v: Column) -> Column:
    """Bins in the order of values; those beyond all numbers, and what is no number, have their own, as in Spark's order."""
    size = F.when(F.abs(v) == float("inf"), 200_000).otherwise(F.floor(F.log2(F.when((v != 0) & (F.abs(v) != float("inf")), F.abs(v))) * 64) + 100_000)
    return F.when(F.isnan(v), 300_000).when(v == 0, 0).otherwise(F.signum(v) * size).cast("long")


def ranked(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each distinct value of each group with ``c``, how many rows have it, ``upto``, how many are at or below it, and ``of``, how many there are. Null values take no part. Rows of a cube count as often as they have tickets."""
    values = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(tally(rows).alias("c")).withColumn("_bin", _bin(F.col(value).cast("double")))
    bins = values.groupBy(*keys, "_bin").agg(F.sum("c").alias("_in"))
    below = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(*keys, "_bin", F.coalesce(below, F.lit(0)).alias("_below"), F.sum("_in").over(Window.partitionBy(*keys)).alias("of"))
    within = F.sum("c").over(Window.partitionBy(*keys, "_bin").orderBy(value))
    return met(values.withColumn("_within", within), bins, (*keys, "_bin")).select(*keys, value, "c", (F.col("_below") + F.col("_within")).alias("upto"), "of")


def at_rank(value: str, rank: Column) -> Column:
    """An aggregate over :func:`ranked`: the value of a rank, from 0."""
    return F.min(F.when(F.col("upto") > rank, F.col(value)))


def between(value: str, p: float) -> Column:
    """An aggregate over :func:`ranked`: a quantile, linear between the two nearest ranks."""
    place = (F.max("of") - 1) * p
    low, high = (at_rank(value, f((F.col("of") - 1) * p)).cast("double") for f in (F.floor, F.ceil))
    share = place - F.floor(place)
    return F.when(low == high, low).otherwise(low * (1 - share) + high * share)


def described(rows: DataFrame, value: str, keys: Sequence[str], quantiles: dict[str, float], name: str = "hours") -> DataFrame:
    """n, mean, least, largest, deviation (0 of one value) and quantiles of each group, all from one count of equal values."""
    v, n = F.col(value).cast("double"), F.sum("c")
    total, squares = F.sum(v * F.col("c")), F.sum(v * v * F.col("c"))
    var = F.greatest(squares - total * total / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
    sd = F.when(n.isNotNull(), F.coalesce(F.sqrt(var), F.lit(0.0)))
    return ranked(rows, value, keys).groupBy(*keys).agg(
        (total / n).alias(f"avg_{name}"), F.coalesce(n, F.lit(0)).alias("n"), F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}"), sd.alias(f"sd_{name}"),
        *[between(value, p).alias(k) for k, p in quantiles.items()],
    )
