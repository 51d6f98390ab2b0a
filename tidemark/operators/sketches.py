"""Resolution hours kept as mergeable sketches, so that months of history give quantiles without their rows.

A table of one KLL sketch a day and group is a few kB a row however many rows
the day had; a new day is added without the days before it, and any range of days
and groups is a merge. Counts, sums and ends are exact; the rank of a quantile is
off by :func:`rank_error` of all rows at most, with a probability over 0.99.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import metrics as M

#: Size of a sketch.
K = 400


def rank_error(k: int = K) -> float:
    """The bound of sketches of size k, as the sketch's authors give it: 1.33 % at 200, falling a little slower than in proportion."""
    return 2.296 / k**0.9723


def daily(t: DataFrame, *keys: str, on: str = "created_date", k: int = K) -> DataFrame:
    """day, keys, n, total, least, largest and sketch of the hours (over 0) of each day and group. Rows without a time ``on`` are left out."""
    rows = M.positive(t).where(F.col(on).isNotNull()).select(C.day(on).alias("day"), *keys, F.col("h").cast("double").alias("h"))
    return rows.groupBy("day", *keys).agg(F.count("*").alias("n"), F.sum("h").alias("total"), F.min("h").alias("least"), F.max("h").alias("largest"), F.kll_sketch_agg_double("h", F.lit(k)).alias("sketch"))


def between(days: DataFrame, first: date | str | None = None, last: date | str | None = None) -> DataFrame:
    """The days of a range, both ends in it: a filter on the table's key, which prunes files where it is partitioned or sorted by day."""
    day = lambda x: F.lit(str(x)).cast("date")
    days = days if first is None else days.where(F.col("day") >= day(first))
    return days if last is None else days.where(F.col("day") <= day(last))


def merged(days: DataFrame, *keys: str | Column, k: int = K) -> DataFrame:
    """n, total, least, largest and sketch of each group of days; keys may be expressions over day, such as its month."""
    return days.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def told(groups: DataFrame, *percentiles: int) -> DataFrame:
    """The groups with mean and quantiles in place of sums and sketch."""
    q = {f"p{p}": F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)) for p in percentiles or M.PERCENTILES}
    return groups.withColumns({"avg_hours": F.col("total") / F.col("n"), **q}).withColumnsRenamed({"least": "min_hours", "largest": "max_hours"}).drop("sketch", "total")
