"""Service levels, velocity, periods and teams."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import metrics as M

#: Hours by severity; others have DEFAULT_HOURS.
SLA_HOURS = {"SEV_1": 4, "SEV_2": 24, "SEV_3": 72, "SEV_4": 168, "SEV_5": 720}
DEFAULT_HOURS = 24


def timed(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """Hours to resolution, or of age while open."""
    return t.withColumn("hours", F.coalesce(C.resolution_hours(), C.age_hours(as_of)))


def allowed(sla: Mapping[str, int] = SLA_HOURS) -> Column:
    """Hours that a severity allows: a literal map of a few entries, so nothing is joined."""
    return C.lookup(F.col("severity"), {k: str(v) for k, v in sla.items()}, F.lit(str(DEFAULT_HOURS))).cast("int")


def compliance(t: DataFrame, as_of: datetime | str, hours: float = 24) -> DataFrame:
    """Against one threshold."""
    return timed(t, as_of).agg(F.count("*").alias("total"), F.count_if(F.col("hours") <= hours).alias("compliant")).withColumn("rate", C.percent(F.col("compliant"), F.col("total")))


def compliance_by_severity(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """(J13)"""
    g = timed(t, as_of).withColumn("sla_hours", allowed()).groupBy("severity", "sla_hours").agg(F.count("*").alias("total"), F.count_if(F.col("hours") <= F.col("sla_hours")).alias("compliant"))
    return g.withColumn("rate", F.col("compliant") / F.col("total"))


def breaches(t: DataFrame, as_of: datetime | str) -> DataFrame:
    return timed(t, as_of).withColumn("over", F.col("hours") - allowed()).where("over > 0")


def breach_summary(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """Number, mean overrun, the worst."""
    return breaches(t, as_of).agg(F.count("*").alias("n"), F.avg("over").alias("avg_over"), F.max("over").alias("max_over"), F.max_by("id", F.struct("over", "id")).alias("worst_id"))


def breaches_by_assignee(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """(J14)"""
    return breaches(t, as_of).groupBy(C.or_unassigned("assignee").alias("assignee")).agg(F.count("*").alias("n"))




def velocity(t: DataFrame, as_of: datetime | str, days: int = 14, key: str | None = None) -> DataFrame:
    """Resolved rows created in the current sprint and the five before, their trend and evenness.

    A sprint's number is how many whole sprints the creation lies back.
    """
    keys = [key] if key else []
    back = F.greatest(F.lit(0), F.ceil(C.age_hours(as_of) / (24 * days)) - 1)
    n = t.where(C.is_resolved()).withColumn("back", back).where("back <= 5").groupBy(*keys).agg(*[F.count_if(F.col("back") == i).alias(f"sprint_{i}") for i in range(6)])
    past = [F.col(f"sprint_{i}") for i in range(1, 6)]
    recent, older = sum(past[:3], F.lit(0)) / 3, sum(past[3:], F.lit(0)) / 2
    mean = sum(past, F.lit(0)) / 5
    sd = F.sqrt(sum(((p - mean) * (p - mean) for p in past), F.lit(0.0)) / 5)
    return n.withColumns(
        {
            "average": mean, "trend": F.when(recent > older * 1.1, "improving").when(recent < older * 0.9, "declining").otherwise("stable"),
            "consistency": F.when(mean > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(sd, mean)))).otherwise(0.0),
        }
    )


def dashboard(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """Totals, compliance and velocity of each team; one pass for the first two, one for the last."""
    x = timed(t, as_of).withColumns({"sla_hours": allowed(), "resolver_group": C.or_unassigned("resolver_group")})
    totals = x.groupBy("resolver_group").agg(
        F.count("*").alias("total"), F.count_if(C.is_resolved()).alias("resolved"), (F.count_if(F.col("hours") <= F.col("sla_hours")) / F.count("*")).alias("sla_rate"), F.avg(C.resolution_hours()).alias("avg_hours")
    )
    v = velocity(t.withColumn("resolver_group", C.or_unassigned("resolver_group")), as_of, key="resolver_group").select("resolver_group", F.col("sprint_0").alias("current_velocity"), F.col("average").alias("average_velocity"), F.col("trend").alias("velocity_trend"))
    return totals.join(v, "resolver_group", "left").fillna(0, ["current_velocity", "average_velocity"])


def compare_periods(t: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    """The last days against those before, in one scan."""
    at = lambda n: C.moment(as_of) - F.make_dt_interval(F.lit(n))
    now = (F.col("created_date") > at(days)) & (F.col("created_date") <= C.moment(as_of))
    before = (F.col("created_date") > at(2 * days)) & (F.col("created_date") <= at(days))
    h = F.col("h")
    row = M.with_hours(t).agg(
        F.count_if(now).alias("current_total"), F.count_if(before).alias("previous_total"), F.count_if(now & C.is_resolved()).alias("current_resolved"), F.count_if(before & C.is_resolved()).alias("previous_resolved"),
        F.avg(F.when(now & (h > 0), h)).alias("current_hours"), F.avg(F.when(before & (h > 0), h)).alias("previous_hours"),
    )
    change = lambda m: F.coalesce(F.try_divide((F.col(f"current_{m}") - F.col(f"previous_{m}")) * 100.0, F.col(f"previous_{m}")), F.lit(0.0))
    return row.withColumns({f"{m}_change": change(m) for m in ("total", "resolved", "hours")})


def grid(t: DataFrame, ranges: Mapping[str, int], as_of: datetime | str) -> DataFrame:
    """Totals of each team over several ranges of days before a moment, in one job.

    Ranges are a few literals: each row is told apart into those it lies in.
    """
    days = C.age_hours(as_of) / 24
    inside = F.array_compact(F.array(*[F.when((days >= 0) & (days <= n), F.lit(name)) for name, n in ranges.items()]))
    rows = M.with_hours(t).withColumn("team", C.or_unassigned("resolver_group")).select("team", "h", C.is_resolved().alias("done"), F.explode(inside).alias("range"))
    return rows.groupBy("team", "range").agg(F.count("*").alias("total"), F.count_if("done").alias("resolved"), F.avg(F.when(F.col("h") > 0, F.col("h"))).alias("avg_hours"))


def run_summary(runs: DataFrame) -> DataFrame:
    """runs: team, ok."""
    return runs.agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_distinct("team").alias("teams")).withColumn("rate", C.percent(F.col("succeeded"), F.col("total")))
