"""Data quality scores; one scan each. (K)"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import metrics as M
from tidemark.operators.cube import cubed, done, mean, tally
from tidemark.operators.clean import blank

FIELDS = ("id", "created_date", "status", "title", "severity", "assignee", "resolver_group")


def _some(pairs):
    return F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in pairs]))


def assess(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """Completeness, consistency, validity, timeliness, their mean, issues and recommendations. (K1-K5)"""
    there = lambda f: F.count_if(F.col(f).isNotNull() if f == "created_date" else ~blank(f))
    created, updated, resolved = F.col("created_date"), F.col("updated_date"), F.col("resolved_date")
    pair_u, pair_r = created.isNotNull() & updated.isNotNull(), created.isNotNull() & resolved.isNotNull()
    stated = ~blank("status") & resolved.isNotNull()
    row = t.agg(
        F.count("*").alias("total"), *[there(f).alias(f"_{f}") for f in FIELDS],
        (F.count_if(pair_u) + F.count_if(pair_r) + F.count_if(stated)).alias("checks"),
        (F.count_if(updated < created) + F.count_if(resolved < created) + F.count_if(stated & ~F.col("status").isin(*C.RESOLVED))).alias("consistency_issues"),
        (F.count_if(created > C.moment(as_of)) + F.count_if(F.floor(C.hours_between("created_date", "resolved_date") / 24) > 730)).alias("validity_issues"),
        F.count_if(created >= C.moment(as_of) - F.make_dt_interval(F.lit(30))).alias("recent"),
    )
    row = row.withColumns({f"{f}_percent": C.percent(F.col(f"_{f}"), F.col("total")) for f in FIELDS})
    row = row.withColumns(
        {
            "completeness": (F.col("id_percent") + F.col("created_date_percent") + F.col("status_percent")) / 3,
            "consistency": F.when(F.col("checks") > 0, C.percent(F.col("checks") - F.col("consistency_issues"), F.col("checks"))).otherwise(100.0),
            "validity": F.when(F.col("total") > 0, C.percent(F.col("total") - F.col("validity_issues"), F.col("total"))).otherwise(100.0),
            "timeliness": C.percent(F.col("recent"), F.col("total")),
        }
    )
    row = row.withColumn("score", (F.col("completeness") + F.col("consistency") + F.col("validity") + F.col("timeliness")) / 4)
    low = {k: F.col(k) < (50 if k == "timeliness" else 90) for k in ("completeness", "consistency", "validity", "timeliness")}
    return row.drop(*[f"_{f}" for f in FIELDS]).withColumns(
        {
            "complete": F.col("completeness") >= 95, "consistent": F.col("consistency") >= 95, "valid": F.col("validity") >= 95, "recent_data": F.col("timeliness") >= 50,
            # fixed values: the sentences
            "issues": _some(
                [(low["completeness"], "Low data completeness - missing critical fields"), (low["consistency"], "Data consistency issues - conflicting field values"),
                 (low["validity"], "Data validity issues - invalid or unreasonable values"), (low["timeliness"], "Data timeliness issues - mostly old data")]
            ),
            "recommendations": _some(
                [(low["completeness"], "Improve data collection processes to ensure all critical fields are populated"), (low["consistency"], "Implement data validation rules to prevent inconsistent field values"),
                 (low["validity"], "Add data validation checks to prevent invalid dates and values"), (low["timeliness"], "Ensure regular data updates and consider filtering to recent data"),
                 (F.col("score") >= 90, "Data quality is good - continue current data management practices")]
            ),
        }
    )


def light(t: DataFrame) -> DataFrame:
    """Complete records and missing fields. (K6)"""
    lacks = {"id": blank("id"), "created_date": F.col("created_date").isNull(), "status": blank("status")}
    none = ~(lacks["id"] | lacks["created_date"] | lacks["status"])
    row = t.agg(F.count("*").alias("total"), F.count_if(none).alias("complete_records"), *[F.count_if(c).alias(f"missing_{f}") for f, c in lacks.items()])
    return row.withColumn("quality_score", C.percent(F.col("complete_records"), F.col("total")))


@cubed
def insights(t: DataFrame) -> DataFrame:
    """Insights and recommendations from mean hours, rate and volume. (K7, K8)"""
    x = F.when(F.col("h") > 0, F.col("h"))
    row = M.with_hours(t).agg(mean(t, x).alias("avg_hours"), C.percent(tally(t, done(t)), tally(t)).alias("rate"), tally(t).alias("total"))
    h, rate = F.format_string("%.1f", F.col("avg_hours")), F.format_string("%.1f", F.col("rate"))
    # fixed values: the sentences
    say = [
        (F.col("avg_hours") > 48, F.concat(F.lit("Average resolution time is high at "), h, F.lit(" hours"))), (F.col("avg_hours") < 4, F.concat(F.lit("Excellent average resolution time of "), h, F.lit(" hours"))),
        ((F.col("total") > 0) & (F.col("rate") > 90), F.concat(F.lit("High resolution rate of "), rate, F.lit("%"))), ((F.col("total") > 0) & (F.col("rate") < 50), F.concat(F.lit("Low resolution rate of "), rate, F.lit("% needs attention"))),
    ]
    return row.withColumns(
        {
            "insights": F.array_compact(F.array(*[F.when(c, s) for c, s in say])),
            "recommendations": _some([(F.col("avg_hours") > 72, "Consider reviewing resolution processes to reduce average resolution time"), (F.col("total") > 1000, "High ticket volume detected - consider workload distribution analysis")]),
        }
    )
