"""Scalar expressions over the ticket columns. All are built-in, so they stay inside code generation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOLVED = ("Resolved", "Closed")


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(as_of: datetime | str) -> Column:
    """A point in time as a literal of the tickets' type."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def hours_between(a: str | Column, b: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", column(a), column(b)) / F.lit(3.6e9)


def is_resolved() -> Column:
    """Status says so and there is a date."""
    return F.col("status").isin(*RESOLVED) & F.col("resolved_date").isNotNull()


def resolution_hours() -> Column:
    """Hours from creation to resolution of resolved rows, else null."""
    return F.when(is_resolved(), hours_between("created_date", "resolved_date"))


def age_hours(as_of: datetime | str) -> Column:
    return hours_between("created_date", moment(as_of))


def age_days(as_of: datetime | str) -> Column:
    """Whole days since creation, as the detail projection shows them."""
    return F.floor(age_hours(as_of) / 24)


def day(c: str | Column) -> Column:
    return F.to_date(column(c))


def week_label(c: str | Column) -> Column:
    """Year and week of it, weeks beginning on Sunday; days before the first Sunday are week 00."""
    c = column(c)
    return F.concat(F.date_format(c, "yyyy"), F.lit("-W"), F.lpad(F.floor((F.dayofyear(c) + 7 - F.dayofweek(c)) / 7).cast("string"), 2, "0"))


def week_period(c: str | Column) -> Column:
    """Monday and Sunday of the week, as from/to."""
    start = F.to_date(F.date_trunc("week", column(c)))
    return F.concat(start.cast("string"), F.lit("/"), F.date_add(start, 6).cast("string"))


def month_label(c: str | Column) -> Column:
    return F.date_format(column(c), "yyyy-MM")


def month_name(c: str | Column) -> Column:
    return F.date_format(column(c), "MMMM")


def quarter_label(c: str | Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(column(c)).cast("string"))


def day_name(c: str | Column) -> Column:
    return F.date_format(column(c), "EEEE")


def or_unassigned(c: str | Column) -> Column:
    return F.coalesce(F.nullif(column(c), F.lit("")), F.lit("Unassigned"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 when there is no whole."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def sd(c: str | Column) -> Column:
    """Sample standard deviation, 0 for one row."""
    return F.coalesce(F.stddev_samp(column(c)), F.lit(0.0))


def lookup(c: Column, table: dict[str, str], otherwise: Column) -> Column:
    """The table's value for c, else the other column; a literal map, looked up row by row."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), otherwise)


#: Words in a metric's name, and the category they put it in; the first that fits counts.
METRIC_CATEGORIES = [
    (("resolution", "resolve", "time"), "resolution_metrics"),
    (("status", "state"), "status_metrics"),
    (("volume", "count", "total"), "volume_metrics"),
    (("team", "assignee", "user"), "team_metrics"),
]


def metric_category(name: str | Column) -> Column:
    """Category of a metric by its name."""
    low = F.lower(column(name))
    out = F.lit(None).cast("string")
    for words, category in reversed(METRIC_CATEGORIES):
        fits = low.contains(words[0])
        for w in words[1:]:
            fits = fits | low.contains(w)
        out = F.when(fits, category).otherwise(out)
    return F.coalesce(out, F.lit("other_metrics"))


#: The forms of a ticket id.
ID_FORMS = [r"^[A-Z]{1,5}-?[0-9]{1,10}$", r"^T[0-9]{6,10}$", r"^P[0-9]{6,10}$", r"^V[0-9]{10}$"]


def id_is_valid(c: str | Column) -> Column:
    """Whether the upper-cased, trimmed id has one of the known forms. (C17)"""
    up = F.upper(F.trim(column(c)))
    ok = up.rlike(ID_FORMS[0])
    for form in ID_FORMS[1:]:
        ok = ok | up.rlike(form)
    return F.coalesce(ok, F.lit(False))
