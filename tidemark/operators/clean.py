"""Cleaning and validation of tickets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C

#: Synonyms when cleaning.
STATUS = {
    "open": "Open", "opened": "Open", "new": "Open", "created": "Open", "in progress": "In Progress", "in-progress": "In Progress", "inprogress": "In Progress", "working": "In Progress", "assigned": "In Progress",
    "resolved": "Resolved", "fixed": "Resolved", "completed": "Resolved", "done": "Resolved", "closed": "Closed", "cancelled": "Closed", "canceled": "Closed", "rejected": "Closed",
}
SEVERITY = {str(i): f"SEV_{i}" for i in range(1, 6)} | {"critical": "SEV_1", "high": "SEV_2", "medium": "SEV_3", "low": "SEV_4", "lowest": "SEV_5", "urgent": "SEV_1", "normal": "SEV_3", "minor": "SEV_4"}


def blank(c: str | Column) -> Column:
    c = C.column(c)
    return c.isNull() | (c == "")


def issues(as_of: datetime | str) -> Column:
    """The rules a row breaks."""
    rules = [
        (blank("id"), "missing_or_invalid_id"),
        (F.col("created_date").isNull(), "missing_or_invalid_created_date"),
        (blank("status"), "missing_status"),
        (F.col("updated_date") < F.col("created_date"), "updated_date_before_created_date"),
        (F.col("resolved_date") < F.col("created_date"), "resolved_date_before_created_date"),
        (F.col("created_date") > C.moment(as_of), "future_created_date"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def checked(t: DataFrame, as_of: datetime | str) -> DataFrame:
    return t.withColumn("issues", issues(as_of)).withColumn("is_valid", F.size("issues") == 0)


def split(t: DataFrame, as_of: datetime | str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid ones with their issues."""
    c = checked(t, as_of)
    return c.where("is_valid").drop("issues", "is_valid"), c.where("not is_valid")


def issue_counts(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """(D2)"""
    return checked(t, as_of).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def lightly_valid(t: DataFrame) -> DataFrame:
    """id, creation and status are there. (D3)"""
    return t.where(~blank("id") & F.col("created_date").isNotNull() & ~blank("status"))


def normal_status(c: str | Column) -> Column:
    """(D4)"""
    c = C.column(c)
    return F.when(blank(c), "Open").otherwise(C.lookup(F.trim(F.lower(c)), STATUS, c))


def normal_severity(c: str | Column) -> Column:
    """(D5)"""
    c = C.column(c)
    return F.when(blank(c), "SEV_3").otherwise(C.lookup(F.trim(F.lower(c)), SEVERITY, c))


def clean_text(c: str | Column) -> Column:
    """Runs of white space become a space, ends and control characters go."""
    spaced = F.regexp_replace(F.coalesce(C.column(c), F.lit("")), r"(?U)\s+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, "^ | $", ""), r"[\x00-\x1f\x7f-\x9f]", "")


def clean_assignee(c: str | Column) -> Column:
    """(D7)"""
    return F.trim(F.substring_index(F.coalesce(C.column(c), F.lit("")), "@", 1))


def clean(t: DataFrame) -> DataFrame:
    """Normal status, severity and text."""
    return t.withColumns(
        {"status": normal_status("status"), "severity": normal_severity("severity"), "title": clean_text("title"), "description": clean_text("description"), "assignee": F.when(F.col("assignee").isNotNull(), clean_assignee("assignee"))}
    )


def repair(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """Missing updates and statuses filled in, dates put in order."""
    created = F.least(F.col("created_date"), C.moment(as_of))
    t = t.withColumn("created_date", F.when(F.col("created_date").isNotNull(), created))
    late = lambda c: F.when(F.col(c) < F.col("created_date"), F.col("created_date")).otherwise(F.col(c))
    return t.withColumns(
        {
            "updated_date": F.coalesce(late("updated_date"), "created_date"), "resolved_date": late("resolved_date"),
            "status": F.when(blank("status"), "Open").otherwise(F.col("status")), "severity": F.when(blank("severity"), "SEV_3").otherwise(F.col("severity")),
        }
    )


def require(t: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows without a required date go; other required fields get their defaults."""
    defaults = {"status": "Open", "severity": "SEV_3", "title": "", "description": "", "assignee": "", "resolver_group": ""}
    dates = [f for f in fields if f.endswith("_date") or f == "id"]
    return t.dropna(subset=dates).fillna({f: defaults[f] for f in fields if f in defaults}) if dates else t.fillna({f: defaults[f] for f in fields if f in defaults})


def process(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """Validate, clean, repair, validate again."""
    return split(repair(clean(split(t, as_of)[0]), as_of), as_of)[0]


def repair_first(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """Clean and repair, so that what can be mended isn't dropped, then validate."""
    return split(repair(clean(t), as_of), as_of)[0]


def clean_raw(raw: DataFrame) -> DataFrame:
    """(D14)"""
    text = lambda c: F.when(F.col(c).isNotNull(), clean_text(c))
    return raw.withColumns({"status": normal_status("status"), "severity": normal_severity("severity"), "title": text("title"), "description": text("description")})


def prune(t: DataFrame) -> DataFrame:
    """Blank strings become null, in columns, arrays and maps; trimmed else."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = {}
    for f in t.schema:
        kind = f.dataType.simpleString()
        if kind == "string":
            out[f.name] = full(F.col(f.name))
        elif kind == "array<string>":
            out[f.name] = F.filter(F.transform(f.name, full), lambda x: x.isNotNull())
        elif kind == "map<string,string>":
            out[f.name] = F.map_filter(F.transform_values(f.name, lambda k, v: full(v)), lambda k, v: v.isNotNull())
    return t.withColumns(out) if out else t
