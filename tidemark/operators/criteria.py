"""Search criteria that compile to one predicate. (B)"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C


def named_range(name: str, as_of: datetime) -> tuple[datetime, datetime]:
    """today, yesterday, week, month or quarter, seen from a moment."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if name == "today":
        return midnight, as_of
    if name == "yesterday":
        return midnight - timedelta(days=1), midnight - timedelta(microseconds=1)
    days = {"week": 7, "month": 30, "quarter": 90}
    if name not in days:
        raise ValueError(f"no such range: {name}")
    return as_of - timedelta(days=days[name]), as_of


@dataclass(frozen=True)
class Criteria:
    """What to search for; all that is given must hold."""

    ids: Sequence[str] = ()
    statuses: Sequence[str] = ()
    severities: Sequence[str] = ()
    assignees: Sequence[str] = ()
    resolver_groups: Sequence[str] = ()
    tags: Sequence[str] = ()
    phrase: str | None = None
    created_after: datetime | None = None
    created_before: datetime | None = None
    updated_after: datetime | None = None
    updated_before: datetime | None = None
    exclude_resolved: bool = False
    automated: Column | None = None
    limit: int | None = 1000
    offset: int = 0

    def checked(self) -> Criteria:
        """Itself, if limits and ranges make sense."""
        if self.limit is not None and not 1 <= self.limit <= 10_000:
            raise ValueError("limit must be from 1 to 10000")
        if self.offset < 0:
            raise ValueError("offset must not be negative")
        for a, b in ((self.created_after, self.created_before), (self.updated_after, self.updated_before)):
            if a and b and a >= b:
                raise ValueError("a range must begin before it ends")
        return self

    def predicate(self) -> Column:
        """One condition; Catalyst pushes what it can to the source."""
        parts = [F.col(c).isin(*v) for c, v in (("id", self.ids), ("status", self.statuses), ("severity", self.severities), ("assignee", self.assignees), ("resolver_group", self.resolver_groups)) if v]
        for c, a, b in (("created_date", self.created_after, self.created_before), ("updated_date", self.updated_after, self.updated_before)):
            parts += [F.col(c) >= C.moment(a)] if a else []
            parts += [F.col(c) <= C.moment(b)] if b else []
        if self.tags:
            parts.append(F.size(F.array_except(F.array(*map(F.lit, self.tags)), "tags")) == 0)
        if self.phrase:
            parts.append(F.lower("title").contains(self.phrase.lower()) | F.lower("description").contains(self.phrase.lower()))
        if self.exclude_resolved:
            parts.append(~F.col("status").isin(*C.RESOLVED))
        if self.automated is not None:
            parts.append(~F.coalesce(self.automated, F.lit(False)))
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out


def last_days(t: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    """Rows created in the days before a moment, 1 to 365."""
    if not 1 <= days <= 365:
        raise ValueError("days must be from 1 to 365")
    return t.where(F.col("created_date") >= C.moment(as_of) - F.make_dt_interval(F.lit(days)))


def search(t: DataFrame, criteria: Criteria) -> DataFrame:
    """Matching rows; limited in the order of creation, so that the same rows come each time."""
    c = criteria.checked()
    rows = t.where(c.predicate())
    if c.limit is None and not c.offset:
        return rows
    rows = rows.orderBy("created_date", "id").offset(c.offset)
    return rows if c.limit is None else rows.limit(c.limit)


def top(t: DataFrame, by: str, k: int, *keys: str) -> DataFrame:
    """The k rows with the largest value, ties by the keys."""
    return t.orderBy(F.desc(by), *keys).limit(k)
