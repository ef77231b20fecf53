"""Date-partition windows in the three key encodings the inputs use.

Every predicate is a comparison of partition columns with literals, so it is resolved while listing partitions and no
file outside the window is opened.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_date(value: date | str | None) -> date | None:
    return date.fromisoformat(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class DateText:
    """One text column `yyyy-MM-dd`."""

    column: str = "partition_date"

    def value(self) -> Column:
        return F.col(self.column)

    def text(self, day: date) -> str:
        return day.isoformat()

    def coarse(self, first: date | None, last: date | None) -> list[Column]:
        return []


@dataclass(frozen=True)
class CompactDate(DateText):
    """One text column `yyyyMMdd`."""

    def text(self, day: date) -> str:
        return day.strftime("%Y%m%d")


@dataclass(frozen=True)
class YearMonthDay:
    """Three text columns; month and day may or may not be zero-padded."""

    year: str = "year"
    month: str = "month"
    day: str = "day"

    def value(self) -> Column:
        return F.concat(
            F.col(self.year), F.lit("-"), F.lpad(F.col(self.month), 2, "0"), F.lit("-"), F.lpad(F.col(self.day), 2, "0")
        )

    def text(self, day: date) -> str:
        return day.isoformat()

    def coarse(self, first: date | None, last: date | None) -> list[Column]:
        """Plain per-column bounds a metastore can use; the exact test is on the joined text."""
        bounds = []
        if first:
            bounds.append(F.col(self.year) >= F.lit(str(first.year)))
        if last:
            bounds.append(F.col(self.year) <= F.lit(str(last.year)))
        if first and last and first <= last:
            steps = (last.year - first.year) * 12 + last.month - first.month
            if steps < 11:
                months = {(first.month - 1 + i) % 12 + 1 for i in range(steps + 1)}
                spellings = {str(m) for m in months} | {f"{m:02d}" for m in months}
                bounds.append(F.col(self.month).isin(sorted(spellings)))
        return bounds


PartitionKey = DateText | YearMonthDay


def partition_between(
    df: DataFrame,
    start: date | str | None,
    end: date | str | None,
    before: int = 0,
    after: int = 0,
    key: PartitionKey = DateText(),
) -> DataFrame:
    """Keep partitions from `start - before` days to `end + after` days; an unset bound is open."""
    first = as_date(start) - timedelta(days=before) if start else None
    last = as_date(end) + timedelta(days=after) if end else None
    tests = key.coarse(first, last)
    if first:
        tests.append(key.value() >= F.lit(key.text(first)))
    if last:
        tests.append(key.value() <= F.lit(key.text(last)))
    for test in tests:
        df = df.where(test)
    return df
