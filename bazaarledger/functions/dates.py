"""Report periods and time buckets."""

from __future__ import annotations

from datetime import date
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Grain(str, Enum):
    TOTAL = "Total"
    MONTH = "By Month"
    WEEK = "By Week"
    DAY = "By Day"


def day_literal(day: date | str) -> Column:
    return F.lit(day if isinstance(day, str) else day.isoformat()).cast("date")


def bucket_start(day: Column, grain: Grain) -> Column:
    """First day of the month or (Monday) week holding `day`; the day itself at day grain."""
    if grain is Grain.MONTH:
        return F.trunc(day, "month")
    if grain is Grain.WEEK:
        return F.trunc(day, "week")
    if grain is Grain.DAY:
        return day
    raise ValueError(f"no per-row bucket for grain {grain}")


def bucket_end(day: Column, grain: Grain) -> Column:
    if grain is Grain.MONTH:
        return F.last_day(day)
    if grain is Grain.WEEK:
        return F.date_add(F.trunc(day, "week"), 6)
    return bucket_start(day, grain)


def clamped_bucket(day: Column, grain: Grain, start: date | str, end: date | str) -> tuple[Column, Column]:
    """Bucket bounds cut to the report period. Day buckets are not cut."""
    first, last = day_literal(start), day_literal(end)
    if grain is Grain.TOTAL:
        return first, last
    low, high = bucket_start(day, grain), bucket_end(day, grain)
    if grain is Grain.DAY:
        return low, high
    # not greatest/least: a NULL day keeps a NULL start and takes the period's end
    return F.when(low <= first, first).otherwise(low), F.when(high <= last, high).otherwise(last)


def compact_date(text: Column) -> Column:
    """`yyyyMMdd` text to a date."""
    return F.to_date(
        F.concat_ws("-", F.substr(text, F.lit(1), F.lit(4)), F.substr(text, F.lit(5), F.lit(2)), F.substr(text, F.lit(-2)))
    )


def between_days(day: Column, start: date | str | None, end: date | str | None) -> Column:
    """Closed day range; an unset bound is open."""
    test = F.lit(True)
    if start is not None:
        test = test & (day >= day_literal(start))
    if end is not None:
        test = test & (day <= day_literal(end))
    return test
