"""Period arithmetic shared by the reports."""

from __future__ import annotations

from datetime import date, timedelta

from ..sources.partitions import as_date


def widened(start: date | str | None, end: date | str | None, before: int = 0, after: int = 0):
    """The period moved out by whole days; an unset bound stays unset."""
    first, last = as_date(start), as_date(end)
    return (
        first - timedelta(days=before) if first else None,
        last + timedelta(days=after) if last else None,
    )
