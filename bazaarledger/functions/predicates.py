"""Predicates that depend on report parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from enum import Enum
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_set(value: Any) -> bool:
    """An empty list is the same as no list."""
    return value is not None and not (isinstance(value, (tuple, list, set, frozenset)) and len(value) == 0)


def optional(predicate: Callable[[Any], Column], value: Any) -> Column:
    """`predicate(value)`, or TRUE when the parameter is unset."""
    return predicate(value) if is_set(value) else F.lit(True)


def one_of(column: Column, values: Iterable[Any] | None) -> Column:
    """Optional list membership."""
    return optional(lambda chosen: column.isin(list(chosen)), values)


def any_of(columns: Iterable[Column], values: Iterable[Any] | None) -> Column:
    """Some column holds one of the values (id or name or brand); TRUE when unset."""
    return optional(lambda chosen: reduce(or_, [column.isin(list(chosen)) for column in columns]), values)


def by_mode(mode: Enum | None, tests: Mapping[Enum, Callable[[], Column]]) -> Column:
    """The predicate a mode stands for; modes without an entry do not filter."""
    return tests[mode]() if mode in tests else F.lit(True)


def contains_ci(text: Column, part: str) -> Column:
    return F.lower(text).contains(part.lower())


def in_null_safe(column: Column, values: Iterable[str]) -> Column:
    return F.coalesce(column, F.lit("")).isin(list(values))


def not_in_null_safe(column: Column, values: Iterable[str]) -> Column:
    """Negated membership that keeps NULLs."""
    return ~in_null_safe(column, values)
