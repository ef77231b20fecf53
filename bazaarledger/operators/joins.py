"""Join shapes shared by the reports.

No join here forces a broadcast: lookups can grow with the marketplace, so Spark decides from its size estimates
(`spark.sql.autoBroadcastJoinThreshold`) and adaptive execution re-decides from measured sizes, splitting hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = str | Column


def _column(key: Key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def enrich(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[tuple[Key, Key]],
    take: Mapping[str, Key],
    how: str = "left",
) -> DataFrame:
    """Equi-join a lookup and bring only the `take` columns.

    `on` pairs (expression on df, expression on lookup); `take` maps new column name -> lookup expression. Keys matched
    more than once multiply rows, as in the reports.
    """
    names = [f"__key{i}" for i in range(len(on))]
    right = lookup.select(
        *[_column(theirs).alias(name) for name, (_, theirs) in zip(names, on)],
        *[_column(source).alias(name) for name, source in take.items()],
    )
    condition = reduce(and_, [_column(ours) == F.col(name) for name, (ours, _) in zip(names, on)])
    return df.join(right, condition, how).drop(*names)


def semi_filter(df: DataFrame, keys: DataFrame, on: Sequence[tuple[Key, Key]]) -> DataFrame:
    """Rows whose key is in `keys`; never multiplies rows."""
    names = [f"__key{i}" for i in range(len(on))]
    right = keys.select(*[_column(theirs).alias(name) for name, (_, theirs) in zip(names, on)])
    condition = reduce(and_, [_column(ours) == F.col(name) for name, (ours, _) in zip(names, on)])
    return df.join(right, condition, "left_semi")


def _valid_at(at: Column, low: Column, high: Column, closed: str) -> Column:
    if closed == "both":
        return at.between(low, high)
    if closed == "left":
        return (at >= low) & (at < high)
    raise ValueError(f"closed must be 'both' or 'left', not {closed!r}")


def join_valid(
    df: DataFrame,
    ranges: DataFrame,
    on: Sequence[tuple[Key, Key]],
    at: Key,
    start: Key,
    end: Key,
    take: Mapping[str, Key],
    closed: str = "both",
    how: str = "left",
) -> DataFrame:
    """Join to the ranges in force at `at`: equi keys plus a residual, so the plan stays a hash or merge join.

    Overlapping ranges multiply rows.
    """
    names = [f"__key{i}" for i in range(len(on))]
    right = ranges.select(
        *[_column(theirs).alias(name) for name, (_, theirs) in zip(names, on)],
        _column(start).alias("__low"),
        _column(end).alias("__high"),
        *[_column(source).alias(name) for name, source in take.items()],
    )
    condition = reduce(and_, [_column(ours) == F.col(name) for name, (ours, _) in zip(names, on)])
    condition = condition & _valid_at(_column(at), F.col("__low"), F.col("__high"), closed)
    return df.join(right, condition, how).drop(*names, "__low", "__high")


def join_valid_by_day(
    df: DataFrame,
    ranges: DataFrame,
    on: Sequence[tuple[Key, Key]],
    at: Key,
    start: Key,
    end: Key,
    take: Mapping[str, Key],
    closed: str = "both",
    how: str = "left",
    instants: DataFrame | None = None,
) -> DataFrame:
    """`join_valid` for coarse instants (days): ranges are resolved once per distinct (keys, day).

    With few keys (countries) and many ranges each, testing every range per fact row is wasted work and the equi key is
    hot. The distinct pass is pre-aggregated map-side; the fact join is then a plain equality on (keys, day). It evaluates df a
    second time unless `instants` gives the keys and days of df (more do no harm) from a cheaper source, under the same names.
    """
    ours = [f"__our{i}" for i in range(len(on))]
    df = df.withColumns({**{name: _column(key) for name, (key, _) in zip(ours, on)}, "__at": _column(at)})
    source = df if instants is None else instants.withColumns({
        **{name: _column(key) for name, (key, _) in zip(ours, on)}, "__at": _column(at),
    })
    instants = source.select(*ours, "__at").distinct()
    in_force = join_valid(
        instants, ranges, [(name, theirs) for name, (_, theirs) in zip(ours, on)], "__at", start, end, take, closed, "inner"
    )
    pairs = [(name, name) for name in [*ours, "__at"]]
    return enrich(df, in_force, pairs, {name: name for name in take}, how).drop(*ours, "__at")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join keeping both sides' columns; adds booleans `in_left`, `in_right`.

    Columns of the two inputs must differ except for the key, which comes out as `key` (left) and `right_<key>`.
    """
    right = right.withColumnRenamed(key, f"right_{key}")
    joined = left.join(right, F.col(key) == F.col(f"right_{key}"), "full")
    return joined.withColumns({"in_left": F.col(key).isNotNull(), "in_right": F.col(f"right_{key}").isNotNull()})


def exists_any(keys: Sequence[Column]) -> Column:
    """At least one of several left-joined relations matched."""
    return reduce(or_, [key.isNotNull() for key in keys])
