"""Joins whose hot keys are known beforehand: found by counting, their rows dealt out over several tasks.

Adaptive execution splits a hot partition only after everything was shuffled, and never one of a full join. Here the keys with more
than `hot_rows` rows are counted first (narrow, combined map-side). At most `MOST_HOT` of them, the hottest, are handled apart,
so their table may be broadcast; any others are joined as usual. Results are those of the plain joins, row for row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import Key, _column

#: Hot keys handled apart; bounds what is broadcast, not what is joined.
MOST_HOT = 1000
#: Rows of one key that a task may take.
HOT_ROWS = 1_000_000
#: Places that the pairs of one key in a full join are dealt over at most; more would only repeat rows more often.
MOST_PLACES = 4096
#: Ways that rows with a NULL key, which match nothing, are dealt out.
NULL_WAYS = 1024


def _spread(columns: Sequence[Key]) -> Column:
    """The same for a row at every attempt, unlike a random number."""
    return F.xxhash64(*[_column(c) for c in columns])


def _ways(rows: Column, hot_rows: int) -> Column:
    return F.greatest(F.ceil(rows / hot_rows), F.lit(1)).cast("int")


def _places(wide: Column, tall: Column) -> tuple[Column, Column]:
    """Ways of both sides, cut down by the same factor where all pairs of them are more than `MOST_PLACES`."""
    less = F.greatest(F.sqrt(wide.cast("double") * tall / MOST_PLACES), F.lit(1.0))
    return F.ceil(wide / less).cast("int"), F.ceil(tall / less).cast("int")


def enrich_hot(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[tuple[Key, Key]],
    take: Mapping[str, Key],
    spread: Sequence[Key],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """`enrich` for keys of df that hold a large share of its rows.

    Rows of a hot key get one of several salts, from a hash of the `spread` columns (an id of the row, say), and the key's lookup rows
    are repeated once per salt. df is evaluated twice, the first time for the keys alone, unless `counted` gives the keys of df (more
    or fewer rows do no harm) from a cheaper source, under the same names.
    """
    names, ours = [f"__key{i}" for i in range(len(on))], [f"__our{i}" for i in range(len(on))]
    df = df.withColumns({name: _column(key) for name, (key, _) in zip(ours, on)})
    source = df if counted is None else counted.withColumns({name: _column(key) for name, (key, _) in zip(ours, on)})
    counts = source.groupBy(*ours).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > hot_rows) & reduce(and_, [F.col(c).isNotNull() for c in ours]))
    hot = counts.orderBy(F.desc("__n"), *ours).limit(MOST_HOT).withColumn("__ways", _ways(F.col("__n"), hot_rows)).drop("__n")

    def ways(side: DataFrame, keys: Sequence[str]) -> DataFrame:
        known = hot.withColumnsRenamed({name: f"{name}_hot" for name in ours})
        match = reduce(and_, [F.col(key) == F.col(f"{name}_hot") for key, name in zip(keys, ours)])
        return side.join(F.broadcast(known), match, "left").drop(*[f"{name}_hot" for name in ours])

    right = ways(lookup.select(
        *[_column(theirs).alias(name) for name, (_, theirs) in zip(names, on)],
        *[_column(source).alias(name) for name, source in take.items()],
    ), names)
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("__ways", F.lit(1)) - 1)).alias("__copy")).drop("__ways")
    left = ways(df, ours).withColumn("__salt", F.pmod(_spread(spread), F.coalesce("__ways", F.lit(1))).cast("int")).drop("__ways")
    condition = reduce(and_, [F.col(our) == F.col(name) for our, name in zip(ours, names)]) & (F.col("__salt") == F.col("__copy"))
    return left.join(right, condition, how).drop(*names, *ours, "__salt", "__copy")


def reconcile_hot(
    left: DataFrame, right: DataFrame, key: str, left_spread: Sequence[Key], right_spread: Sequence[Key], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`reconcile` (a full outer join with `in_left` and `in_right`) for hot and NULL keys on either side.

    Rows of a hot key are dealt out on both sides, and repeated for the ways of the other side if that has the key at all; these meet by an
    inner join, as all have partners. Ways of both sides are cut down alike where they would make more than `MOST_PLACES` places, so that a key
    is repeated least for that many. All other rows meet by a full join, those with a NULL key, which match nothing, dealt out over
    `NULL_WAYS`. Both inputs are evaluated three times.
    """
    right = right.withColumnRenamed(key, f"right_{key}")
    counts = left.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n_left")).where("__hot is not null")
    theirs = right.groupBy(F.col(f"right_{key}").alias("__hot")).agg(F.count(F.lit(1)).alias("__n_right")).where("__hot is not null")
    most = F.greatest(F.coalesce("__n_left", F.lit(0)), F.coalesce("__n_right", F.lit(0)))
    hot = counts.join(theirs, "__hot", "full").withColumn("__most", most).where(F.col("__most") > hot_rows)
    wide, tall = (_ways(F.coalesce(f"__n_{side}", F.lit(0)), hot_rows) for side in ("left", "right"))
    wide, tall = _places(wide, tall)
    # ties go by key: hot keys are worked out for each use anew and must be the same ones
    hot = hot.orderBy(F.desc("__most"), "__hot").limit(MOST_HOT).select(
        "__hot", (F.col("__n_left").isNotNull() & F.col("__n_right").isNotNull()).alias("__matched"),
        wide.alias("__ways_left"), tall.alias("__ways_right"),
    )

    def known(side: DataFrame, name: str) -> DataFrame:
        return side.join(F.broadcast(hot), F.col(name) == F.col("__hot"), "left")

    def paired(side: DataFrame, name: str, own: str, other: str, spread: Sequence[Key]) -> DataFrame:
        """Rows of the hot keys that both sides have, at their places."""
        rows = known(side, name).where("__matched").withColumn(f"__{own}_{own}", F.pmod(_spread(spread), F.col(f"__ways_{own}")).cast("int"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col(f"__ways_{other}") - 1)).alias(f"__{own}_{other}"))
        return rows.drop("__hot", "__matched", "__ways_left", "__ways_right")

    def others(side: DataFrame, name: str, own: str, spread: Sequence[Key]) -> DataFrame:
        """All other rows; NULL keys and those that only this side has are dealt out, as they have no partner to be met at one place."""
        ways = F.when(F.col(name).isNull(), NULL_WAYS).otherwise(F.coalesce(f"__ways_{own}", F.lit(1)))
        rows = known(side, name).where(~F.coalesce("__matched", F.lit(False)))
        return rows.withColumn(f"__way_{own}", F.pmod(_spread(spread), ways).cast("int")).drop("__hot", "__matched", "__ways_left", "__ways_right")

    same = F.col(key) == F.col(f"right_{key}")
    a, b = paired(left, key, "left", "right", left_spread), paired(right, f"right_{key}", "right", "left", right_spread)
    met = a.join(b, same & (F.col("__left_left") == F.col("__right_left")) & (F.col("__left_right") == F.col("__right_right")))
    a, b = others(left, key, "left", left_spread), others(right, f"right_{key}", "right", right_spread)
    rest = a.join(b, same & (F.col("__way_left") == F.col("__way_right")), "full")
    joined = met.drop(*[f"__{x}_{y}" for x in ("left", "right") for y in ("left", "right")]).unionByName(rest.drop("__way_left", "__way_right"))
    return joined.withColumns({"in_left": F.col(key).isNotNull(), "in_right": F.col(f"right_{key}").isNotNull()})
