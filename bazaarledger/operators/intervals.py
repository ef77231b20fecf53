"""Range joins by time buckets: for keys with many ranges and instants too fine to be resolved once each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import Key, _column, _valid_at

DAY = 86_400
#: Bucket widths in seconds. A range goes by the finest width that cuts it into few buckets.
WIDTHS = (DAY, 32 * DAY, 1024 * DAY)
#: Most buckets a range is cut into; one that is longer at the widest width meets every row of its key.
MOST_BUCKETS = 33

#: Where ranges may be merged: seconds of the finest bucket, the levels of buckets, each 16 times as wide as the one below.
FINEST, LEVELS = 60, 8
#: How values of ranges are merged: of one range, of several, of merged ones.
MERGES = {
    "count": (lambda value: F.when(value.isNotNull(), 1).otherwise(0).cast("bigint"), F.count, F.sum),
    "sum": (lambda value: value, F.sum, F.sum),
    "min": (lambda value: value, F.min, F.min),
    "max": (lambda value: value, F.max, F.max),
}


def _bucket(moment: Column, width: int) -> Column:
    return F.floor(F.unix_seconds(moment.cast("timestamp")) / width)


def _cuts(low: Column, high: Column, widths: Sequence[int]) -> Column:
    """(level, bucket) pairs of a range."""
    def pairs(level: int) -> Column:
        buckets = F.sequence(_bucket(low, widths[level]), _bucket(high, widths[level]))
        return F.transform(buckets, lambda b: F.struct(F.lit(level).alias("level"), b.alias("bucket")))

    whole = F.array(F.struct(F.lit(len(widths)).alias("level"), F.lit(0).cast("bigint").alias("bucket")))
    cuts = None
    for level in range(len(widths)):
        few = _bucket(high, widths[level]) - _bucket(low, widths[level]) < MOST_BUCKETS
        cuts = F.when(few, pairs(level)) if cuts is None else cuts.when(few, pairs(level))
    return cuts.otherwise(whole)


def _probes(at: Column, widths: Sequence[int]) -> Column:
    """(level, bucket) pairs under which the ranges of an instant are found."""
    found = [F.struct(F.lit(level).alias("level"), _bucket(at, width).alias("bucket")) for level, width in enumerate(widths)]
    return F.array(*found, F.struct(F.lit(len(widths)).alias("level"), F.lit(0).cast("bigint").alias("bucket")))


def join_valid_binned(
    df: DataFrame,
    ranges: DataFrame,
    on: Sequence[tuple[Key, Key]],
    at: Key,
    start: Key,
    end: Key,
    take: Mapping[str, Key],
    closed: str = "both",
    how: str = "left",
    widths: Sequence[int] = WIDTHS,
    merge: Mapping[str, str] | None = None,
) -> DataFrame:
    """`join_valid` with the time bucket as part of the equality.

    Each range is cut into at most `MOST_BUCKETS` buckets of the finest width that allows it; a row probes its own bucket at
    each width. So a key with thousands of ranges compares a row with those near it only, and a hot key is spread over its
    buckets. The exact test follows inside. Instants and bounds may be dates or timestamps; NULLs and ranges that
    end before they start match nothing; overlapping ranges multiply rows.

    A left join adds the rows that no range holds: it finds the distinct (keys, instant) that meet one, so what is shuffled does not
    grow with the number of matches. df is evaluated three times, ranges twice.

    Where a row lies in so many ranges that only their totals are of use, `merge` gives for each taken column how its values are put
    together ("count", "sum", "min", "max"): a row then comes out once or a few times, with partial values to be put together by the
    caller. Ranges are merged where they hold the whole bucket of an instant, only those that begin or end in it are tested one by one.
    df is evaluated twice, ranges twice.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    if merge is not None:
        return _join_merged(df, ranges, on, at, start, end, take, closed, how, merge)
    if how == "inner":
        return _join_cut(df, ranges, on, at, start, end, take, closed, widths, "inner")
    ours = [f"__our{i}" for i in range(len(on))]
    df = df.withColumns({**{name: _column(key) for name, (key, _) in zip(ours, on)}, "__at": _column(at)})
    pairs = [(name, theirs) for name, (_, theirs) in zip(ours, on)]
    met = _join_cut(df, ranges, pairs, "__at", start, end, take, closed, widths, "inner")
    instants = df.select(*ours, "__at").distinct()
    held = _join_cut(instants, ranges, pairs, "__at", start, end, {}, closed, widths, "left_semi").distinct()
    held = held.withColumnsRenamed({name: f"{name}_held" for name in (*ours, "__at")})
    alone = df.join(held, reduce(and_, [F.col(name) == F.col(f"{name}_held") for name in (*ours, "__at")]), "left_anti")
    return met.unionByName(alone, allowMissingColumns=True).drop(*ours, "__at")


def _join_cut(
    df: DataFrame, ranges: DataFrame, on: Sequence[tuple[Key, Key]], at: Key, start: Key, end: Key, take: Mapping[str, Key], closed: str,
    widths: Sequence[int], how: str,
) -> DataFrame:
    """Rows of df with the ranges that hold them, or (left_semi) those that meet one, once for each width at which they do."""
    names = [f"__key{i}" for i in range(len(on))]
    cut = ranges.select(
        *[_column(theirs).alias(name) for name, (_, theirs) in zip(names, on)],
        _column(start).alias("__low"), _column(end).alias("__high"),
        *[_column(source).alias(name) for name, source in take.items()],
    ).where("__low <= __high")
    cut = cut.select("*", F.explode(_cuts(F.col("__low"), F.col("__high"), widths)).alias("__cut"))
    probing = df.withColumn("__moment", _column(at)).where("__moment is not null")
    probing = probing.select("*", F.explode(_probes(F.col("__moment"), widths)).alias("__probe"))
    condition = reduce(and_, [_column(ours) == F.col(name) for name, (ours, _) in zip(names, on)])
    condition = condition & (F.col("__probe.level") == F.col("__cut.level")) & (F.col("__probe.bucket") == F.col("__cut.bucket"))
    condition = condition & _valid_at(F.col("__moment"), F.col("__low"), F.col("__high"), closed)
    return probing.join(cut, condition, how).drop(*names, "__low", "__high", "__cut", "__probe", "__moment")


def _join_merged(
    df: DataFrame, ranges: DataFrame, on: Sequence[tuple[Key, Key]], at: Key, start: Key, end: Key, take: Mapping[str, Key], closed: str,
    how: str, merge: Mapping[str, str],
) -> DataFrame:
    """One equality on keys and finest bucket. Under it lie the ranges that begin or end in the bucket, and one row for all that hold it whole.

    The buckets between a range's first and last one are cut into the fewest buckets of all levels, values summed up under each of
    these; a finest bucket that has rows adds up what it finds on its way to the widest level.
    """
    if set(merge) != set(take) or not set(merge.values()) <= set(MERGES):
        raise ValueError(f"merge must give one of {', '.join(MERGES)} for each of {', '.join(take)}")
    names, ours = [f"__key{i}" for i in range(len(on))], [f"__our{i}" for i in range(len(on))]
    kept = ranges.select(
        *[_column(theirs).alias(name) for name, (_, theirs) in zip(names, on)],
        _column(start).alias("__low"), _column(end).alias("__high"),
        *[_column(source).alias(name) for name, source in take.items()],
    ).where("__low <= __high").withColumns({"__first": _bucket(F.col("__low"), FINEST), "__last": _bucket(F.col("__high"), FINEST)})
    edges = kept.select(
        *names, F.explode(F.array_distinct(F.array("__first", "__last"))).alias("__near"), F.lit(False).alias("__whole"), "__low", "__high",
        *[MERGES[kind][0](F.col(name)).alias(name) for name, kind in merge.items()],
    )

    # whole buckets [a, b) of a level, but for [c, d), those that make up whole buckets of the next level
    bounds = {"a": "-shiftright(-__first - 1, 4 * __level)", "b": "shiftright(__last, 4 * __level)"}
    bounds |= {"c": "-shiftright(-__first - 1, 4 * __level + 4) * 16", "d": "shiftright(__last, 4 * __level + 4) * 16"}
    parts = kept.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("__level")).withColumns({
        f"__{name}": F.expr(f"cast({text} as bigint)") for name, text in bounds.items()
    }).where("__a < __b")
    steps = f"""if(__c < __d and __level < {LEVELS - 1},
        concat(if(__a < __c, sequence(__a, __c - 1), array()), if(__d < __b, sequence(__d, __b - 1), array())), sequence(__a, __b - 1))"""
    parts = parts.select(*names, "__level", F.explode(F.expr(steps)).alias("__part"), *take)
    parts = parts.groupBy(*names, "__level", "__part").agg(*[MERGES[kind][1](name).alias(name) for name, kind in merge.items()])

    df = df.withColumns({**{name: _column(key) for name, (key, _) in zip(ours, on)}, "__at": _column(at)})
    df = df.withColumn("__bucket", _bucket(F.col("__at"), FINEST))
    used = df.select(*[F.col(name).alias(f"{name}_used") for name in ours], F.col("__bucket").alias("__near")).dropna().distinct()
    used = used.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("__up")).withColumn("__over", F.expr("shiftright(__near, 4 * __up)"))
    above = reduce(and_, [F.col(f"{our}_used") == F.col(name) for our, name in zip(ours, names)])
    above = above & (F.col("__up") == F.col("__level")) & (F.col("__over") == F.col("__part"))
    bound = edges.schema["__low"].dataType, edges.schema["__high"].dataType
    whole = used.join(parts, above).groupBy(*names, "__near").agg(*[MERGES[kind][2](name).alias(name) for name, kind in merge.items()]).select(
        *names, "__near", F.lit(True).alias("__whole"), F.lit(None).cast(bound[0]).alias("__low"), F.lit(None).cast(bound[1]).alias("__high"), *take)

    condition = reduce(and_, [F.col(our) == F.col(name) for our, name in zip(ours, names)]) & (F.col("__bucket") == F.col("__near"))
    condition = condition & (F.col("__whole") | _valid_at(F.col("__at"), F.col("__low"), F.col("__high"), closed))
    joined = df.join(edges.unionByName(whole), condition, how)
    return joined.drop(*names, *ours, "__at", "__bucket", "__near", "__whole", "__low", "__high")
