"""Aggregation shapes shared by the reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import Grain, between_days, clamped_bucket, day_literal
from ..functions.predicates import one_of


def pivot_max(df: DataFrame, key: str, state: str, columns: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """One row per key; output column -> (state name, expression), largest value seen in that state."""
    return df.groupBy(key).agg(
        *[F.max(F.when(F.col(state) == wanted, value)).alias(name) for name, (wanted, value) in columns.items()]
    )


def largest_per_state(df: DataFrame, key: str, state: str, value: str) -> DataFrame:
    """(key, state, value), one row each with the largest value, as `pivot_max` would show it: for long texts.

    An aggregate over text sorts the rows that carry it. Here keys and states are counted first, two narrow columns; only the
    few that occur more than once go through the text aggregate, all others are passed on as they are. NULL states are left out.
    """
    rows = df.where(F.col(state).isNotNull()).select(key, state, value)
    counted = rows.groupBy(F.col(key).alias("__key"), F.col(state).alias("__state")).agg(F.count(F.lit(1)).alias("__n"))
    repeated = counted.where("__n > 1").drop("__n")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col(state) == F.col("__state"))
    once = rows.join(repeated, same, "left_anti")
    largest = rows.join(repeated, same, "left_semi").groupBy(key, state).agg(F.max(value).alias(value))
    return once.unionByName(largest)


def spread_by_type(df: DataFrame, amounts: Mapping[str, tuple[Column, Column]], otherwise: float | None = 0.0) -> DataFrame:
    """Add one column per transaction type: output column -> (type test, amount); other types get `otherwise`."""
    fallback = F.lit(otherwise).cast("double")
    return df.withColumns({name: F.when(test, value).otherwise(fallback) for name, (test, value) in amounts.items()})


def collapse_max(df: DataFrame, keys: Sequence[str], amounts: Sequence[str], earliest: Sequence[str] = ()) -> DataFrame:
    """Largest amount per key, with the earliest time of the group."""
    return df.groupBy(*keys).agg(
        *[F.min(name).alias(name) for name in earliest], *[F.max(name).alias(name) for name in amounts]
    )


def bucket_agg(
    df: DataFrame,
    day: Column,
    grain: Grain,
    start: date | str,
    end: date | str,
    keys: Sequence[str],
    measures: Mapping[str, Column],
) -> DataFrame:
    """Aggregate per time bucket and keys, bucket bounds cut to the period."""
    low, high = clamped_bucket(day, grain, start, end)
    keyed = df.withColumns({"start_date": low, "end_date": high})
    return keyed.groupBy(*keys, "start_date", "end_date").agg(*[m.alias(name) for name, m in measures.items()])


def derive_metrics(df: DataFrame, *steps: Mapping[str, Column]) -> DataFrame:
    """Add metrics computed from aggregates; later steps may use earlier ones."""
    for step in steps:
        df = df.withColumns(dict(step))
    return df


def sum_list(items: Column, value: Callable[[Column], Column]) -> Column:
    """Sum over a list inside one row: no explode, no shuffle. NULL elements are skipped, as `sum` does.

    NULL when the list is NULL, empty or has no usable value.
    """
    usable = F.filter(F.transform(items, value), lambda amount: amount.isNotNull())
    total = F.aggregate(usable, F.lit(0.0), lambda total, amount: total + amount)
    return F.when(F.size(usable) > 0, total)


def sum_exploded(df: DataFrame, key: str, items: Column, values: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Sum list elements per key across rows, for keys that may repeat."""
    exploded = df.select(key, F.explode(items).alias("__item"))
    return exploded.groupBy(key).agg(*[F.sum(value(F.col("__item"))).alias(name) for name, value in values.items()])


def net_amount(credit: Column, debit: Column) -> Column:
    return F.sum(credit - debit)


def customer_history(
    bookings: DataFrame,
    start: date | str | None,
    end: date | str | None,
    countries: Sequence[int] = (),
    cities: Sequence[int] = (),
) -> DataFrame:
    """Attempts, completions and USD spend before and after promo per customer over a history window."""
    done = F.col("booking_state_simple") == "COMPLETED"

    def completed(value: Column) -> Column:
        return F.sum(F.when(done, value).otherwise(0))

    window = between_days(F.to_date("date_local"), start, end)
    wanted = window & one_of(F.col("country_id"), countries) & one_of(F.col("city_id"), cities)
    basket, promo, rate = F.col("basket_size"), F.col("promo_expense"), F.col("fx_one_usd")
    history = bookings.where(wanted).groupBy("passenger_id").agg(
        F.count(F.lit(1)).alias("total_attempted_orders"),
        completed(F.lit(1)).alias("total_completed_orders"),
        completed(F.try_divide(basket, rate)).alias("total_basket_size_pre_discount_usd"),
        completed(F.try_divide(basket - promo, rate)).alias("total_basket_size_after_discount_usd"),
    )
    bounds = {"history_start_date": start, "history_end_date": end}
    return history.withColumns(
        {name: day_literal(day) if day is not None else F.lit(None).cast("date") for name, day in bounds.items()}
    )
