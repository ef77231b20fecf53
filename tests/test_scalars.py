"""Scalar, date and predicate helpers against hand-computed values."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazaarledger.functions import scalars as sc
from bazaarledger.functions.dates import Grain, bucket_start, clamped_bucket, compact_date
from bazaarledger.functions.predicates import any_of, not_in_null_safe, one_of, optional
from bazaarledger.operators.aggregates import sum_list
from bazaarledger.operators.explode import explode_keep_empty, explode_list, explode_or_default
from bazaarledger.sources.documents import REFUND_ITEMS


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("minor, exponent, expected", [
    ("1999", None, 19.99), ("1999", 0, 1999.0), ("1999", 2, 19.99), ("12.5", None, 0.125), ("", None, None), (None, None, None),
    ("oops", 2, None),
])
def test_minor_to_major(spark, minor, exponent, expected):
    text = F.lit(minor).cast("string")
    assert value(spark, sc.minor_to_major(text, None if exponent is None else F.lit(exponent))) == expected


@pytest.mark.parametrize("minor, expected", [("1999", 19), ("-1999", -19), ("x", None)])
def test_whole_units_truncate_toward_zero(spark, minor, expected):
    assert value(spark, sc.minor_to_major_whole(F.lit(minor))) == expected


@pytest.mark.parametrize("top, bottom, expected", [(1, 4, 0.25), (1, 0, None), (1, None, None), (None, 2, None)])
def test_safe_ratio(spark, top, bottom, expected):
    assert value(spark, sc.safe_ratio(F.lit(top).cast("bigint"), F.lit(bottom).cast("bigint"))) == expected


def test_decode_nested_json(spark):
    text = '{"stateData":"{\\"Issue\\":\\"cold\\",\\"n\\":[{\\"a\\":1}]}"}'
    assert value(spark, sc.decode_nested_json(F.lit(text))) == '{"stateData":{"Issue":"cold","n":[{"a":1}]}}'


@pytest.mark.parametrize("text, expected", [
    ("2024-01-01T10:00:00", dt.datetime(2024, 1, 1, 10)), ("2024-01-01T10:00:00Z", dt.datetime(2024, 1, 1, 10)),
    ("2024-01-01T10:00:00+08:00", dt.datetime(2024, 1, 1, 2)), ("soon", None),
])
def test_iso_time(spark, text, expected):
    assert value(spark, sc.iso_time(F.lit(text)).cast("timestamp_ntz")) == expected


def test_local_date_crosses_midnight(spark):
    ts = F.lit("2024-01-01 20:00:00").cast("timestamp")
    assert value(spark, sc.local_date(ts, F.lit("Asia/Singapore"))) == dt.date(2024, 1, 2)
    assert value(spark, sc.local_date(ts, F.lit("America/New_York"))) == dt.date(2024, 1, 1)
    assert value(spark, sc.local_date(ts, F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("day, grain, expected", [
    ("2024-01-03", Grain.MONTH, ("2024-01-02", "2024-01-31")), ("2024-02-10", Grain.MONTH, ("2024-02-01", "2024-02-20")),
    ("2024-01-02", Grain.WEEK, ("2024-01-02", "2024-01-07")), ("2024-02-20", Grain.WEEK, ("2024-02-19", "2024-02-20")),
    ("2024-01-09", Grain.WEEK, ("2024-01-08", "2024-01-14")), ("2024-03-09", Grain.DAY, ("2024-03-09", "2024-03-09")),
    ("2024-01-09", Grain.TOTAL, ("2024-01-02", "2024-02-20")), (None, Grain.MONTH, (None, "2024-02-20")),
])
def test_buckets_are_cut_to_the_period(spark, day, grain, expected):
    low, high = clamped_bucket(F.lit(day).cast("date"), grain, "2024-01-02", "2024-02-20")
    row = spark.range(1).select(low.cast("string").alias("low"), high.cast("string").alias("high")).first()
    assert (row.low, row.high) == expected


def test_total_has_no_row_bucket():
    with pytest.raises(ValueError):
        bucket_start(None, Grain.TOTAL)


def test_compact_date(spark):
    assert value(spark, compact_date(F.lit("20240105"))) == dt.date(2024, 1, 5)


def test_unset_filters_keep_everything(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    assert df.where(one_of(F.col("name"), ()) & optional(lambda v: F.col("id") == v, None) & any_of([F.col("name")], None)).count() == 2
    assert df.where(one_of(F.col("name"), ["a"])).count() == 1
    assert df.where(any_of([F.col("name"), F.col("id").cast("string")], ["2"])).count() == 1


def test_negated_membership_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "name string")
    assert {r.name for r in df.where(not_in_null_safe(F.col("name"), ["a"])).collect()} == {"b", None}


def test_explode_variants_on_null_and_empty(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None)], "id int, items array<string>")
    items = F.col("items")
    assert {(r.id, r.e) for r in explode_list(df, items, "e").collect()} == {(1, "x"), (1, "y")}
    assert {(r.id, r.e) for r in explode_or_default(df, items, F.lit("d"), "e").collect()} == {(1, "x"), (1, "y"), (3, "d")}
    assert {(r.id, r.e) for r in explode_keep_empty(df, items, "e").collect()} == {(1, "x"), (1, "y"), (2, None)}


@pytest.mark.parametrize("items, expected", [(["1", "2.5"], 3.5), (["1", None, "x"], 1.0), ([], None), (None, None), (["x"], None)])
def test_sum_list_acts_like_sum(spark, items, expected):
    df = spark.createDataFrame([(items,)], "items array<string>")
    assert df.select(sum_list(F.col("items"), sc.number).alias("v")).first().v == expected


@pytest.mark.parametrize("text", ["", "not json", None, '["broken'])
def test_malformed_refund_items_give_no_rows(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert explode_list(df, F.from_json(sc.decode_nested_json(F.col("t")), REFUND_ITEMS), "i").where("i.ItemName is not null").count() == 0
