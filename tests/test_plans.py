"""Plan shapes that must hold at scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from bazaarledger.operators.joins import enrich, join_valid, join_valid_by_day
from bazaarledger.plans import cash_report, promo_report, single_payment_report, split_payment_report
from bazaarledger.plans.params import BusinessLine, CashParams, Delivery, PaymentParams, PromoParams, YesNo
from bazaarledger.sources.partitions import CompactDate, DateText, YearMonthDay, partition_between
from bazaarledger.sources.tables import Tables
from checks.adapters import REGIONS, marketplace
from checks.reports import report_queries


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(report_queries()))
def test_reports_never_pair_everything(spark, sf_dir, name):
    text = plan(report_queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text and "Python" not in text


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """Two fact tables written the way a warehouse keeps them."""
    root = str(tmp_path_factory.mktemp("tables"))
    market = marketplace(spark, sf_dir)
    market["order_snapshot"].where("partition_date < '1995-03-01'").write.partitionBy("partition_date").parquet(f"{root}/order_snapshot")
    market["wallet_tx"].where("year = '1995' and month in ('1', '2', '3')").coalesce(1).write.partitionBy(
        "year", "month", "day").parquet(f"{root}/wallet_tx")
    names = {"order_snapshot", "wallet_tx"}
    return Tables(lambda name: spark.read.parquet(f"{root}/{name}") if name in names else market[name])


def test_partition_windows_prune_directories(spark, stored):
    orders = partition_between(stored["order_snapshot"], "1995-01-10", "1995-01-12", 1, 1, DateText())
    assert {r.d for r in orders.select(F.input_file_name().alias("f")).select(
        F.regexp_extract("f", "partition_date=([0-9-]+)", 1).alias("d")).distinct().collect()} <= {
            "1995-01-09", "1995-01-10", "1995-01-11", "1995-01-12", "1995-01-13"}
    for df in (orders, partition_between(stored["wallet_tx"], "1995-01-10", "1995-02-01", 2, 2, YearMonthDay())):
        filters = [line for line in plan(df).splitlines() if line.startswith("PartitionFilters")]
        assert filters and filters[0] != "PartitionFilters: []"


def test_partition_windows_keep_the_right_days(spark):
    days = ["1995-12-31", "1996-01-01", "1996-01-02", "1996-02-10", "1996-02-11"]
    rows = [(d, d.replace("-", ""), *[str(int(part)) for part in d.split("-")]) for d in days]
    df = spark.createDataFrame(rows, "partition_date string, compact string, year string, month string, day string")
    for key in (DateText(), CompactDate("compact"), YearMonthDay()):
        kept = partition_between(df, "1996-01-02", "1996-02-09", 1, 1, key).select("partition_date").collect()
        assert sorted(r.partition_date for r in kept) == days[1:4]
    assert partition_between(df, None, "1996-01-01", 5, 0, YearMonthDay()).count() == 2
    assert partition_between(df, None, None).count() == 5


def test_payment_scan_is_pruned_and_parsed_once(spark, stored):
    params = PaymentParams(start="1995-01-05", end="1995-01-20", as_of="1995-03-01", countries=(1, 2))
    text = plan(single_payment_report(stored, params))
    scan = text[text.index("partition_date"):]
    assert "partition_date" in text and "reward_id" not in scan[:scan.index("ReadSchema")]
    assert "EqualTo(order_type,1)" in text and "In(country_id, [1,2])" in text
    assert text.count("foodQuoteInMin,StructType") == 1


def _without_broadcasts(spark, build):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key, None) for key in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        return plan(build())
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _exchanged(text: str) -> str:
    """Input columns of all exchanges."""
    blocks = text.split("\n\n")
    return "\n".join(b for b in blocks if b.lstrip().split("\n")[0].endswith(") Exchange"))


SWITCHES = dict(delivery=Delivery.DELIVERY, pos_integrated=YesNo.NO, business_line=BusinessLine.MARKET, chains=("CH1", "CH2"))


@pytest.mark.parametrize("report", [single_payment_report, split_payment_report])
def test_documents_are_parsed_once_and_never_shuffled(spark, stored, report):
    params = PaymentParams(start="1995-01-05", end="1995-01-20", as_of="1995-03-01", **SWITCHES)
    text = _without_broadcasts(spark, lambda: report(stored, params))
    assert text.count("foodQuoteInMin,StructType") == 1 and text.count("from_json(StructField(partnerOrderSubmitTime") == 1
    moved = _exchanged(text)
    assert "hashpartitioning" in moved
    assert not re.search(r"\b(snapshot_detail|metadata|doc|meta)#", moved)


def test_promo_documents_are_parsed_once_and_never_shuffled(spark, stored, sf_dir):
    params = PromoParams(regions=REGIONS, start="1995-01-05", end="1995-01-20", cities=(1, 2, 3))
    text = _without_broadcasts(spark, lambda: promo_report(stored, params))
    assert text.count("from_json(StructField(cartWithQuote") == 1
    assert not re.search(r"\b(snapshot_detail|doc)#", _exchanged(text))


def test_rates_are_resolved_from_two_columns_of_the_fact(spark, sf_dir):
    text = plan(report_queries()["r10"](spark, sf_dir))
    scans = [line for line in text.splitlines() if line.startswith("ReadSchema") and "s_acctbal" in line]
    assert len(scans) == 1  # the merchant dimension is read once


def test_regions_must_be_named(spark, stored):
    with pytest.raises(ValueError, match="regions"):
        promo_report(stored, PromoParams(regions=()))


def test_no_forced_broadcast(spark, sf_dir):
    """With the size threshold at zero nothing is broadcast, so no lookup is exempt from the size check."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key, None) for key in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        text = plan(cash_report(marketplace(spark, sf_dir), CashParams()))
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_range_joins_keep_their_equi_key(spark):
    facts = spark.createDataFrame([(1, "2024-01-05"), (1, "2024-01-31"), (2, "2024-01-05"), (None, "2024-01-05")], "k int, d string")
    facts = facts.withColumn("day", F.to_date("d"))
    ranges = spark.createDataFrame(
        [(1, "2024-01-01", "2024-01-31", 1.0), (1, "2024-01-05", "2024-01-05", 2.0), (3, "2024-01-01", "2024-01-31", 3.0)],
        "k int, low string, high string, rate double",
    ).withColumns({"low": F.to_date("low"), "high": F.to_date("high")})
    results = []
    for join in (join_valid, join_valid_by_day):
        df = join(facts, ranges, [("k", "k")], "day", "low", "high", {"rate": "rate"})
        assert "NestedLoop" not in plan(df)
        results.append(sorted((r.k or 0, r.d, r.rate or 0.0) for r in df.collect()))
    assert results[0] == results[1] == [
        (0, "2024-01-05", 0.0), (1, "2024-01-05", 1.0), (1, "2024-01-05", 2.0), (1, "2024-01-31", 1.0), (2, "2024-01-05", 0.0),
    ]
    half_open = join_valid(facts, ranges, [("k", "k")], "day", "low", "high", {"rate": "rate"}, "left", "inner")
    assert [(r.d, r.rate) for r in half_open.collect()] == [("2024-01-05", 1.0)]


def test_enrich_repeats_rows_on_duplicate_keys(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert sorted((r.k, r.v or "") for r in enrich(left, right, [("k", "k")], {"v": "v"}).collect()) == [(1, "a"), (1, "b"), (2, "")]
