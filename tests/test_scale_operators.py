"""Operators for large and uneven inputs: equal to their plain forms, and of the plan they promise."""

from __future__ import annotations

import dataclasses
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bazaarledger.operators import intervals, skew
from bazaarledger.operators.aggregates import largest_per_state
from bazaarledger.operators.intervals import join_valid_binned
from bazaarledger.operators.joins import enrich, join_valid, reconcile
from bazaarledger.operators.key_filter import KeyFilter
from bazaarledger.operators.skew import enrich_hot, reconcile_hot
from bazaarledger.plans import early_payment_report, payments, promo_report, ratings_report, single_payment_report, split_payment_report
from bazaarledger.plans.params import EarlyPaymentParams, PaymentParams, PromoParams, RatingsParams
from bazaarledger.functions.dates import Grain
from bazaarledger.sources.bucketed import bucketed, write_bucketed
from bazaarledger.sources.partitions import CompactDate, YearMonthDay, partition_between
from bazaarledger.sources.tables import Tables
from checks import operators
from checks.adapters import CODES, REGIONS, marketplace
from checks.reports import DEALT, by_order, on_edges, with_variants


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture
def shuffled(spark):
    """No broadcast by size, no adaptive changes: plans and partitions as written."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def rows(df) -> Counter:
    return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def task_sizes(df) -> list[int]:
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("closed", ["both", "left"])
@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_binned_ranges_equal_plain_ranges(spark, how, closed, kind):
    dice = random.Random(f"{how}{closed}{kind}")
    moment = lambda: f"2024-{dice.randint(1, 12):02d}-{dice.randint(1, 28):02d} {dice.randint(0, 23):02d}:{dice.choice(['00', '30'])}:00"
    facts = [(dice.choice([1, 1, 1, 2, None]), dice.choice([moment(), None]) if k % 9 == 0 else moment()) for k in range(300)]
    ranges = [(dice.choice([1, 1, 2, 3]), *(sorted([moment(), moment()]) if k % 4 else [moment(), dice.choice([None, "9999-12-31 00:00:00", "1999-01-01 00:00:00"])]), k) for k in range(60)]
    facts = spark.createDataFrame(facts, "k int, at string").withColumn("at", F.col("at").cast(kind))
    ranges = spark.createDataFrame(ranges, "k int, low string, high string, v int").withColumns({c: F.col(c).cast(kind) for c in ("low", "high")})
    arguments = (facts, ranges, [("k", "k")], "at", "low", "high", {"v": "v"}, closed, how)
    assert rows(join_valid_binned(*arguments)) == rows(join_valid(*arguments))


def test_a_hot_key_meets_few_ranges_per_row(shuffled):
    ranges = shuffled.range(5000).selectExpr(
        "1 as k", "id as v", "timestampadd(HOUR, cast(id as int), timestamp'2024-01-01') as low", "timestampadd(HOUR, cast(id + 5 as int), timestamp'2024-01-01') as high")
    facts = shuffled.range(2000).selectExpr("1 as k", "timestampadd(MINUTE, cast(id * 100 as int), timestamp'2024-01-01') as at")
    probes = facts.select(F.explode(intervals._probes(F.col("at"), intervals.WIDTHS)).alias("p"))
    cuts = ranges.select(F.explode(intervals._cuts(F.col("low"), F.col("high"), intervals.WIDTHS)).alias("c"))
    candidates = probes.join(cuts, F.col("p") == F.col("c")).count()
    assert candidates <= 2000 * 60  # of 2000 * 5000 pairs that share the key
    joined = join_valid_binned(facts, ranges, [("k", "k")], "at", "low", "high", {"v": "v"}, "left", "inner")
    assert re.search(r"Left keys \[\d\]: [^\n]*level[^\n]*bucket", plan(joined)) and "NestedLoop" not in plan(joined)
    assert max(task_sizes(joined)) < 0.5 * joined.count()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("closed", ["both", "left"])
@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_merged_ranges_equal_plain_ranges(spark, how, closed, kind):
    dice = random.Random(f"{how}{closed}{kind}m")
    moment = lambda: f"{dice.choice([2023, 2024, 2024, 2024])}-{dice.randint(1, 12):02d}-{dice.randint(1, 28):02d} {dice.randint(0, 23):02d}:{dice.choice(['00', '30'])}:{dice.choice(['00', '07', '59.5'])}"
    again, bounds = [moment() for _ in range(40)], ["0001-01-01 00:00:00", "9999-12-31 00:00:00", "1969-12-31 23:59:59", None]
    facts = [(n % 250, dice.choice([1, 1, 1, 2, 5, None]), dice.choice([moment(), *again, None])) for n in range(300)]  # rows that come twice, too
    ranges = [(dice.choice([1, 1, 2, 3, None]), *sorted([dice.choice(again), moment()]), dice.choice([k, k, None])) for k in range(60)]
    ranges += [(dice.choice([1, 2]), *dice.sample([*bounds, *again[:4]], 2), k) for k in range(60)]
    ranges += [(1, again[k], again[k], k) for k in range(9)]
    facts = spark.createDataFrame(facts, "n int, k int, at string").withColumn("at", F.col("at").cast(kind))
    ranges = spark.createDataFrame(ranges, "k int, low string, high string, v int").withColumns({c: F.col(c).cast(kind) for c in ("low", "high")})
    arguments = (facts, ranges, [("k", "k")], "at", "low", "high")
    plain = join_valid(*arguments, {"v": "v"}, closed, how).groupBy("n").agg(F.count("v").alias("c"), F.sum("v").alias("s"), F.min("v").alias("l"), F.max("v").alias("h"))
    taken, merge = dict.fromkeys("cslh", "v"), {"c": "count", "s": "sum", "l": "min", "h": "max"}
    merged = join_valid_binned(*arguments, taken, closed, how, merge=merge).groupBy("n").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.sum("s").alias("s"), F.min("l").alias("l"), F.max("h").alias("h"))
    assert rows(merged) == rows(plain)
    with pytest.raises(ValueError):
        join_valid_binned(*arguments, taken, closed, how, merge={"c": "avg", "s": "sum", "l": "min", "h": "max"})


def test_the_priced_events_compare_few_ranges(shuffled, tmp_path):
    """The check itself: what its join gives does not grow with the number of lists an event lies in."""
    lists = shuffled.range(3000).selectExpr("id * 3 as p_partkey", "49 as p_size")
    events = shuffled.range(500).selectExpr("id as event_id", "0L as user_id", "timestampadd(MINUTE, cast(20000 + id as int), timestamp_ntz'2024-01-01') as ts")
    lists.write.parquet(str(tmp_path / "part.parquet"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    joined = {}

    def kept(*arguments, **more):
        joined["rows"] = join_valid_binned(*arguments, **more)
        return joined["rows"]

    found = rows(operators._priced(operators.Source(shuffled, str(tmp_path)), kept, "inner"))
    want = Counter()
    starts = [(k * 3, k * 3 * 37 % 40000) for k in range(3000)]
    for n in range(500):
        held = [part for part, low in starts if low <= 20000 + n < low + 49 * 49]
        want[(n, sum(held), len(held))] += bool(held)
    assert found == +want and max(r[2] for r in found) > 100
    assert joined["rows"].count() <= 500 * 10


@pytest.mark.parametrize("how", ["inner", "left"])
def test_merged_ranges_give_few_rows_for_many_matches(spark, how):
    ranges = spark.range(3000).selectExpr("1 as k", "id as v", "timestampadd(MINUTE, -cast(id as int), timestamp'2024-01-01') as low", "timestampadd(MINUTE, cast(id as int), timestamp'2025-01-01') as high")
    facts = spark.range(400).selectExpr("id", "1 as k", "timestampadd(MINUTE, cast(id * 60 as int), timestamp'2024-01-02') as at")
    arguments = (facts, ranges, [("k", "k")], "at", "low", "high")
    assert join_valid_binned(*arguments, {"v": "v"}, "left", how).count() == 400 * 3000
    merged = join_valid_binned(*arguments, {"v": "v"}, "left", how, merge={"v": "sum"})
    assert merged.count() == 400 and {r.v for r in merged.collect()} == {2999 * 1500}


def test_a_left_binned_join_shuffles_no_matches(shuffled):
    ranges = shuffled.range(200).selectExpr("1 as k", "id as v", "timestamp'2024-01-01' as low", "timestamp'2024-01-09' as high")
    facts = shuffled.range(100).selectExpr("id", "1 as k", "timestampadd(HOUR, cast(id * 3 as int), timestamp'2024-01-01') as at")
    joined = join_valid_binned(facts, ranges, [("k", "k")], "at", "low", "high", {"v": "v"}, "left", "left")
    tree = plan(joined).split("\n\n")[0]
    below = tree[tree.index("LeftAnti") :]  # only this join has the rows of df beside what was found
    assert "LeftOuter" not in tree and "Inner" not in below and "LeftSemi" in below
    assert joined.count() == 64 * 200 + 36


def test_hot_lookup_keys_are_dealt_out(shuffled):
    facts = shuffled.range(20_000).selectExpr("id", "if(id % 10 < 3, 7, id % 500) as k")  # one key holds 30 % of the rows
    lookup = shuffled.range(400).selectExpr("id as k", "concat('n', id) as name").unionByName(shuffled.range(7, 8).selectExpr("id as k", "'again' as name"))
    plain = enrich(facts, lookup, [("k", "k")], {"name": "name"})
    dealt = enrich_hot(facts, lookup, [("k", "k")], {"name": "name"}, ["id"], hot_rows=300)
    assert rows(dealt) == rows(plain)
    sizes = task_sizes(dealt)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] < task_sizes(plain)[-1] / 2
    narrow = facts.select("k")
    assert rows(enrich_hot(facts, lookup, [("k", "k")], {"name": "name"}, ["id"], "inner", 300, narrow)) == rows(enrich(facts, lookup, [("k", "k")], {"name": "name"}, "inner"))


@pytest.mark.parametrize("seed", range(3))
def test_full_join_of_uneven_keys(shuffled, seed):
    dice = random.Random(seed)
    key = lambda hot: dice.choice([None, hot, hot, -hot, dice.randint(1, 60), dice.randint(30, 90)])
    left = shuffled.createDataFrame([(key(7), n) for n in range(400)], "k int, a int")
    right = shuffled.createDataFrame([(key(dice.choice([7, 8])), n) for n in range(120)], "k int, b int")
    assert rows(reconcile_hot(left, right, "k", ["a"], ["b"], hot_rows=15)) == rows(reconcile(left, right, "k"))


def test_full_join_deals_out_hot_and_null_keys(shuffled):
    left = shuffled.range(12_000).selectExpr("case when id % 4 = 0 then null when id % 4 < 3 then 5 else id end as k", "id as a")
    right = shuffled.range(3000).selectExpr("if(id % 3 = 0, null, id) as k", "id as b")
    joined = reconcile_hot(left, right, "k", ["a"], ["b"], hot_rows=200)
    assert rows(joined) == rows(reconcile(left, right, "k"))
    sizes = task_sizes(joined)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_full_join_repeats_rows_of_a_key_hot_on_both_sides_little(shuffled, monkeypatch):
    def repeated(n_left: int, n_right: int, hot_rows: int) -> tuple[int, ...]:
        ways = skew._places(skew._ways(F.lit(n_left), hot_rows), skew._ways(F.lit(n_right), hot_rows))
        wide, tall = shuffled.range(1).select(*[w.alias(f"w{k}") for k, w in enumerate(ways)]).first()
        return wide, tall, n_left * tall + n_right * wide

    assert repeated(400, 120, 15)[:2] == (27, 8)
    wide, tall, moved = repeated(1_800_000, 14_400, 100)
    assert moved < 25_000_000 and skew.MOST_PLACES <= wide * tall < 1.3 * skew.MOST_PLACES  # 18,000 x 144 places would move 518,400,000 rows
    monkeypatch.setattr(skew, "MOST_PLACES", 16)
    left = shuffled.range(900).selectExpr("case when id % 3 = 0 then id when id % 7 = 0 then null when id % 5 = 0 then -5 else 5 end as k", "id as a")
    right = shuffled.range(300).selectExpr("case when id % 2 = 0 then 5 when id % 11 = 0 then null when id % 3 = 0 then -6 else id end as k", "id as b")
    joined = reconcile_hot(left, right, "k", ["a"], ["b"], hot_rows=2)
    assert rows(joined) == rows(reconcile(left, right, "k"))
    assert "Inner" in plan(joined) and "FullOuter" in plan(joined)


def test_key_filter_keeps_every_key_and_drops_most_others(spark):
    keys = spark.range(5000).selectExpr("concat('B', id * 3) as key").unionByName(spark.createDataFrame([(None,)], "key string"))
    facts = spark.range(100_000).selectExpr("if(id % 1000 = 999, null, concat('B', id)) as code", "id")
    kept = KeyFilter(keys, "key").keep(facts, F.col("code"))
    codes = {r.code for r in kept.collect()}
    wanted = {f"B{k * 3}" for k in range(5000) if k * 3 % 1000 != 999}
    assert wanted <= codes and len(codes) < len(wanted) * 1.01 and kept.columns == facts.columns
    assert KeyFilter(keys.where("false"), "key").keep(facts, F.col("code")).count() == 0
    crowded = KeyFilter(keys, "key", bits=1 << 12).keep(facts, F.col("code"))
    assert wanted <= {r.code for r in crowded.collect()}


def test_key_filter_comes_before_the_shuffle(shuffled):
    keys = shuffled.range(100).selectExpr("id as key")
    facts = shuffled.range(10_000).selectExpr("id as k", "id % 7 as v")
    text = plan(KeyFilter(keys, "key").keep(facts, F.col("k")).groupBy("v").count())
    tree = text[: text.index("(1)")]
    assert tree.index("HashAggregate") < tree.index("Exchange") < tree.index("BroadcastHashJoin")


def test_largest_text_sorts_only_repeated_states(shuffled):
    states = shuffled.createDataFrame([
        (1, "policy", "b"), (1, "policy", "a"), (1, "ticket", "z"), (2, "policy", None), (2, "policy", "q"), (3, "policy", "only"),
        (None, "policy", "x"), (None, "policy", "y"), (4, None, "nothing"), (5, "policy", None),
    ], "case int, state string, text string")
    found = largest_per_state(states, "case", "state", "text")
    assert rows(found) == rows(states.where("state is not null").groupBy("case", "state").agg(F.max("text").alias("text")))
    text = plan(found)
    counting = [block for block in text.split("\n\n") if "HashAggregate" in block.split("\n")[0] and "count(1)" in block]
    assert counting and not any(re.search(r"\btext#", block) for block in counting)
    once = text[text.index("LeftAnti") - 2000 : text.index("LeftAnti")]
    assert "max(" not in once  # rows met once pass no text aggregate


@pytest.fixture
def market(spark, sf_dir):
    return marketplace(spark, sf_dir)


PAYMENT = PaymentParams(start="1995-01-01", end="2001-12-31", as_of="2001-08-10", codes=CODES)
EARLY = EarlyPaymentParams(start="1995-01-01", end="2001-12-31", delivered_start="1995-01-01", delivered_end="2001-12-31", codes=CODES)


@pytest.mark.parametrize("report,params", [(split_payment_report, PAYMENT), (single_payment_report, PAYMENT), (early_payment_report, EARLY)])
def test_bucketed_orders_and_bookings_are_not_shuffled(shuffled, market, report, params):
    shuffled.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))  # lookups as usual, facts are told apart below
    text = plan(report(by_order(market), params))
    exchanged = [block for block in text.split("\n\n") if block.lstrip().split("\n")[0].endswith(") Exchange")]
    assert "Bucketed: true" in text
    by_key = [block for block in exchanged if re.search(r"hashpartitioning\(order_id#\d+", block)]
    assert not any("snapshot_detail" in block or "booking_state" in block or "driver_fare" in block for block in by_key)
    assert text.count("SelectedBucketsCount: 8 out of 8") >= 2


def test_finished_payment_rows_are_shuffled_once_for_each_merchant(shuffled, market):
    """Broadcasts off: lookups and payouts of the sub-merchant share a shuffle, those of the merchant another one."""
    text = plan(split_payment_report(market, PAYMENT))
    exchanged = [block for block in text.split("\n\n") if block.lstrip().split("\n")[0].endswith(") Exchange")]
    wide = [block for block in exchanged if re.search(r"Input \[\d+\]: [^\n]*net_payable", block)]
    by = [re.search(r"hashpartitioning\((.*), \d+\)", block).group(1) for block in wide]
    assert len([keys for keys in by if "cluster" not in keys and "cancel" not in keys]) == 2, by


@pytest.mark.parametrize("chains", [(), ("CH1", "CH2")])
def test_merchant_lookups_that_repeat_multiply_orders_as_one_after_the_other(spark, chains):
    frame = lambda schema, *data: spark.createDataFrame(list(data), schema)
    tables = Tables.of({
        "merchant": frame("merchant_id string, name string, chain_number string", ("a", "A", "CH1"), ("a", "A2", "CH2"), ("b", "B", "CH3"), ("c", "C", None), (None, "N", "CH1"), ("e", "E", "CH1")),
        "merchant_contract": frame("merchant_id string, wallet_account_id string, invoice_email string", ("a", "wa", "x"), ("b", "wb", None), (None, "wn", "y")),
        "bank_account": frame("store_wallet_account_id string, account_number string, swift_code string, bank_statement_code string, bank_name_id int", ("wa", "1", "s", "t", 1), ("wa", "2", "s", "t", None)),
        "bank": frame("id int, bank_name string", (1, "one")),
        "driver": frame("identification_card_number string, id int", ("a", 7), ("a", 8), ("d", 9), (None, 10), ("c", 11)),
        "legacy_bank_account": frame("user_id int, acc_number string, bank_id int", (7, "n7", 1), (9, "n9", None), (10, "n10", 1)),
        "legacy_bank": frame("id int, code string", (1, "LB")),
        "cancel_reason": frame("cancel_code int, cancel_reason_enum string", (1, "R")),
    })
    orders = spark.createDataFrame([(n, m, n % 2) for n, m in enumerate(["a", "b", "c", "d", "e", "f", None, "a"])], "order_id int, merchant_id string, cancel_code int")
    params = PaymentParams(start="1995-01-01", end="2001-12-31", as_of="2001-08-10", codes=CODES, chains=chains)
    profile = payments.merchant_profile(tables).where(F.col("chain_number").isin(*chains)) if chains else payments.merchant_profile(tables)
    names = ("merchant_name", "wallet_account_id", "invoice_contact_email", *payments.BANK_COLUMNS)
    plain = enrich(orders, profile, [("merchant_id", "merchant_id")], {n: n for n in names}, "inner" if chains else "left")
    names = ("merchant_account_id", *payments.LEGACY_BANK_COLUMNS)
    plain = enrich(plain, payments.account_profile(tables), [("merchant_id", "identification_card_number")], {n: n for n in names})
    plain = enrich(plain, tables["cancel_reason"], [("cancel_code", "cancel_code")], {"cancel_reason_enum": "cancel_reason_enum"})
    assert rows(payments.with_merchant(tables, orders, params)) == rows(plain)
    hot = dataclasses.replace(params, hot_merchant_rows=1)
    tables = Tables(lambda name, known=tables: orders.withColumn("partition_date", F.lit("1996-01-01")) if name == "order_snapshot" else known[name])
    assert rows(payments.with_merchant(tables, orders, hot)) == rows(plain)


def test_bucketed_copies_are_compressed_well(spark, market, tmp_path):
    write_bucketed(market["booking_base"], "small_copy_of_bookings", ["order_id"], 2, str(tmp_path / "copy"))
    files = list((tmp_path / "copy").glob("*.parquet"))
    assert len(files) == 2 and all("zstd" in f.name for f in files)
    spark.sql("drop table small_copy_of_bookings")


def test_bucketed_copies_keep_their_rows(spark, market):
    copies = bucketed(market, {"booking_base": ["order_id"]}, 4, "copy_of_bookings_")
    assert rows(copies["booking_base"]) == rows(market["booking_base"]) and copies["merchant"] is market["merchant"]
    spark.sql("drop table copy_of_bookings_booking_base")


def test_variant_documents_are_not_parsed_again(spark, market, tmp_path):
    typed = with_variants(market)
    typed["order_snapshot"].limit(50).write.parquet(str(tmp_path / "orders"))
    stored = spark.read.parquet(str(tmp_path / "orders"))
    tables = Tables(lambda name: stored if name == "order_snapshot" else market[name])
    for report, params in ((split_payment_report, PAYMENT), (promo_report, PromoParams(regions=REGIONS, start="1995-01-01", end="2001-12-31"))):
        text = plan(report(tables, params))
        assert "try_variant_get" in text and "from_json(StructField(newTaxFlow" not in text and "from_json(StructField(cartWithQuote" not in text


def test_ratings_read_their_inputs_once(spark, market):
    text = plan(ratings_report(market, RatingsParams(grain=Grain.WEEK, start="2024-01-01", end="2024-01-31", include_orders=True)))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert sum("event_type" in line for line in schemas) == 1 and sum("s_suppkey" in line for line in schemas) == 1


def test_every_partitioned_input_is_dealt_over_edges():
    assert {"app_log", "wallet_tx", "cashier_payment", "order_snapshot", "refund_approved", "payment_booking", "ticket", "refund_request"} <= set(DEALT)


def test_rows_dealt_over_edges_keep_their_days_and_cost_one_number_a_test(spark, market):
    windows = dict.fromkeys(DEALT, (10, 2))
    edges = on_edges(**windows)(market)
    for name, (column, ways, key) in DEALT.items():
        number = F.substr(F.expr(column), F.lit(2)).cast("bigint")
        found = edges[name].select((F.floor(number / ways) % 4).alias("place"), key.value().alias("day")).distinct()
        days = {0: "1994-12-21", 1: "1994-12-22", 2: "1995-01-03" if name == "cashier_payment" else "2002-01-02", 3: "1995-01-04" if name == "cashier_payment" else "2002-01-03"}
        wanted = {(place, day.replace("-", "") if isinstance(key, CompactDate) else day) for place, day in days.items()}
        assert {tuple(r) for r in found.where("place is not null").collect()} == wanted, name
    kept = partition_between(edges["refund_approved"], "1995-01-01", "2001-12-31", 10, 2, YearMonthDay()).select("booking_code")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("substr(") <= 8  # year twice, all three parts twice
