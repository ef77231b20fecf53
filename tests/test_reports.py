"""Reports on hand-written inputs with hand-computed rows, and properties of their switches."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from bazaarledger.functions.dates import Grain
from bazaarledger.plans import cash_report, pnl_report, promo_report, ratings_report, refund_report
from bazaarledger.plans import payments as p
from bazaarledger.plans.params import (
    BusinessLine,
    CashParams,
    Completion,
    Delivery,
    PaymentParams,
    PnlParams,
    PromoParams,
    RatingsParams,
    RefundGrain,
    RefundParams,
    RefundSource,
    YesNo,
)
from bazaarledger.sources.documents import ORDER_DOCUMENT_WHOLE
from bazaarledger.sources.tables import Tables
from checks.adapters import CODES, marketplace
from checks.reports import AS_OF, END, START


@pytest.fixture
def make(spark):
    def build(**tables):
        return Tables.of({name: spark.createDataFrame(rows, schema) for name, (rows, schema) in tables.items()})

    return build


AT = dt.datetime(2024, 1, 5, 10)


def test_cash_report_collapses_types_and_sums_ledger_repeats(make):
    meta = json.dumps({"daxDeliveryFee": 500, "promotion": "150"})
    payment = "user_id bigint, user_type int, booking_code string, order_id string, created_at timestamp, payee_id string, order_mode int, tx_type int, tx_amount bigint, currency string, metadata string, year string, month string, day string"
    tables = make(
        cashier_payment=([
            (1, 2, "B1", "O1", AT, "M1", 1, 1, 1999, "SGD", meta, "2024", "1", "5"),
            (1, 2, "B1", "O1", AT, "M1", 2, 14, 100, "SGD", None, "2024", "1", "5"),
            (1, 2, "B2", "O2", AT, "M1", 3, 1, 1000, "SGD", "broken", "2024", "1", "5"),
            (1, 1, "B3", "O3", AT, "M1", 1, 1, 1000, "SGD", meta, "2024", "1", "5"),
            (1, 2, "B4", "O4", AT, "M1", 1, 1, 1000, "SGD", meta, "2024", "1", "9"),
        ], payment),
        order_booking=([("B1", "Bike", 7, "M1", "2024-01-05"), ("B2", "Bike", 8, "M9", "2024-01-05")],
                       "booking_code string, taxi_type_name string, driver_fleet_id bigint, restaurant_id string, partition_date string"),
        driver=([(1, "Ann", None)], "id bigint, name string, identification_card_number string"),
        fleet=([(7, "F7")], "id bigint, name string"),
        merchant_dim=([("M1", "Shop")], "merchant_id string, merchant_name string"),
        driver_ledger=([("B1", 3.0, "2024", "1", "5"), ("B1", 3.001, "2024", "1", "5"), ("B2", 1.0, "2024", "1", "5")],
                       "method string, amount double, year string, month string, day string"),
    )
    rows = {r.booking_id: r for r in cash_report(tables, CashParams(start="2024-01-04", end="2024-01-06")).collect()}
    assert set(rows) == {"B1", "B2"}
    first = rows["B1"]  # both ledger rows round to 3.00, so they share a group and the booking counts twice
    assert (first.fleet, first.driver_name, first.merchant_name, first.booking_type) == ("F7", "Ann", "Shop", "Cash")
    assert (first.earning_adjustments, first.delivery_fee, first.order_value, first.promo, first.cash_collection) == (2.0, 8.0, 42.98, 3.0, 47.98)
    second = rows["B2"]
    # the adjustment type and unreadable metadata leave NULL or zero, never an error
    assert (second.fleet, second.merchant_name, second.booking_type, second.order_value, second.promo) == (None, None, "Cashless", 10.0, 0.0)


def test_ratings_count_each_listed_category(make):
    tables = make(
        rating_feedback=([
            ("E1", "M1", 1, 5, "2024-01-03", "COMPLETED", 4, " Taste;Size; ", "ok"),
            ("E2", "M1", 1, 5, "2024-01-02", "CANCELLED", None, None, None),
            ("E3", "M1", 1, 5, "2024-01-10", "COMPLETED", 4, "Taste", None),
            ("E4", "M1", 1, 5, "2024-01-01", "COMPLETED", 4, "Taste", None),
        ], "order_id string, merchant_id string, taxi_type_id int, city_id int, date_local string, booking_state_simple string, pax_rating_for_merchant int, pax_rating_category string, pax_feedback_for_merchant string"),
        service_type=([(1, "Food", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 10))], "id int, name string, start_at timestamp, end_at timestamp"),
        merchant_dim=([("M1", "Shop", "Brand")], "merchant_id string, merchant_name string, business_name string"),
        city=([(5, 1)], "id int, country_id int"),
    )
    params = RatingsParams(grain=Grain.WEEK, start="2024-01-02", end="2024-01-31", include_orders=True)
    rows = ratings_report(tables, params).collect()
    assert {(r.aggregation_level, r.pax_rating_for_merchant, r.rating_category, r.no_of_orders, str(r.period_start)) for r in rows} == {
        ("Aggregated by Ratings", 4, "All", 1, "2024-01-01"), ("Aggregated by Ratings", None, "All", 1, "2024-01-01"),
        ("Aggregated by Ratings and Category", 4, "Taste", 1, "2024-01-01"),
        ("Aggregated by Ratings and Category", 4, "Size", 1, "2024-01-01"),
        ("Aggregated by Ratings and Category", 4, "", 1, "2024-01-01"),
        ("Order Level", 4, " Taste;Size; ", None, "2024-01-03"),
    }  # E3 falls on the open end of the validity range
    with pytest.raises(ValueError):
        ratings_report(tables, RatingsParams(grain=Grain.TOTAL))


def test_promo_report_truncates_and_fans_out(make):
    def doc(amount, base):
        return json.dumps({"cartWithQuote": {"promoCodes": [{"promoCode": "X", "promoAmountInMin": amount}],
                                             "foodQuoteInMin": {"reducedPriceInMinorUnit": base, "promoAmountInMinorUnit": amount}}})

    order = "order_id string, short_order_number string, last_booking_code string, order_state int, booking_state string, merchant_id string, created_time timestamp, reward_id bigint, city_id int, country_id int, snapshot_detail string, partition_date string"
    promos = "country string, promo_code string, reward_id string, start_date string, end_date string"
    tables = make(
        order_snapshot=([
            ("O1", "S", "B", 11, None, "M1", AT, 7, 1, 1, doc(1999, 5050), "2024-01-05"),
            ("O2", "S", "B", 11, None, "M1", AT, 7, 1, 1, json.dumps({"cartWithQuote": {}}), "2024-01-05"),
            ("O3", "S", "B", 11, None, "M1", AT, 9, 1, 1, doc(100, 100), "2024-01-05"),
        ], order),
        promo_a=([("Alpha", "P1", " 7 ", "2024-01-01", "2024-12-31")], promos),
        promo_b=([("Alpha", "P2", "7", "2024-01-01", "2024-12-31"), ("Alpha", "P3", "9", "2023-01-01", "2023-12-31")], promos),
        promo_order=([("O1", 1, "Alpha", 1, "City", "2024-01-05", 7, "MFP", 2.5), ("O9", 1, "Alpha", 1, "City", "2024-01-05", 7, "MFP", 1.0)],
                     "order_id string, country_id int, country_name string, city_id int, city_name string, date_local string, reward_id bigint, product_flag string, merchant_promo_spend double"),
        merchant_dim=([("M1", "Brand")], "merchant_id string, business_name string"),
    )
    params = PromoParams(regions=("promo_a", "promo_b"), start="2024-01-01", end="2024-01-31")
    rows = sorted((r.order_id or "", r.dashboard_order_id, r.total_promo_code_expense, r.total_basket_size, r.indicator, r.indicator_2)
                  for r in promo_report(tables, params).collect())
    hit = ("O1", "O1", 19, 70, "MFP", "In orders")
    assert rows == [("", "O9", None, None, "MFP", "Not in orders"), hit, hit]


def test_pnl_overlapping_rates_multiply(make, spark):
    names = ["gmv_usd", "basket_size", "sub_total", "delivery_fare", "driver_delivery_fare", "merchant_commission", "driver_commission",
             "incentives_usd", "spot_incentive_bonus_usd", "subsidy_usd", "total_partner_base_for_merchant_commission", "total_promo_spend_usd",
             "total_platform_promo_spend_usd", "total_discount_usd", "total_campaign_merchant_promo_spend_usd", "code_merchant_promo_spend_usd",
             "support_expense_usd", "ad_spend_usd", "small_order_fee_usd", "convenience_fee_usd", "platform_fee_usd", "shopper_fee_usd",
             "sheet_platform_promo_spend_usd"]
    base = spark.createDataFrame([("M1", "Land", "Town", d, s, o) for d, s, o in (("2024-01-05", 1.0, 1), ("2024-01-20", None, 0))],
                                 "merchant_id string, country_name string, city_name string, date_local string, sheet_merchant_promo_spend_usd double, completed_orders bigint")
    base = base.withColumns({**{n: F.lit(2.0) for n in names}, **{n: F.lit(1) for n in ("all_incoming_orders", "cancellations", "batched_orders")},
                             "partition_date_local": F.to_date("date_local"), "partner_status": F.lit("A"), "is_bd_account": F.lit(True),
                             "is_bd_partner": F.lit(False), "business_model": F.lit("m")})
    dims = make(
        merchant_dim=([("M1", "Shop", "Brand", "Food", "T", None)], "merchant_id string, merchant_name string, business_name string, vertical string, business_type_name string, am_name string"),
        city=([(1, "Town")], "id int, name string"), country=([(1, "Land")], "id int, name string"),
        fx_rate=([(1, "2024-01-01", "2024-01-05", 1.0), (1, "2024-01-05", "2024-01-31", 3.0)], "country_id int, start_date string, end_date string, exchange_one_usd double"),
    )
    tables = Tables(lambda name: base if name == "pnl_base" else dims[name])
    total = pnl_report(tables, PnlParams(start="2024-01-01", end="2024-01-31", unit_economics=True)).first()
    assert (total.gmv_usd, total.completed_orders, total.am_tagging) == (6.0, 2, "Non-AM")  # the 5th is in two ranges
    assert total.adj_gmv == 10.0  # the NULL row drops out of the strict sum
    assert total.exchange_one_usd == pytest.approx(7 / 3)
    assert total.gross_revenue == 42.0 and total.profit_before_overhead == 18.0 and total.profit_per_order == 9.0
    daily = pnl_report(tables, PnlParams(start="2024-01-01", end="2024-01-31", grain=Grain.DAY, unit_economics=True)).collect()
    assert sum(r.gmv_usd for r in daily) == total.gmv_usd
    assert [r.profit_per_order for r in daily if r.completed_orders == 0] == [None]


def test_refund_sub_items_keep_empty_and_drop_missing(spark, sf_dir):
    tables = marketplace(spark, sf_dir)
    period = {"start": START, "end": END, "sources": frozenset({RefundSource.REQUEST})}
    items = refund_report(tables, RefundParams(grain=RefundGrain.ITEM, **period)).count()
    subs = refund_report(tables, RefundParams(grain=RefundGrain.SUB_ITEM, **period))
    counts = {r.has: r["count"] for r in subs.groupBy(F.col("sub_item_name").isNotNull().alias("has")).count().collect()}
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority <> '5-LOW'")
    kinds = {r.k: r["count"] for r in lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy((F.col("l_linenumber") % 3).alias("k")).count().collect()}
    assert items == sum(kinds.values())
    assert counts == {False: kinds[1], True: 2 * kinds[2]}


def test_refund_sources_can_be_combined(spark, sf_dir):
    tables = marketplace(spark, sf_dir)
    def rows(*sources):
        return refund_report(tables, RefundParams(grain=RefundGrain.ITEM, start=START, end=END, sources=frozenset(sources))).count()

    assert rows(*RefundSource) == rows(RefundSource.REQUEST) + rows(RefundSource.CASE)
    with pytest.raises(ValueError):
        refund_report(tables, RefundParams(sources=frozenset()))


def _orders(spark, sf_dir, **switches):
    params = PaymentParams(start=START, end=END, as_of=AS_OF, codes=CODES, **switches)
    return p.payment_orders(marketplace(spark, sf_dir), params, ORDER_DOCUMENT_WHOLE, p.promo_fields(), 0, "inner").count()


def test_payment_switches_split_the_orders(spark, sf_dir):
    every = _orders(spark, sf_dir)
    for name, parts in {
        "delivery": (Delivery.TAKEAWAY, Delivery.DELIVERY), "completion": (Completion.COMPLETED_ONLY, Completion.EXCLUDE_COMPLETED),
        "pos_integrated": (YesNo.YES, YesNo.NO), "business_line": (BusinessLine.MARKET, BusinessLine.KITCHEN_SINGLE, BusinessLine.KITCHEN_MIXED),
    }.items():
        counts = [_orders(spark, sf_dir, **{name: part}) for part in parts]
        assert all(counts) and sum(counts) == every, name
    assert _orders(spark, sf_dir, business_line=BusinessLine.KITCHEN) == sum(
        _orders(spark, sf_dir, business_line=line) for line in (BusinessLine.KITCHEN_SINGLE, BusinessLine.KITCHEN_MIXED)
    )
    assert _orders(spark, sf_dir, countries=(1, 2)) < every and _orders(spark, sf_dir, order_ids=("O1",)) == 1
