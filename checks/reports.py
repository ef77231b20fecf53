"""The thirteen reports on the adapted tables, each over the whole period of the data."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarledger import plans
from bazaarledger.functions.dates import Grain
from bazaarledger.plans.params import (
    BusinessLine,
    CashParams,
    Completion,
    Delivery,
    Dimension,
    EarlyPaymentParams,
    PaymentParams,
    PnlParams,
    PromoParams,
    RatingsParams,
    RefundGrain,
    RefundParams,
    RefundSource,
    SettlementParams,
    YesNo,
)
from bazaarledger.session import prepare
from bazaarledger.sources.bucketed import bucketed
from bazaarledger.sources.partitions import CompactDate, DateText, YearMonthDay, as_date
from bazaarledger.sources.tables import Tables

from .adapters import CODES, REGIONS, marketplace

Query = Callable[[SparkSession, str], DataFrame]

START, END = "1995-01-01", "2001-12-31"
AS_OF = "2001-08-10"
BOTH = frozenset(RefundSource)
REQUEST = frozenset({RefundSource.REQUEST})
CASE = frozenset({RefundSource.CASE})
PERIOD = {"start": START, "end": END}
MONTH = {"start": "1996-03-01", "end": "1996-03-31"}
ANY_DAY = {"start": None, "end": None}


def comparable(df: DataFrame) -> DataFrame:
    """Zone-free timestamps and double numbers, so another engine's result compares value by value."""
    def plain(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            return column.cast("timestamp_ntz").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return column.cast("double").alias(field.name)
        return column

    return df.select(*[plain(field) for field in df.schema.fields])


def _report(build: Callable[[Tables, object], DataFrame], params: object) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(build(marketplace(prepare(spark), sf_dir), params))

    return query


def _on(adapt: Callable[[Tables], Tables], build: Callable[[Tables, object], DataFrame], params: object) -> Query:
    """A report on the tables as `adapt` stores or types them."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(build(adapt(marketplace(prepare(spark), sf_dir)), params))

    return query


def by_order(tables: Tables) -> Tables:
    """Copies of the order facts stored by the keys they are joined on: order id, and booking code for those that have no other."""
    keys = {"order_snapshot": ["order_id"], "booking_base": ["order_id"], "order_booking": ["booking_code"]}
    return bucketed(tables, keys, 8, f"by_order_{uuid.uuid4().hex[:12]}_")


def by_ledger_day(tables: Tables) -> Tables:
    """The cashier ledger in partitions of the day it was written, not stamped into one week."""
    def stamped(name: str) -> DataFrame:
        rows = tables[name]
        if name != "cashier_payment":
            return rows
        return rows.withColumns({part: take("created_at").cast("string") for part, take in (("year", F.year), ("month", F.month), ("day", F.day))})

    return Tables(stamped)


#: Partitioned inputs: the column that holds the order's number, and how it is dealt over the edges of a window (`on_edges`).
DEALT = {
    "app_log": ("properties['orderID']", 1, YearMonthDay()), "refund_approved": ("booking_code", 1, YearMonthDay()),
    "driver_ledger": ("method", 1, YearMonthDay()), "wallet_tx": ("orderid", 4, YearMonthDay()),
    "payment_booking": ("booking_code", 4, YearMonthDay()), "order_booking": ("booking_code", 4, DateText()),
    "cashier_payment": ("order_id", 16, YearMonthDay()), "ticket": ("booking_code", 16, CompactDate()),
    "order_snapshot": ("order_id", 64, DateText()), "refund_request": ("source_id", 256, YearMonthDay()),
}


def on_edges(**windows: tuple[int, int]) -> Callable[[Tables], Tables]:
    """Tables whose partitions all lie on the edges of their windows, so that moving a window by one day changes the report.

    `windows` gives, by table, the days before the period's first day and after its last one. A row of order number n is put, by n // ways % 4,
    into the partition of the day before the window, its first or last day, or the day after it.
    """
    def stamped(tables: Tables, name: str) -> DataFrame:
        column, ways, key = DEALT[name]
        before, after = windows[name]
        last = START if name == "cashier_payment" and before == 10 else END  # that window lies around the first day
        first_day, last_day = as_date(START) - timedelta(days=before), as_date(last) + timedelta(days=after)
        days = (first_day - timedelta(days=1), first_day, last_day, last_day + timedelta(days=1))
        place = F.pmod(F.floor(F.substr(F.expr(column), F.lit(2)).cast("bigint") / ways), F.lit(4)).cast("int")

        def dealt(text: Callable[[date], str]) -> F.Column:
            """Looked up, not branched over: window tests on it are pushed into the scan, where they work out the place each time they name it."""
            return F.get(F.array(*[F.lit(text(day)) for day in days]), place)

        if isinstance(key, YearMonthDay):
            return tables[name].withColumns({part: dealt(lambda day, part=part: str(getattr(day, part))) for part in ("year", "month", "day")})
        return tables[name].withColumn("partition_date", dealt(key.text))

    return lambda tables: Tables(lambda name: stamped(tables, name) if name in windows else tables[name])


def with_variants(tables: Tables) -> Tables:
    """JSON documents of the orders as VARIANT, parsed when stored."""
    def typed(name: str) -> DataFrame:
        rows = tables[name]
        if name != "order_snapshot":
            return rows
        return rows.withColumn("snapshot_detail", F.try_parse_json("snapshot_detail"))

    return Tables(typed)


def _payment(**switches) -> PaymentParams:
    return PaymentParams(**{
        **PERIOD, "as_of": AS_OF, "codes": CODES, "bank_details": True, "payout_details": True, **switches,
    })


def _refund(sources: frozenset, grain: RefundGrain, **more) -> RefundParams:
    return RefundParams(**{"sources": sources, "grain": grain, **PERIOD, **more})


def report_queries() -> dict[str, Query]:
    def single(**switches) -> Query:
        return _report(plans.single_payment_report, _payment(**switches))

    def split(**switches) -> Query:
        return _report(plans.split_payment_report, _payment(**switches))

    ratings = {"start": "2024-01-01", "end": "2024-01-31"}
    refund_edges = on_edges(
        order_snapshot=(45, 1), refund_approved=(1, 1), payment_booking=(30, 1), ticket=(14, 1), refund_request=(30, 1))
    early = EarlyPaymentParams(
        **PERIOD, delivered_start=START, delivered_end=END, bank_details=True, payout_details=True, codes=CODES)
    return {
        "r01_bucketed": _on(by_order, plans.split_payment_report, _payment()),
        "r02_bucketed": _on(by_order, plans.single_payment_report, _payment()),
        "r03_bucketed": _on(by_order, plans.early_payment_report, early),
        "r01_variant": _on(with_variants, plans.split_payment_report, _payment()),
        "r11_variant": _on(with_variants, plans.promo_report, PromoParams(regions=REGIONS, **PERIOD)),
        "r01_hot_merchants": _report(plans.split_payment_report, _payment(hot_merchant_rows=40)),
        "r11_hot_keys": _report(plans.promo_report, PromoParams(regions=REGIONS, **PERIOD, hot_rows=2)),
        "r01": _report(plans.split_payment_report, _payment()),
        "r02": _report(plans.single_payment_report, _payment()),
        "r03": _report(plans.early_payment_report, EarlyPaymentParams(
            **PERIOD, delivered_start=START, delivered_end=END, bank_details=True, payout_details=True, codes=CODES)),
        "r04": _report(plans.refund_report, _refund(BOTH, RefundGrain.ORDER)),
        "r05": _report(plans.refund_report, _refund(REQUEST, RefundGrain.ITEM)),
        "r06": _report(plans.refund_report, _refund(REQUEST, RefundGrain.SUB_ITEM, **ANY_DAY)),
        "r07": _report(plans.refund_report, _refund(CASE, RefundGrain.ITEM, **ANY_DAY)),
        "r08": _report(plans.refund_report, _refund(
            REQUEST, RefundGrain.ORDER, history=True, history_start="1996-01-01", history_end="1999-12-31")),
        "r09": _report(plans.cash_report, CashParams(**PERIOD)),
        "r10": _report(plans.pnl_report, PnlParams(
            **PERIOD, grain=Grain.MONTH, dimension=Dimension.BRAND, unit_economics=True)),
        "r10_merchant_total": _report(plans.pnl_report, PnlParams(**PERIOD, verticals=("Food",))),
        "r11": _report(plans.promo_report, PromoParams(regions=REGIONS, **PERIOD)),
        "r11_keep_unmatched": _report(plans.promo_report, PromoParams(regions=REGIONS, **PERIOD, keep_unmatched=True)),
        "r12": _report(plans.ratings_report, RatingsParams(grain=Grain.WEEK, **ratings, include_orders=True)),
        "r12_brand_completed": _report(plans.ratings_report, RatingsParams(
            grain=Grain.MONTH, **ratings, by_merchant=False, completed_only=True)),
        "r13": _report(plans.settlement_report, SettlementParams(**PERIOD)),
        "r01_month": _on(by_ledger_day, plans.split_payment_report, _payment(**MONTH, mart_range_days=2)),
        "r03_month": _report(plans.early_payment_report, EarlyPaymentParams(
            **MONTH, delivered_start=MONTH["start"], delivered_end=MONTH["end"], bank_details=True, payout_details=True, codes=CODES,
            fixed_countries=())),
        "r04_month": _report(plans.refund_report, RefundParams(sources=BOTH, grain=RefundGrain.ORDER, **MONTH)),
        "r05_month": _report(plans.refund_report, RefundParams(sources=REQUEST, grain=RefundGrain.ITEM, **MONTH)),
        "r07_month": _report(plans.refund_report, RefundParams(sources=CASE, grain=RefundGrain.ITEM, **MONTH)),
        "r09_month": _on(by_ledger_day, plans.cash_report, CashParams(**MONTH)),
        "r11_month": _report(plans.promo_report, PromoParams(regions=REGIONS, **MONTH)),
        "r11_keep_unmatched_month": _report(plans.promo_report, PromoParams(regions=REGIONS, **MONTH, keep_unmatched=True)),
        "r13_month": _report(plans.settlement_report, SettlementParams(start="1997-12-05", end="1998-01-04")),
        "r01_edges": _on(
            on_edges(app_log=(3, 0), wallet_tx=(15, 15), cashier_payment=(10, 10), order_snapshot=(1, 1)), plans.split_payment_report, _payment()),
        "r02_edges": _on(on_edges(app_log=(3, 0), wallet_tx=(15, 15), order_snapshot=(1, 1)), plans.single_payment_report, _payment()),
        "r03_edges": _on(on_edges(app_log=(3, 0), order_snapshot=(1, 1)), plans.early_payment_report, early),
        "r04_edges": _on(refund_edges, plans.refund_report, _refund(BOTH, RefundGrain.ORDER)),
        "r05_edges": _on(refund_edges, plans.refund_report, _refund(REQUEST, RefundGrain.ITEM)),
        "r07_edges": _on(refund_edges, plans.refund_report, _refund(CASE, RefundGrain.ITEM)),
        "r09_edges": _on(on_edges(cashier_payment=(1, 1), order_booking=(1, 1), driver_ledger=(1, 1)), plans.cash_report, CashParams(**PERIOD)),
        "r13_edges": _on(on_edges(wallet_tx=(2, 2), order_snapshot=(30, 30)), plans.settlement_report, SettlementParams(
            **PERIOD, own_partner_only=False, search_merchant=True, order_window_days=30)),
        "r01_takeaway_open": split(delivery=Delivery.TAKEAWAY, completion=Completion.EXCLUDE_COMPLETED),
        "r01_pos_market_automatic": split(
            pos_integrated=YesNo.YES, business_line=BusinessLine.MARKET, auto_accept=YesNo.YES),
        "r01_kitchens_manual_delivery": split(
            delivery=Delivery.DELIVERY, pos_integrated=YesNo.NO, business_line=BusinessLine.KITCHEN, auto_accept=YesNo.NO),
        "r01_some_orders": split(
            order_ids=tuple(f"O{n}" for n in range(400)), bank_details=False, payout_details=False),
        "r02_month": single(**MONTH),
        "r02_takeaway_completed": single(delivery=Delivery.TAKEAWAY, completion=Completion.COMPLETED_ONLY),
        "r02_delivery_open": single(delivery=Delivery.DELIVERY, completion=Completion.EXCLUDE_COMPLETED),
        "r02_pos_market_automatic": single(
            pos_integrated=YesNo.YES, business_line=BusinessLine.MARKET, auto_accept=YesNo.YES),
        "r02_kitchens_manual": single(pos_integrated=YesNo.NO, business_line=BusinessLine.KITCHEN, auto_accept=YesNo.NO),
        "r02_mixed_kitchen_places": single(
            business_line=BusinessLine.KITCHEN_MIXED, cities=(3, 7, 12, 14, 21), countries=(1, 2, 3)),
        "r02_single_kitchen_chains": single(business_line=BusinessLine.KITCHEN_SINGLE, payout_details=False, chains=tuple(
            f"CH{n}" for n in (1, 3, 5, 7, 9, 11, 13))),
        "r03_all_countries": _report(plans.early_payment_report, EarlyPaymentParams(
            **PERIOD, delivered_start=START, delivered_end=END, bank_details=True, payout_details=True, codes=CODES, fixed_countries=())),
        "r09_currency": _report(plans.cash_report, CashParams(**PERIOD, currencies=("MYR",))),
        "r12_places": _report(plans.ratings_report, RatingsParams(
            grain=Grain.MONTH, **ratings, countries=(1, 3), cities=(1, 3, 8, 11, 13))),
        "r13_all_partners": _report(plans.settlement_report, SettlementParams(
            **PERIOD, own_partner_only=False, search_merchant=True, order_window_days=30)),
    }
