"""Cash-on-delivery collection per driver and booking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codes import CASHIER_DRIVER_USER, CASHIER_TX_ADJUSTMENT, CASHIER_TX_ORDER
from ..functions.dates import between_days
from ..functions.predicates import one_of
from ..functions.report_rules import booking_type, cod_metrics, promo_amount
from ..functions.scalars import minor_to_major
from ..operators.aggregates import collapse_max, spread_by_type
from ..operators.joins import enrich
from ..sources.documents import CASHIER_DRIVER_METADATA
from ..sources.partitions import YearMonthDay, as_date, partition_between
from ..sources.tables import Tables
from .params import CashParams
from .windows import widened

AMOUNTS = ("delivery_fee_plus_adjustments", "order_value", "earning_adjustments", "promo")


def driver_payments(tables: Tables, params: CashParams) -> DataFrame:
    """One row per driver, booking, order and payment kind, with one amount column per transaction type."""
    ledger = partition_between(tables["cashier_payment"], params.start, params.end, 1, 1, YearMonthDay())
    ledger = ledger.where(
        (F.col("user_type") == CASHIER_DRIVER_USER)
        & between_days(F.to_date("created_at"), *widened(params.start, params.end, 1, 1))
        & one_of(F.col("payee_id"), params.merchants)
        & one_of(F.col("currency"), params.currencies)
    )
    kind = F.col("tx_type")
    ledger = ledger.select(
        "user_id", "booking_code", "order_id", "created_at", "tx_type", "tx_amount",
        booking_type(F.col("order_mode")).alias("booking_type"),
        F.from_json("metadata", CASHIER_DRIVER_METADATA).alias("meta"),
    )
    ledger = spread_by_type(ledger, {
        "delivery_fee_plus_adjustments": (kind == CASHIER_TX_ORDER, minor_to_major(F.col("meta.daxDeliveryFee"))),
        "order_value": (kind == CASHIER_TX_ORDER, minor_to_major(F.col("tx_amount"))),
        "earning_adjustments": (kind == CASHIER_TX_ADJUSTMENT, minor_to_major(F.col("tx_amount"))),
    }).withColumn("promo", promo_amount(kind, F.col("meta.promotion")))
    return collapse_max(ledger, ["user_id", "booking_code", "order_id", "booking_type"], AMOUNTS, ["created_at"])


def cash_report(tables: Tables, params: CashParams) -> DataFrame:
    windowed = as_date(params.start) is not None or as_date(params.end) is not None
    # a period filter on the joined side rejects unmatched bookings, which makes those joins inner
    how = "inner" if windowed else "left"
    bookings = partition_between(tables["order_booking"], params.start, params.end, 1, 1)
    credits = partition_between(tables["driver_ledger"], params.start, params.end, 1, 1, YearMonthDay())

    rows = driver_payments(tables, params)
    rows = enrich(rows, bookings, [("booking_code", "booking_code")], {
        "taxi_type_name": "taxi_type_name", "driver_fleet_id": "driver_fleet_id", "restaurant_id": "restaurant_id",
    }, how)
    rows = enrich(rows, credits, [("booking_code", "method")], {"credit_deduction": F.round("amount", 2)}, how)
    rows = enrich(rows, tables["driver"], [("user_id", "id")], {"driver_id": "id", "driver_name": "name"})
    rows = enrich(rows, tables["fleet"], [("driver_fleet_id", "id")], {"fleet": "name"})
    rows = enrich(rows, tables["merchant_dim"], [("restaurant_id", "merchant_id")], {"merchant_name": "merchant_name"})
    rows = rows.withColumns({"date_local": F.to_date("created_at"), "booking_id": F.col("booking_code")})
    keys = [
        "taxi_type_name", "fleet", "driver_id", "driver_name", "merchant_name", "date_local", "booking_id", "booking_type",
        "credit_deduction",
    ]
    totals = rows.groupBy(*keys).agg(*[metric.alias(name) for name, metric in cod_metrics().items()])
    return totals.select(*keys[:-1], *cod_metrics(), "credit_deduction")
