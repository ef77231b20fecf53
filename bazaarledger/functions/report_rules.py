"""Rules of the refund, settlement, P&L, cash and promo reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codes import (
    ADJUSTMENT_MARK,
    CASH_ORDER_MODE_MAX,
    CASHIER_TX_ORDER,
    CASHIER_TX_PROMO_BELOW,
    CASHIER_TX_PROMO_FROM,
)
from .scalars import minor_to_major, safe_ratio, same_amount

c = F.col


# Refunds
def refund_status(refunded: Column, booked: Column) -> Column:
    """Full only on exact equality; unknown amounts count as partial."""
    return F.when(same_amount(refunded, booked), "Full Refund").otherwise("Partial Refund")


def refund_source(sources: Sequence[tuple[str, Column]]) -> Column:
    """Label of the first source whose key is present."""
    label = F.lit(None).cast("string")
    for name, key in reversed(sources):
        label = F.when(key.isNotNull(), name).otherwise(label)
    return label


def captured_amount(amounts: Sequence[Column]) -> Column:
    return F.coalesce(*amounts, F.lit(0.0))


# Settlement
def cashout_status(cashed_out: Column, settled: Column, fallback: Column, success: str) -> Column:
    return F.when(same_amount(cashed_out, settled), success).otherwise(fallback)


def adjustment_amount(text: Column, net: Column) -> Column:
    return F.when(text.contains(ADJUSTMENT_MARK), net).otherwise(0)


def adjustment_route(adjustment: Column) -> Column:
    """Which order key a transaction is matched on; NULL adjustments take neither route."""
    return F.when(adjustment == 0, "plain").when(adjustment != 0, "adjusted")


def adjustment_indicator(adjustment: Column, partner: Column, own_partner: str) -> Column:
    return F.when((adjustment != 0) | (F.upper(partner) != own_partner), "MPA Involved")


# Profit and loss
def am_tag(manager: Column) -> Column:
    return F.when(manager.isNull(), "Non-AM").otherwise("AM")


def pnl_metrics() -> dict[str, Column]:
    revenue = c("driver_commission_usd") + c("merchant_commission_usd") + c("order_fee_usd") + c("ad_spend_usd")
    profit = revenue - c("total_incentives_spend_usd") - c("total_platform_promo_spend_usd")
    return {
        "gross_revenue": revenue,
        "profit_margin_on_adj_gmv": safe_ratio(profit, c("adj_gmv")),
        "profit_before_overhead": profit,
    }


def unit_economics() -> dict[str, Column]:
    """Per completed order, after `pnl_metrics`."""
    per_order = {
        "avg_basket_size": "basket_size_usd",
        "avg_merchant_commission": "merchant_commission_usd",
        "avg_driver_del_commission": "driver_commission_usd",
        "avg_order_fee_usd": "order_fee_usd",
        "avg_ad_spend_per_order": "ad_spend_usd",
        "incentive_cpr": "total_incentives_spend_usd",
        "platform_promo_cpr": "total_platform_promo_spend_usd",
        "avg_support_expense_cpr": "support_expense_usd",
        "profit_per_order": "profit_before_overhead",
    }
    metrics = {name: safe_ratio(c(source), c("completed_orders")) for name, source in per_order.items()}
    metrics["blended_commission_rate"] = safe_ratio(
        c("merchant_commission_usd"), c("total_partner_base_for_merchant_commission")
    )
    return metrics


# Cash on delivery
def booking_type(order_mode: Column) -> Column:
    return F.when(order_mode <= CASH_ORDER_MODE_MAX, "Cash").otherwise("Cashless")


def promo_amount(tx_type: Column, promotion: Column) -> Column:
    """Promotion of an order transaction or of the promo transaction range, else zero."""
    ordered = tx_type == CASHIER_TX_ORDER
    ranged = (tx_type >= CASHIER_TX_PROMO_FROM) & (tx_type < CASHIER_TX_PROMO_BELOW)
    return F.coalesce(F.when(ordered | ranged, minor_to_major(promotion)), F.lit(0.0))


def cod_metrics() -> dict[str, Column]:
    """Aggregates over bookings: fee net of adjustments, order value before promo, cash to collect."""
    fee, adjustment = F.sum("delivery_fee_plus_adjustments"), F.sum("earning_adjustments")
    value, promo = F.sum("order_value"), F.sum("promo")
    return {
        "earning_adjustments": F.round(adjustment, 2),
        "delivery_fee": F.round(fee - adjustment, 2),
        "order_value": F.round(value + promo, 2),
        "promo": F.round(promo, 2),
        "cash_collection": F.round(fee - adjustment + value, 2),
    }


# Promo reconciliation
def recon_labels(flag: Column, in_dashboard: Column, in_orders: Column) -> dict[str, Column]:
    return {
        "indicator": F.when(in_dashboard, flag).otherwise("Not flagged in dashboard"),
        "indicator_2": F.when(in_orders, "In orders").otherwise("Not in orders"),
    }
