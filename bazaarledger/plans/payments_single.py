"""Merchant payment per order, one merchant per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import between_days
from ..functions.order_rules import accept_labels, auto_accepted, final_state, pay_status, pos_flags
from ..functions.payment_rules import net_payable, payout_filter, promo_override
from ..functions.predicates import by_mode, one_of
from ..functions.scalars import number, number_or_zero
from ..operators.joins import enrich
from ..sources.documents import ORDER_DOCUMENT_WHOLE
from ..sources.partitions import YearMonthDay, partition_between
from ..sources.tables import Tables
from . import payments as p
from .params import PaymentParams, YesNo


def auto_accept_filter(mode: YesNo) -> Column:
    flag = F.col("auto_accept_flag")
    return by_mode(mode, {YesNo.YES: lambda: flag == "mex_auto_accept", YesNo.NO: flag.isNull})


PROMO_SOURCES = ("order_promo_code", "mart_promo_code", "order_promo_expense", "mart_promo_expense")


def chosen_promo(params: PaymentParams) -> list[Column]:
    """Promo code and expense, from the order document for the brands that need it."""
    pattern = params.codes.promo_name_pattern
    return [
        promo_override(F.col("merchant_name"), pattern, F.col(f"order_{name}"), F.col(f"mart_{name}")).alias(name)
        for name in ("promo_code", "promo_expense")
    ]


def single_payment_report(tables: Tables, params: PaymentParams) -> DataFrame:
    totals = p.cart()["totalQuoteInMin"]
    orders = p.payment_orders(tables, params, ORDER_DOCUMENT_WHOLE, {
        **p.quoted_tax_fields(), **p.promo_fields(), **p.discount_fields(),
        "commission_value": (number_or_zero(totals["mexCommission"]) + number_or_zero(totals["gkCommission"])) / F.lit(100.0),
        "commission_rate": F.coalesce(number(p.merchant_info()["commission"]), F.col("commission")),
    }, delivered_slack_days=1, city_join="left")

    # the vertical test rejects orders without a booking
    mart = tables["booking_base"].where(
        (F.col("vertical") == params.codes.vertical)
        & one_of(F.col("country_id"), params.countries)
        & one_of(F.col("city_id"), params.cities)
        & one_of(F.col("merchant_id"), params.merchants)
        & one_of(F.col("order_id"), params.order_ids)
        & between_days(F.to_date("date_local"), params.start, params.end)
    )
    rows = enrich(orders, mart, [("order_id", "order_id")], {
        "pickup_area": "pickup_area", "dropoff_area": "dropoff_area", "driver_id": "driver_id",
        "driver_delivery_fee": "driver_fare", "customer_delivery_fee": "customer_fare", "mart_promo_code": "promo_code",
        "mart_promo_expense": "promo_expense", "mart_sub_total": "food_sub_total",
    }, "inner")
    rows = p.with_accept_log(tables, rows, params)

    auto = auto_accepted(F.col("auto_accept_order").isNotNull(), params.as_of, params.retention_days)
    pre_tax, tax, commission = F.col("pre_tax"), F.col("tax_value"), F.col("commission_value")
    discount = F.col("funded_discount_ex_tax")
    labels, flags = accept_labels(auto), pos_flags(params.codes)
    rows = p.settled(
        rows, "customer_delivery_fee", *PROMO_SOURCES,
        order_value=F.round(F.coalesce("pre_tax", "mart_sub_total"), 2),
        funded_discount=F.round(F.coalesce("funded_discount", F.lit(0.0)), 2),
        funded_discount_ex_tax=F.round(F.coalesce(discount, F.lit(0.0)), 2),
        tax_perc=F.round(F.coalesce("tax_perc", "tax"), 2), tax_value=F.round(tax, 2),
        commission_rate=F.round("commission_rate", 2), commission_value=F.round(commission, 2),
        net_payable=net_payable(pre_tax, tax, discount, commission), pay_status=pay_status(auto),
        final_state=final_state(), **labels, **flags,
    ).where(auto_accept_filter(params.auto_accept))

    payouts = p.own_payouts(tables, params, payout_filter(F.col("currency"), F.col("txtype")))
    payouts = partition_between(payouts, params.start, params.end, 15, 15, YearMonthDay())
    rows = enrich(rows, payouts, [(F.coalesce("last_booking_code", "order_id"), "orderid")], p.PAYOUT_COLUMNS)
    rows = p.with_merchant(tables, rows, params)
    return rows.select(
        "city_name", "country_name", "city_id", "country_id", "order_id", F.col("last_booking_code").alias("booking_code"),
        "short_order_number", "merchant_account_id", "merchant_id", "wallet_account_id", "merchant_name",
        "invoice_contact_email", *((*p.LEGACY_BANK_COLUMNS, *p.BANK_COLUMNS) if params.bank_details else ()),
        *p.TIME_COLUMNS, "pickup_area", "dropoff_area", "driver_id", "driver_delivery_fee", "customer_delivery_fee",
        *chosen_promo(params), "order_value", "funded_discount", "funded_discount_ex_tax", "tax_perc", "tax_value",
        "commission_rate", "commission_value", "net_payable", "pay_status", *labels, "cancel_msg", "cancel_reason_enum",
        "final_state", *flags, *(p.PAYOUT_COLUMNS if params.payout_details else ()),
    )
