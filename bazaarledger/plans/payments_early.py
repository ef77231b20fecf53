"""Merchant payment per order, earlier two-country version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codes import EARLY_PAYOUT_CURRENCIES, EARLY_PAYOUT_TYPE
from ..functions.dates import between_days
from ..functions.order_rules import accept_labels_v1, final_state, pay_status_v1, pos_flags
from ..functions.payment_rules import net_payable_v1, order_values, payout_filter
from ..functions.scalars import minor_to_major, never_matching
from ..operators.joins import enrich
from ..sources.documents import EARLY_ORDER_DOCUMENT
from ..functions.predicates import one_of
from ..sources.tables import Tables
from . import payments as p
from .params import EarlyPaymentParams


def early_payment_report(tables: Tables, params: EarlyPaymentParams) -> DataFrame:
    orders = p.local_orders(tables, params, EARLY_ORDER_DOCUMENT, {
        **order_values(p.doc()), "merchant_commission": minor_to_major(p.cart()["totalQuoteInMin"]["mexCommission"]),
    }, delivered_slack_days=1, stored=one_of(F.col("country_id"), params.fixed_countries))

    # the vertical test rejects orders without a booking
    mart = tables["booking_base"].where(
        (F.col("vertical") == params.codes.vertical) & between_days(F.to_date("date_local"), params.start, params.end)
    )
    rows = enrich(orders, mart, [("order_id", "order_id")], {
        "pickup_area": "pickup_area", "dropoff_area": "dropoff_area", "driver_id": "driver_id",
        "driver_delivery_fee": "driver_fare", "customer_delivery_fee": "customer_fare", "promo_code": "promo_code",
        "promo_amount": "promo_expense",
    }, "inner")
    rows = p.with_accept_log(tables, rows, params)

    logged = F.col("auto_accept_order").isNotNull()
    pre_tax, tax, commission = F.col("order_value_pre_tax"), F.col("tax_value"), F.col("merchant_commission")
    labels, flags = accept_labels_v1(logged), pos_flags(params.codes, with_payer=False)
    rows = p.settled(
        rows, "customer_delivery_fee", "promo_code", "promo_amount",
        order_value_pre_tax=F.round(pre_tax, 2), order_value_with_tax=F.round("order_value_with_tax", 2),
        tax_perc=F.col("tax"), tax_value=F.round(tax, 2), commission_rate=F.col("commission"),
        merchant_commission=F.round(commission, 2), net_payable=net_payable_v1(pre_tax, tax, commission),
        pay_status=pay_status_v1(logged), final_state=final_state(), **labels, **flags,
    )

    types = {currency: (EARLY_PAYOUT_TYPE,) for currency in EARLY_PAYOUT_CURRENCIES}
    payouts = p.own_payouts(tables, params, payout_filter(F.col("currency"), F.col("txtype"), types))
    booking = never_matching(F.col("last_booking_code"), F.col("order_id"))
    rows = enrich(rows, payouts, [(booking, "orderid")], p.PAYOUT_COLUMNS)
    rows = p.with_merchant(tables, rows, params)
    return rows.select(
        "city_name", "country_name", "city_id", "country_id", "order_id", F.col("last_booking_code").alias("booking_code"),
        F.col("short_order_number").alias("short_order_id"), "merchant_account_id", "merchant_id", "wallet_account_id",
        "merchant_name", "invoice_contact_email",
        *((*p.LEGACY_BANK_COLUMNS, *p.BANK_COLUMNS) if params.bank_details else ()), *p.TIME_COLUMNS,
        "pickup_area", "dropoff_area", "driver_id", "driver_delivery_fee", "customer_delivery_fee", "promo_code",
        "promo_amount", "order_value_pre_tax", "order_value_with_tax", "tax_perc", "tax_value", "commission_rate",
        "merchant_commission", "net_payable", "pay_status", *labels, "cancel_msg", "cancel_reason_enum", "final_state", *flags,
        *(p.PAYOUT_COLUMNS if params.payout_details else ()),
    )
