"""Stages shared by the merchant payment reports.

Shape: prune the order snapshot by its stored columns, parse both its texts once at the scan, keep flat columns only (no text and
no parsed document crosses a shuffle), then join by city, by order id, by booking, and last by merchant. List totals are computed inside the row: the snapshot holds one row per
order, so they need neither an explode nor a join back to the order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codes import CASHIER_CURRENCIES, CASHIER_TX_MERCHANT, COMPLETED_STATE, INTEGRATED_ORDER_TYPE
from ..functions.dates import between_days
from ..functions.order_rules import metadata_fields
from ..functions.predicates import by_mode, in_null_safe, not_in_null_safe, one_of
from ..functions.scalars import iso_time, local_date, local_time, minor_to_major, number, number_or_zero, text_guard
from ..operators.aggregates import sum_list
from ..operators.explode import parse_once
from ..operators.joins import enrich, semi_filter
from ..operators.skew import enrich_hot
from ..sources.documents import CASHIER_MERCHANT_METADATA, ORDER_METADATA
from ..sources.logs import log_events
from ..sources.partitions import YearMonthDay, partition_between
from ..sources.tables import Tables
from .params import BusinessLine, Completion, Delivery, EarlyPaymentParams, PaymentParams, YesNo
from .windows import widened

TIMES = (
    "created_time", "ord_new_time", "pre_accepted_time", "pre_expired_time", "pre_cancelled_time",
    "ord_order_in_prepare_time", "ord_completed_time", "del_last_picking_up_time", "del_first_driver_at_store_time",
    "del_food_collected_time", "del_driver_arrived_time", "del_cancelled_time",
)
ORDER_COLUMNS = (
    "order_id", "last_booking_code", "short_order_number", "merchant_id", "city_id", "country_id", "order_type",
    "order_state", "booking_state", "final_state", "cancel_code", "cancel_msg", "commission", "tax", *TIMES,
)
PAYOUT_COLUMNS = {
    "transaction_id": "txid", "payout_amount": "amount", "payout_refund_amount": "refundamount",
    "payout_currency": "currency", "payout_status": "status", "payout_type": "txtype",
    "payout_created_at": "transactioncreatedat", "payout_updated_at": "transactionupdatedat",
    "payout_booking_code": "orderid",
}
LEGACY_BANK_COLUMNS = ("legacy_bank_account_number", "legacy_bank_swift_code")
BANK_COLUMNS = ("bank_account_number", "bank_swift_code", "bank_name", "bank_statement_code")


def doc() -> Column:
    """The parsed order document."""
    return F.col("doc")


def cart() -> Column:
    return doc()["cartWithQuote"]


def quote() -> Column:
    return cart()["foodQuoteInMin"]


def first_cart() -> Column:
    return F.get(cart()["merchantCartWithQuoteList"], F.lit(0))


def merchant_info() -> Column:
    return first_cart()["merchantInfoObj"]


def first_promo() -> Column:
    return F.get(cart()["promoCodes"], F.lit(0))


def local_orders(
    tables: Tables,
    params: EarlyPaymentParams | PaymentParams,
    document: str,
    fields: Mapping[str, Column],
    delivered_slack_days: int,
    city_join: str = "left",
    stored: Column | None = None,
    wanted: Column | None = None,
) -> DataFrame:
    """Integrated orders of the period in their own city's calendar, as flat columns.

    `stored` tests columns of the snapshot, `wanted` fields of the parsed document.
    """
    orders = partition_between(tables["order_snapshot"], params.start, params.end, 1, 1)
    orders = orders.where(
        (F.col("order_type") == INTEGRATED_ORDER_TYPE)
        & one_of(F.col("country_id"), params.countries)
        & one_of(F.col("city_id"), params.cities)
        & one_of(F.col("merchant_id"), params.merchants)
    )
    if stored is not None:
        orders = orders.where(stored)
    orders = parsed_orders(orders, document, fields, wanted)
    orders = enrich(orders, tables["city"], [("city_id", "id")], {
        "city_name": "name", "country_code": "country_code", "time_zone": "time_zone",
    }, city_join)
    zone = F.col("time_zone")
    delivered = widened(params.delivered_start, params.delivered_end, delivered_slack_days, 0)
    orders = orders.where(
        between_days(local_date(F.col("created_time"), zone), params.start, params.end)
        & between_days(local_date(F.col("ord_completed_time"), zone), *delivered)
    )
    if params.chains:
        in_chain = tables["merchant"].where(F.col("chain_number").isin(list(params.chains)))
        orders = semi_filter(orders, in_chain, [("merchant_id", "merchant_id")])
    return orders


def mode_filters(params: PaymentParams) -> Column:
    """Switches that test the order document (completion tests a plain column)."""
    kitchens = (params.codes.kitchen_mixed, params.codes.kitchen_single)
    kind = merchant_info()["specialMerchantType"]
    pos = merchant_info()["qsrCode"]
    option = doc()["deliveryOption"]
    return (
        by_mode(params.delivery, {
            Delivery.TAKEAWAY: lambda: option == "1",
            Delivery.DELIVERY: lambda: (option == "0") | option.isNull(),
        })
        & by_mode(params.pos_integrated, {YesNo.YES: pos.isNotNull, YesNo.NO: pos.isNull})
        & by_mode(params.business_line, {
            BusinessLine.MARKET: lambda: not_in_null_safe(kind, kitchens),
            BusinessLine.KITCHEN: lambda: in_null_safe(kind, kitchens),
            BusinessLine.KITCHEN_SINGLE: lambda: in_null_safe(kind, [params.codes.kitchen_single]),
            BusinessLine.KITCHEN_MIXED: lambda: in_null_safe(kind, [params.codes.kitchen_mixed]),
        })
    )


def parsed_orders(
    orders: DataFrame, document: str, fields: Mapping[str, Column], wanted: Column | None = None
) -> DataFrame:
    """Parse both JSON columns once, apply document filters, keep flat columns."""
    orders = orders.withColumn("has_metadata", F.col("metadata") != "")
    parsed = parse_once(orders, [*ORDER_COLUMNS, "has_metadata"], {
        "doc": ("snapshot_detail", document), "meta": ("metadata", ORDER_METADATA),
    })
    if wanted is not None:
        parsed = parsed.where(wanted)
    flat = {**metadata_fields(F.col("meta")), **fields}
    return parsed.select(*ORDER_COLUMNS, "has_metadata", *[field.alias(name) for name, field in flat.items()])


def payment_orders(
    tables: Tables,
    params: PaymentParams,
    document: str,
    fields: Mapping[str, Column],
    delivered_slack_days: int,
    city_join: str,
) -> DataFrame:
    stored = one_of(F.col("order_id"), params.order_ids) & by_mode(params.completion, {
        Completion.COMPLETED_ONLY: lambda: F.col("order_state") == COMPLETED_STATE,
        Completion.EXCLUDE_COMPLETED: lambda: F.col("order_state") != COMPLETED_STATE,
    })
    return local_orders(tables, params, document, fields, delivered_slack_days, city_join, stored, mode_filters(params))


def discount_fields() -> dict[str, Column]:
    """Merchant-funded discounts of the order, with and without tax."""
    parts = {"funded_discount": "mexFundedAmountInMin", "funded_discount_ex_tax": "mexFundedAmountExcludeTaxInMin"}

    def total(name: str) -> Column:
        return sum_list(cart()["discounts"], lambda item: minor_to_major(item[name]))

    return {name: total(source) for name, source in parts.items()}


def promo_fields() -> dict[str, Column]:
    exponent = number_or_zero(doc()["currency"]["exponent"])
    return {
        "order_promo_expense": number_or_zero(first_promo()["promoAmountInMin"]) / F.pow(F.lit(10.0), exponent),
        "order_promo_code": F.coalesce(first_promo()["promoCode"], F.lit("")),
    }


def quoted_tax_fields() -> dict[str, Column]:
    return {
        "pre_tax": minor_to_major(quote()["priceExcludeTaxInMinorUnit"]),
        "tax_value": number_or_zero(quote()["inclTaxInMin"]) / F.lit(100.0),
        "tax_perc": F.coalesce(number(merchant_info()["taxRate"]), F.col("tax")),
    }


def accept_log(tables: Tables, params: EarlyPaymentParams | PaymentParams) -> DataFrame:
    """Auto-accept events; an order logged on two days appears twice."""
    key = YearMonthDay()
    rows = partition_between(tables["app_log"], params.start, params.end, 3, 0, key).withColumn("log_date", key.value())
    codes = params.codes
    return log_events(
        rows, codes.accept_log, codes.accept_operation, {"log_merchant": "merchantID", "log_order": "orderID"},
        extra=("log_date",), label=("auto_accept_order", codes.accept_label),
    )


def with_accept_log(tables: Tables, orders: DataFrame, params: EarlyPaymentParams | PaymentParams) -> DataFrame:
    return enrich(
        orders, accept_log(tables, params), [("order_id", "log_order"), ("merchant_id", "log_merchant")],
        {"auto_accept_order": "auto_accept_order"},
    )


def own_payouts(tables: Tables, params: EarlyPaymentParams | PaymentParams, eligible: Column) -> DataFrame:
    return tables["wallet_tx"].where((F.upper("partnerid") == params.codes.partner_orders) & eligible)


def merchant_profile(tables: Tables) -> DataFrame:
    """Merchant with contract, payout account and bank, joined dimension to dimension so the orders join it once."""
    rows = tables["merchant"].select("merchant_id", F.col("name").alias("merchant_name"), "chain_number")
    rows = enrich(rows, tables["merchant_contract"], [("merchant_id", "merchant_id")], {
        "wallet_account_id": "wallet_account_id", "invoice_contact_email": "invoice_email",
    })
    return with_bank(tables, rows)


def contract_profile(tables: Tables) -> DataFrame:
    """Contract with payout account and bank."""
    rows = tables["merchant_contract"].select(
        "merchant_id", "wallet_account_id", F.col("invoice_email").alias("invoice_contact_email")
    )
    return with_bank(tables, rows)


def with_bank(tables: Tables, rows: DataFrame) -> DataFrame:
    rows = enrich(rows, tables["bank_account"], [("wallet_account_id", "store_wallet_account_id")], {
        "bank_account_number": text_guard(F.col("account_number")), "bank_swift_code": "swift_code",
        "bank_statement_code": "bank_statement_code", "bank_name_id": "bank_name_id",
    })
    return enrich(rows, tables["bank"], [("bank_name_id", "id")], {"bank_name": "bank_name"}).drop("bank_name_id")


def account_profile(tables: Tables) -> DataFrame:
    """Merchant's ledger account (held in the driver table) with its older payout account."""
    rows = tables["driver"].select("identification_card_number", F.col("id").alias("merchant_account_id"))
    rows = enrich(rows, tables["legacy_bank_account"], [("merchant_account_id", "user_id")], {
        "legacy_bank_account_number": text_guard(F.col("acc_number")), "legacy_bank_id": "bank_id",
    })
    return enrich(rows, tables["legacy_bank"], [("legacy_bank_id", "id")], {"legacy_bank_swift_code": "code"})


def with_merchant(tables: Tables, orders: DataFrame, params: EarlyPaymentParams | PaymentParams) -> DataFrame:
    """Merchant, account and cancel-reason attributes of the order's own merchant.

    Profile and account meet each other first, so that the orders are joined, and dealt out, by merchant once.
    """
    profile = merchant_profile(tables).where(one_of(F.col("chain_number"), params.chains))
    account = account_profile(tables).withColumnRenamed("identification_card_number", "account_key")
    known = F.col("merchant_id") == F.col("account_key")
    both = profile.where("merchant_id is not null").join(account.where("account_key is not null"), known, "left" if params.chains else "full")
    taken = ("merchant_name", "wallet_account_id", "invoice_contact_email", *BANK_COLUMNS, "merchant_account_id", *LEGACY_BANK_COLUMNS)
    on, take = [("merchant_id", F.coalesce("merchant_id", "account_key"))], {name: name for name in taken}
    how = "inner" if params.chains else "left"
    orders = enrich(orders, tables["cancel_reason"], [("cancel_code", "cancel_code")], {"cancel_reason_enum": "cancel_reason_enum"})
    if params.hot_merchant_rows is None:
        return enrich(orders, both, on, take, how)
    # merchants are counted at the scan of the orders, where that is one column
    keys = partition_between(tables["order_snapshot"], params.start, params.end, 1, 1).select("merchant_id")
    return enrich_hot(orders, both, on, take, ["order_id"], how, params.hot_merchant_rows, keys)


def local_times() -> dict[str, Column]:
    """Order milestones on the city's clock."""
    zone = F.col("time_zone")
    accepted = F.coalesce("pre_accepted_time", "ord_order_in_prepare_time")
    clock = {
        "order_create_time_local": F.col("created_time"),
        "order_allocated_time_local": F.col("del_last_picking_up_time"),
        "pos_order_submit_time_local": iso_time(F.col("partner_submit_time")),
        "order_driver_at_store_time_local": F.col("del_first_driver_at_store_time"),
        "order_food_collected_time_local": F.col("del_food_collected_time"),
        "order_driver_arrive_customer_time_local": F.col("del_driver_arrived_time"),
        "order_delivery_time_local": F.col("ord_completed_time"),
        "order_del_cancel_time_local": F.col("del_cancelled_time"),
        "order_pre_cancel_time_local": F.col("pre_cancelled_time"),
        "order_store_confirm_time_local": accepted,
    }
    return {
        "order_create_date_local": local_date(F.col("created_time"), zone),
        "order_delivery_date_local": local_date(F.col("ord_completed_time"), zone),
        **{name: local_time(ts, zone) for name, ts in clock.items()},
    }


def place_columns() -> list[Column]:
    """Order, city, booking and cancellation columns every version shows as they are, plus later join keys."""
    return [
        F.col(name) for name in (
            "city_name", "city_id", "country_id", "order_id", "last_booking_code", "short_order_number", "merchant_id",
            "pickup_area", "dropoff_area", "driver_id", "driver_delivery_fee", "cancel_code", "cancel_msg",
        )
    ] + [F.col("country_code").alias("country_name")]


def settled(rows: DataFrame, *plain: str, **computed: Column) -> DataFrame:
    """Reduce joined orders to finished columns before the payout and merchant joins carry them further."""
    times = local_times()
    return rows.select(
        *place_columns(), *plain, *[time.alias(name) for name, time in times.items()],
        *[column.alias(name) for name, column in computed.items()],
    )


TIME_COLUMNS = (
    "order_create_date_local", "order_delivery_date_local", "order_create_time_local", "order_allocated_time_local",
    "pos_order_submit_time_local", "order_driver_at_store_time_local", "order_food_collected_time_local",
    "order_driver_arrive_customer_time_local", "order_delivery_time_local", "order_del_cancel_time_local",
    "order_pre_cancel_time_local", "order_store_confirm_time_local",
)


def cashier_settlements(tables: Tables, params: PaymentParams) -> DataFrame:
    """Merchant payments from the cashier ledger. The window lies around the period's first day on both sides."""
    rows = partition_between(tables["cashier_payment"], params.start, params.start, 10, 10, YearMonthDay())
    rows = rows.where(
        F.col("currency").isin(list(CASHIER_CURRENCIES)) & (F.col("tx_type") == CASHIER_TX_MERCHANT)
    ).select("order_id", "payee_id", F.from_json("metadata", CASHIER_MERCHANT_METADATA).alias("meta"))

    def paid(name: str) -> Column:
        return F.coalesce(minor_to_major(F.col(f"meta.{name}")), F.lit(0.0))

    return rows.select(
        "order_id", "payee_id",
        minor_to_major(F.col("meta.netEarning")).alias("ledger_net"),
        minor_to_major(F.col("meta.orderValue")).alias("ledger_order_value"),
        paid("taxes").alias("ledger_tax"),
        paid("exDeliveryFee").alias("ledger_delivery_fee"),
        (paid("mexFundCampaign") + paid("mexFundPromo")).alias("ledger_discount"),
        paid("GKCommission").alias("ledger_kitchen"),
        paid("mexCommission").alias("ledger_base"),
        paid("mexStepUpGKCommission").alias("ledger_kitchen_up"),
        paid("mexStepUpCommission").alias("ledger_base_up"),
        paid("deliveryCharge").alias("ledger_express_fee"),
    )
