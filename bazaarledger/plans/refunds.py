"""Customer refunds at order, item and sub-item grain from two refund sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codes import MAIN_COUNTRY_MAX_ID, REFUND_IGNORED_ACTION, REFUND_PLACEHOLDER_DRIVER, TICKET_PREFIX
from ..functions.dates import between_days
from ..functions.order_rules import final_state
from ..functions.predicates import one_of
from ..functions.report_rules import captured_amount, refund_source, refund_status
from ..functions.scalars import (
    decode_nested_json,
    iso_time,
    local_date,
    local_time,
    minor_to_major,
    never_matching,
    number,
    typed_null,
)
from ..operators.aggregates import customer_history, largest_per_state
from ..operators.explode import explode_keep_empty, explode_list
from ..operators.joins import enrich, exists_any, semi_filter
from ..operators.key_filter import KeyFilter
from ..sources.documents import CASE_POLICY_STATE, CASE_TICKET_STATE, REFUND_ITEMS
from ..sources.partitions import CompactDate, YearMonthDay, partition_between
from ..sources.tables import Tables
from .params import RefundGrain, RefundParams, RefundSource

ORDER_COLUMNS = (
    "order_id", "buyer_id", "last_booking_code", "created_time", "short_order_number", "merchant_id", "booking_state",
    "final_state", "order_state", "pre_accepted_time", "ord_order_in_prepare_time", "pre_expired_time",
    "pre_cancelled_time", "ord_completed_time", "city_id",
)
SUB_ITEM_COLUMNS = {
    "sub_item_name": "string", "sub_item_id": "string", "sub_item_price": "double", "sub_item_quantity": "int",
    "sub_total_price": "double", "sub_total_refund": "double",
}
HISTORY_COLUMNS = (
    "history_start_date", "history_end_date", "total_attempted_orders", "total_completed_orders",
    "total_basket_size_pre_discount_usd", "total_basket_size_after_discount_usd",
)


# Inputs common to all grains
def main_countries(tables: Tables) -> DataFrame:
    return tables["country"].where(F.col("id") <= MAIN_COUNTRY_MAX_ID)


def ledger_refunds(tables: Tables, params: RefundParams) -> DataFrame:
    """Approved refunds summed per booking, with the amount first charged."""
    key = YearMonthDay()
    approved = partition_between(tables["refund_approved"], params.start, params.end, 1, 1, key).where(
        (F.col("tx_action") != REFUND_IGNORED_ACTION) & between_days(F.to_date("tx_time"), params.start, params.end)
    )
    charged = partition_between(tables["payment_booking"], params.start, params.end, 30, 1, key)
    charged = charged.where(F.col("driver_id") == REFUND_PLACEHOLDER_DRIVER)
    rows = enrich(approved, main_countries(tables), [("currency", "iso_currency")], {
        "country_id": "id", "zone": "country_timezone",
    }).where(one_of(F.col("country_id"), params.countries))
    rows = enrich(rows, charged, [("booking_code", "booking_code")], {
        "passenger_id": "passenger_id", "initial_amount": "initial_amount",
    }, "inner")
    moment = local_time(F.col("tx_time"), F.col("zone"))
    return rows.groupBy("passenger_id", "booking_code", "initial_amount").agg(
        F.count(F.lit(1)).alias("ledger_entries"),
        F.sum("credit").alias("ledger_credit"),
        F.max("balance").alias("ledger_balance"),
        F.min(moment).alias("first_transaction_time"),
        F.max(moment).alias("last_transaction_time"),
    )


def support_tickets(tables: Tables, params: RefundParams) -> DataFrame:
    rows = partition_between(tables["ticket"], params.start, params.end, 14, 1, CompactDate())
    rows = rows.where(F.col("service") == params.codes.ticket_service)
    rows = enrich(rows, tables["country"], [("country", F.lower("code"))], {"country_id": "id"})
    rows = rows.where(one_of(F.col("country_id"), params.countries))
    return rows.select("id", F.col("id").cast("string").alias("ticket"), "booking_code", "disposition")


def order_facts(tables: Tables, params: RefundParams) -> DataFrame:
    orders = partition_between(tables["order_snapshot"], params.start, params.end, 45, 1)
    return orders.where(
        one_of(F.col("country_id"), params.countries) & one_of(F.col("merchant_id"), params.merchants)
    ).select(*ORDER_COLUMNS)


def ledger_columns() -> dict[str, Column]:
    return {
        "booking_amount": F.col("initial_amount"),
        "refund_amount": F.col("ledger_credit"),
        "account_balance": F.col("ledger_balance"),
        "refund_status": refund_status(F.col("ledger_credit"), F.col("initial_amount")),
    }


def order_times() -> dict[str, Column]:
    zone = F.col("time_zone")
    return {
        "order_create_date_local": local_date(F.col("created_time"), zone),
        "merchant_accept_time": local_time(F.coalesce("pre_accepted_time", "ord_order_in_prepare_time"), zone),
        "final_state": final_state(),
        "order_delivery_date_local": local_date(F.col("ord_completed_time"), zone),
    }


LEDGER_TAKE = {name: name for name in (
    "initial_amount", "ledger_entries", "ledger_credit", "ledger_balance", "first_transaction_time", "last_transaction_time",
)}
MERCHANT_TAKE = {"merchant_name": "name", "chain_name": "chain_name", "chain_number": "chain_number"}


# Request source
def refund_requests(tables: Tables, params: RefundParams) -> DataFrame:
    """Self-service refund requests; amounts in major units of their own exponent."""
    rows = partition_between(tables["refund_request"], params.start, params.end, 30, 1, YearMonthDay())
    rows = rows.where(
        (F.col("source_category") == params.codes.refund_category)
        & between_days(F.to_date(F.substr("created_at", F.lit(1), F.lit(10))), params.start, params.end)
    )
    rows = enrich(rows, main_countries(tables), [("currency", "iso_currency")], {"country_id": "id"})
    rows = rows.where(one_of(F.col("country_id"), params.countries))

    def major(name: str) -> Column:
        return minor_to_major(F.col(name), F.col("currency_exponent")).alias(name)

    return rows.select(
        "refund_id", F.col("customer_id").alias("passenger_id"), F.col("vendor_id").alias("request_merchant_id"),
        F.col("source_id").alias("request_order_id"), iso_time(F.col("created_at")).alias("request_created_at"),
        major("total_refund_amount"), major("paid_amount"), major("promo_amount"), "currency_exponent", "reason_code",
        "reason_category_code", F.replace("ticket_id", F.lit(TICKET_PREFIX), F.lit("")).alias("request_ticket"), "refund_items",
    )


def request_items(tables: Tables, params: RefundParams) -> DataFrame:
    """One row per refunded item, or per sub-item at sub-item grain."""
    rows = refund_requests(tables, params)
    rows = explode_list(rows, F.from_json(decode_nested_json(F.col("refund_items")), REFUND_ITEMS), "item")
    exponent, item = F.col("currency_exponent"), F.col("item")
    rows = rows.withColumns({
        "item_name": item["ItemName"],
        "item_id": item["ItemID"],
        "item_price": minor_to_major(item["ItemPriceInMinorUnits"], exponent),
        "item_quantity": item["ItemQuantity"].try_cast("int"),
        "total_price": minor_to_major(item["TotalItemPriceInMinorUnits"], exponent),
        "total_refund_per_item": minor_to_major(item["TotalRefundPriceInMinorUnits"], exponent),
        "sub_items": item["RefundSubItems"],
    }).drop("item", "refund_items")
    if params.grain is not RefundGrain.SUB_ITEM:
        return rows.drop("sub_items")
    # an item with no sub-items keeps its row; an item whose list is missing loses it
    rows = explode_keep_empty(rows, F.col("sub_items"), "sub").drop("sub_items")
    sub = F.col("sub")
    return rows.withColumns({
        "sub_item_name": sub["itemName"],
        "sub_item_id": sub["itemID"],
        "sub_item_price": minor_to_major(sub["itemPriceInMinorUnits"], exponent),
        "sub_item_quantity": sub["itemQuantity"].try_cast("int"),
        "sub_total_price": minor_to_major(sub["totalItemPriceInMinorUnits"], exponent),
        "sub_total_refund": minor_to_major(sub["totalRefundPriceInMinorUnits"], exponent),
    }).drop("sub")


# Case source
def case_items(tables: Tables, params: RefundParams) -> DataFrame:
    """One row per refunded item of an automated case. Cases without a policy state drop out."""
    codes = params.codes
    states = tables["case_state"].where(between_days(F.to_date("created_at"), params.start, params.end))
    cases = tables["case"].where(
        (F.col("category") == codes.case_category) & between_days(F.to_date("created_at"), params.start, params.end)
    )
    # only the two states that are read, of the wanted cases, before any document is grouped
    states = states.where(F.col("state").isin(codes.case_ticket_state, codes.case_policy_state))
    states = semi_filter(states, cases, [("case_id", "id")])
    clean = decode_nested_json(F.col("state_data"))
    issue = F.from_json(clean, CASE_TICKET_STATE)["stateData"]["Issue"]
    # the issue is short text taken from its document at once; the policy is a whole document, read from the largest one of the case
    issues = states.where(F.col("state") == codes.case_ticket_state).groupBy("case_id").agg(F.max(issue).alias("issue_type"))
    policies = largest_per_state(
        states.where(F.col("state") == codes.case_policy_state).withColumn("policy", clean), "case_id", "state", "policy"
    )
    rows = enrich(cases, main_countries(tables), [("region", "code")], {"country_id": "id"})
    rows = rows.where(one_of(F.col("country_id"), params.countries))
    rows = enrich(rows, issues, [("id", "case_id")], {"issue_type": "issue_type"})
    rows = enrich(rows, policies, [("id", "case_id")], {"policy": "policy"})
    payouts = tables["case_payment"].where(F.col("payout_target_type") == codes.case_payout_target)
    rows = enrich(rows, payouts, [("id", "case_id")], {"payout_amount": "payout_amount"})
    rows = rows.select(
        "passenger_id", "booking_code", "zendesk_ticket_id", F.col("created_at").alias("case_created_at"),
        "issue_type", "payout_amount",
        F.from_json("policy", CASE_POLICY_STATE)["stateData"]["RefundEntities"].alias("entities"),
    )
    rows = explode_list(rows, F.col("entities"), "item")
    item = F.col("item")
    return rows.withColumns({
        "item_name": item["name"],
        "item_id": item["ID"],
        "item_quantity": item["quantity"].try_cast("int"),
        "menu_type": item["menuType"],
        "item_price": number(item["singleReducedPrice"]),
    }).drop("item", "entities")


# Reports
ITEM_COLUMNS = (
    "buyer_id", "passenger_name", "booking_code", "first_transaction_time", "last_transaction_time", "ledger_entries",
    "order_id", "short_order_id", "merchant_id", "merchant_name", "chain_name", "chain_number", "refund_created_time",
    "booking_amount", "refund_amount", "account_balance", "refund_status", "source_of_refund", "item_name", "item_id",
    "item_price", "item_quantity", "total_price", "total_refund_per_item", "source_refund_amount", "customer_paid_amount",
    "order_promo_amount", "reason_code", "reason_category_code",
)
TIME_COLUMNS = ("order_create_date_local", "merchant_accept_time", "final_state", "order_delivery_date_local")
TICKET_COLUMNS = ("zendesk_ticket_id", "zendesk_disposition")


def _item_columns(params: RefundParams) -> list[str]:
    sub = list(SUB_ITEM_COLUMNS) if params.grain is RefundGrain.SUB_ITEM else []
    return [*ITEM_COLUMNS, *sub, *TIME_COLUMNS, *TICKET_COLUMNS]


def _with_tickets(tables: Tables, rows: DataFrame, params: RefundParams, ticket: str, tiebreak: str) -> DataFrame:
    key = never_matching(F.col(ticket), F.col(tiebreak))
    return enrich(rows, support_tickets(tables, params), [(key, "ticket")], {"ticket": "ticket", "disposition": "disposition"})


def request_report(tables: Tables, params: RefundParams) -> DataFrame:
    rows = enrich(request_items(tables, params), order_facts(tables, params), [("request_order_id", "order_id")], {
        name: name for name in ORDER_COLUMNS if name not in ("order_id", "buyer_id")
    })
    booking = never_matching(F.col("last_booking_code"), F.col("refund_id"))
    rows = enrich(rows, ledger_refunds(tables, params), [(booking, "booking_code")], LEDGER_TAKE)
    rows = _with_tickets(tables, rows, params, "request_ticket", "refund_id")
    rows = enrich(rows, tables["customer_dim"], [("passenger_id", "id")], {"passenger_name": "name"})
    rows = enrich(rows, tables["merchant"], [("request_merchant_id", "merchant_id")], MERCHANT_TAKE)
    rows = enrich(rows, tables["city"], [("city_id", "id")], {"time_zone": "time_zone"})
    return rows.withColumns({
        **order_times(),
        **ledger_columns(),
        "buyer_id": F.col("passenger_id"),
        "booking_code": F.col("last_booking_code"),
        "order_id": F.col("request_order_id"),
        "short_order_id": F.col("short_order_number"),
        "refund_created_time": local_time(F.col("request_created_at"), F.col("time_zone")),
        "source_of_refund": F.lit(params.codes.request_source_label),
        "source_refund_amount": F.col("total_refund_amount"),
        "customer_paid_amount": F.col("paid_amount"),
        "order_promo_amount": F.col("promo_amount"),
        "zendesk_ticket_id": F.coalesce("ticket", "request_ticket"),
        "zendesk_disposition": F.col("disposition"),
    }).select(*_item_columns(params))


def case_report(tables: Tables, params: RefundParams) -> DataFrame:
    cases = case_items(tables, params).withColumnRenamed("booking_code", "case_booking")
    rows = enrich(cases, order_facts(tables, params), [("case_booking", "last_booking_code")], {
        name: name for name in ORDER_COLUMNS if name != "buyer_id"
    })
    rows = enrich(rows, ledger_refunds(tables, params), [("case_booking", "booking_code")], LEDGER_TAKE)
    rows = rows.withColumnRenamed("zendesk_ticket_id", "case_ticket")
    rows = _with_tickets(tables, rows, params, "case_ticket", "case_booking")
    rows = enrich(rows, tables["customer_dim"], [("passenger_id", "id")], {"passenger_name": "name"})
    rows = enrich(rows, tables["merchant"], [("merchant_id", "merchant_id")], MERCHANT_TAKE)
    rows = enrich(rows, tables["city"], [("city_id", "id")], {"time_zone": "time_zone"})
    return rows.withColumns({
        **order_times(),
        **ledger_columns(),
        "buyer_id": F.col("passenger_id"),
        "booking_code": F.col("last_booking_code"),
        "short_order_id": F.col("short_order_number"),
        "refund_created_time": local_time(F.col("case_created_at"), F.col("time_zone")),
        "source_of_refund": F.lit(params.codes.case_source_label),
        "total_price": F.col("item_price") * F.col("item_quantity"),
        "total_refund_per_item": typed_null("double"),
        "source_refund_amount": F.col("payout_amount").cast("double"),
        "customer_paid_amount": F.lit(0.0),
        "order_promo_amount": F.lit(0.0),
        "reason_code": F.col("issue_type"),
        "reason_category_code": typed_null("string"),
        **{name: typed_null(kind) for name, kind in SUB_ITEM_COLUMNS.items()},
        "zendesk_ticket_id": F.coalesce("ticket", "case_ticket"),
        "zendesk_disposition": F.col("disposition"),
    }).select(*_item_columns(params))


def item_report(tables: Tables, params: RefundParams) -> DataFrame:
    branches = [(RefundSource.REQUEST, request_report), (RefundSource.CASE, case_report)]
    rows = [build(tables, params) for source, build in branches if source in params.sources]
    return reduce(DataFrame.unionByName, rows).where(one_of(F.col("merchant_id"), params.merchants))


def refunded_orders(orders: DataFrame, bookings: list[DataFrame], order_ids: list[DataFrame]) -> DataFrame:
    """Orders whose booking or id occurs in one of the refund sources (frames of one key column each).

    A Bloom filter of the keys drops most other orders at the scan. Keys then meet keys, two columns of the orders; the wide rows are
    cut by order id before any other join.
    """
    def routed(route: str, frames: list[DataFrame]) -> list[DataFrame]:
        return [df.select(F.lit(route).alias("route"), F.col(df.columns[0]).cast("string").alias("key")) for df in frames]

    keys = reduce(DataFrame.unionByName, [*routed("booking", bookings), *routed("order", order_ids)]).where("key is not null")

    def keyed(route: str, column: str):
        return F.struct(F.lit(route).alias("route"), F.col(column).cast("string").alias("key"))

    wanted = KeyFilter(keys.select(F.concat("route", "key").alias("key")), "key")
    orders = wanted.mark(orders, F.concat(F.lit("booking"), "last_booking_code"), "by_booking")
    orders = wanted.mark(orders, F.concat(F.lit("order"), F.col("order_id").cast("string")), "by_order")
    orders = orders.where(F.col("by_booking") | F.col("by_order")).drop("by_booking", "by_order")
    own = orders.select("order_id", F.inline(F.array(keyed("booking", "last_booking_code"), keyed("order", "order_id"))))
    found = semi_filter(own.where("key is not null"), keys, [("key", "key"), ("route", "route")])
    return semi_filter(orders, found, [("order_id", "order_id")])


def order_report(tables: Tables, params: RefundParams) -> DataFrame:
    """Orders with a ledger refund or a refund in a chosen source."""
    codes = params.codes
    orders = order_facts(tables, params)
    ledger = ledger_refunds(tables, params)
    booking = never_matching(F.col("last_booking_code"), F.col("order_id"))
    requests = refund_requests(tables, params) if RefundSource.REQUEST in params.sources else None
    cases = None
    if RefundSource.CASE in params.sources:
        cases = case_items(tables, params).groupBy("booking_code").agg(F.avg("payout_amount").alias("payout_amount"))
    rows = refunded_orders(
        orders, [df.select("booking_code") for df in (ledger, cases) if df is not None],
        [requests.select("request_order_id")] if requests is not None else [],
    )
    found, labels, amounts = [F.col("refund_booking")], [], []
    if requests is not None:
        rows = enrich(rows, requests, [("order_id", "request_order_id")], {
            "request_order": "request_order_id", "request_amount": "total_refund_amount",
        })
        labels.append((codes.request_source_label, F.col("request_order")))
        amounts.append(F.col("request_amount"))
        found.append(F.col("request_order"))
    rows = enrich(rows, ledger, [(booking, "booking_code")], {**LEDGER_TAKE, "refund_booking": "booking_code"})
    if cases is not None:
        rows = enrich(rows, cases, [(booking, "booking_code")], {
            "case_booking": "booking_code", "case_amount": "payout_amount",
        })
        # a case names the order's source before a request does; its amount comes after
        labels.insert(0, (codes.case_source_label, F.col("case_booking")))
        amounts.append(F.col("case_amount"))
        found.append(F.col("case_booking"))
    rows = rows.where(exists_any(found))
    rows = enrich(rows, support_tickets(tables, params), [(booking, "booking_code")], {
        "zendesk_ticket_id": "id", "zendesk_disposition": "disposition",
    })
    rows = enrich(rows, tables["customer_dim"], [("buyer_id", "id")], {"passenger_name": "name"})
    rows = enrich(rows, tables["merchant"], [("merchant_id", "merchant_id")], MERCHANT_TAKE)
    rows = enrich(rows, tables["city"], [("city_id", "id")], {"time_zone": "time_zone"})
    return rows.withColumns({
        **order_times(),
        **ledger_columns(),
        "booking_code": F.col("last_booking_code"),
        "short_order_id": F.col("short_order_number"),
        "source_of_refund": refund_source(labels),
        "captured_refund_amount": captured_amount(amounts),
    }).select(
        "buyer_id", "passenger_name", "booking_code", "first_transaction_time", "last_transaction_time", "ledger_entries",
        "booking_amount", "refund_amount", "account_balance", "refund_status", "source_of_refund",
        "captured_refund_amount", "order_id", "short_order_id", "merchant_id", "merchant_name", "chain_name",
        "chain_number", *TIME_COLUMNS, *TICKET_COLUMNS,
    )


def with_history(tables: Tables, rows: DataFrame, params: RefundParams) -> DataFrame:
    history = customer_history(
        tables["booking_base"], params.history_start, params.history_end, params.countries, params.cities
    )
    return enrich(rows, history, [("buyer_id", "passenger_id")], {name: name for name in HISTORY_COLUMNS})


def refund_report(tables: Tables, params: RefundParams) -> DataFrame:
    if not params.sources:
        raise ValueError("choose at least one refund source")
    build = order_report if params.grain is RefundGrain.ORDER else item_report
    rows = build(tables, params)
    return with_history(tables, rows, params) if params.history else rows
