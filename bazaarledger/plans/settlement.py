"""Settlement cash-out reconciliation: transaction rows and settlement totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codes import EARLY_PAYMENT_COUNTRIES, MAIN_COUNTRY_MAX_ID, SETTLEMENT_TX_TYPES
from ..functions.dates import between_days
from ..functions.predicates import any_of, is_set, one_of
from ..functions.report_rules import adjustment_amount, adjustment_indicator, adjustment_route, cashout_status
from ..functions.scalars import local_date, never_matching, shift_hours, text_guard, typed_null
from ..operators.aggregates import net_amount
from ..operators.joins import enrich, semi_filter
from ..operators.key_filter import KeyFilter
from ..sources.partitions import YearMonthDay, partition_between
from ..sources.tables import Tables
from .params import SettlementParams
from .windows import widened


def _searching(params: SettlementParams) -> bool:
    return params.search_merchant or is_set(params.merchant_info)


def _partner(params: SettlementParams, column: Column, other: str) -> Column:
    allowed = [params.codes.partner_orders] + ([] if params.own_partner_only else [other])
    return F.upper(column).isin(allowed)


def cashouts(tables: Tables, params: SettlementParams) -> DataFrame:
    """Successful cash-outs, summed per external reference."""
    hours = params.utc_offset_hours
    rows = tables["cashout_event"].where(
        (F.col("cashout_status") == params.codes.cashout_success)
        & _partner(params, F.col("partner_id"), params.codes.partner_multi)
        & one_of(F.col("currency"), params.currencies)
        & between_days(F.to_date(shift_hours(F.col("created"), hours)), params.start, params.end)
        & between_days(F.to_date(shift_hours(F.col("updated"), hours)), params.updated_start, params.updated_end)
        & one_of(F.col("user_cashout_ref_id"), params.settlement_ids)
    )
    return rows.groupBy("user_cashout_ref_id").agg(F.sum("amount").alias("cashed_out"))


def searched_merchants(tables: Tables, params: SettlementParams) -> DataFrame:
    """Wallet ids of the merchants searched for, in the two countries the search covers."""
    rows = enrich(tables["merchant_contract"], tables["store"], [("wallet_account_id", "wallet_account_id")], {
        "wallet_merchant_id": F.col("wallet_merchant_id").cast("string"),
    })
    rows = enrich(rows, tables["merchant_dim"], [("merchant_id", "merchant_id")], {
        "known_merchant_id": "merchant_id", "merchant_name": "merchant_name", "business_name": "business_name",
        "country_id": "country_id",
    })
    names = [F.col("known_merchant_id"), F.col("merchant_name"), F.col("business_name")]
    wanted = any_of(names, params.merchant_info) & F.col("country_id").isin(list(EARLY_PAYMENT_COUNTRIES))
    return rows.where(wanted).select("wallet_merchant_id").distinct()


def settled_transactions(tables: Tables, params: SettlementParams) -> DataFrame:
    """Wallet transactions netted per order, cash-out, settlement, merchant and currency."""
    created = widened(params.start, params.end, 2, 2)
    updated = widened(params.updated_start, params.updated_end, 2, 2)
    rows = partition_between(tables["wallet_tx"], params.start, params.end, 2, 2, YearMonthDay())
    rows = rows.where(
        _partner(params, F.col("partnerid"), params.codes.partner_lending)
        & one_of(F.col("currency"), params.currencies)
        & F.col("txtype").isin(list(SETTLEMENT_TX_TYPES))
        & between_days(F.to_date("created"), *created)
        & between_days(F.to_date("updated"), *updated)
    )
    if _searching(params):
        rows = semi_filter(rows, searched_merchants(tables, params), [("merchantid", "wallet_merchant_id")])
    net = F.col("amount") - F.col("refundamount")
    return rows.groupBy("orderid", "cashoutid", "settlementid", "merchantid", "currency").agg(
        *[F.max(name).alias(name) for name in ("partnerid", "partnertxid", "status", "id", "updated", "transactionupdatedat")],
        *[F.min(name).alias(name) for name in ("created", "transactioncreatedat")],
        net_amount(F.col("amount"), F.col("refundamount")).alias("credit_amount"),
        F.sum(adjustment_amount(F.col("postscript"), net)).alias("adjustment"),
    )


def order_keys(tables: Tables, params: SettlementParams, wanted: DataFrame | None = None) -> DataFrame:
    """Orders under both of their keys: plain rows match on booking-or-order, adjusted rows on the order id.

    `wanted` (route, orderid) are the keys they will be matched with: a Bloom filter of them keeps other orders out of all shuffles.
    """
    days = params.order_window_days
    orders = partition_between(tables["order_snapshot"], params.start, params.end, days, days)
    orders = partition_between(orders, params.updated_start, params.updated_end, days, days)
    orders = orders.select("order_id", "last_booking_code", "merchant_id", "short_order_number", "created_time", "city_id")
    if wanted is not None:
        keys = KeyFilter(wanted.select(F.concat("route", "orderid").alias("key")), "key")
        orders = keys.mark(orders, F.concat(F.lit("plain"), F.coalesce("last_booking_code", "order_id")), "as_plain")
        orders = keys.mark(orders, F.concat(F.lit("adjusted"), "order_id"), "as_adjusted")
        orders = orders.where(F.col("as_plain") | F.col("as_adjusted")).drop("as_plain", "as_adjusted")
    orders = enrich(orders, tables["city"], [("city_id", "id")], {"time_zone": "time_zone", "city_country": "country_id"})
    orders = orders.withColumn("order_create_date_local", local_date(F.col("created_time"), F.col("time_zone")))
    orders = orders.where(between_days(F.col("order_create_date_local"), *widened(params.start, params.end, days, days)))
    orders = enrich(orders, tables["country"], [("city_country", "id")], {"iso_currency": "iso_currency"})
    orders = orders.where(one_of(F.col("iso_currency"), params.currencies))
    if _searching(params):
        orders = enrich(orders, tables["merchant_dim"], [("merchant_id", "merchant_id")], {
            "known_merchant_id": "merchant_id", "merchant_name": "merchant_name", "business_name": "business_name",
        })
        orders = orders.where(
            any_of([F.col("known_merchant_id"), F.col("merchant_name"), F.col("business_name")], params.merchant_info)
        )

    def keyed(route: str, key: Column) -> Column:
        return F.struct(F.lit(route).alias("route"), key.alias("key"))

    booking_or_order = F.coalesce("last_booking_code", "order_id")
    return orders.select(
        "order_id", "short_order_number", "order_create_date_local", "merchant_id",
        F.explode(F.array(keyed("plain", booking_or_order), keyed("adjusted", F.col("order_id")))).alias("match"),
    )


def _with_store(tables: Tables, rows: DataFrame) -> DataFrame:
    """Store, payout account and bank of a wallet merchant."""
    rows = enrich(rows, tables["store"], [
        (F.col("merchantid").cast("string"), F.col("wallet_merchant_id").cast("string")),
    ], {"merchant_name": "trading_name", "wallet_account_id": "wallet_account_id"})
    rows = enrich(rows, tables["bank_account"], [("wallet_account_id", "store_wallet_account_id")], {
        "bank_statement_code": "bank_statement_code", "bank_account_number": text_guard(F.col("account_number")),
        "bank_swift_code": "swift_code", "bank_name_id": "bank_name_id",
    })
    return enrich(rows, tables["bank"], [("bank_name_id", "id")], {"bank_name": "bank_name"})


COLUMNS = [
    "id", "internal_settlement_id", "external_settlement_id", "partner_tx_id", "wallet_merchant_id", "merchant_name",
    "credit_amount", "currency", "tx_status", "record_type", "updated", "created", "booking_code", "tx_created_at",
    "tx_updated_at", "order_id", "short_order_number", "order_create_date_local", "order_merchant_name",
    "order_merchant_id", "bank_statement_code", "bank_account_number", "bank_swift_code", "bank_name",
    "wallet_account_id", "partner_id", "adjustment_indicator",
]


def transaction_rows(tables: Tables, params: SettlementParams) -> DataFrame:
    """Plain and adjusted transactions in one pass: the route picks which order key a row is matched on."""
    codes, hours = params.codes, params.utc_offset_hours
    settled = tables["settlement"].where(F.col("status") == codes.settlement_started).select(
        F.col("merchantid").alias("settled_merchant"), F.col("settlementid").alias("settled_id"),
        F.col("manualcashoutrefid").alias("external_settlement_id"), F.col("amount").alias("settled_amount"),
    )
    settled = enrich(settled, cashouts(tables, params), [("external_settlement_id", "user_cashout_ref_id")], {
        "cashed_out": "cashed_out",
    }, "inner")
    rows = settled_transactions(tables, params).withColumn("route", adjustment_route(F.col("adjustment")))
    rows = rows.where(F.col("route").isNotNull())
    rows = enrich(rows, settled, [("merchantid", "settled_merchant"), ("settlementid", "settled_id")], {
        name: name for name in ("external_settlement_id", "settled_amount", "cashed_out")
    }, "inner")
    rows = enrich(rows, order_keys(tables, params, rows.select("route", "orderid")), [("orderid", "match.key"), ("route", "match.route")], {
        "order_id": "order_id", "short_order_number": "short_order_number",
        "order_create_date_local": "order_create_date_local", "order_merchant_id": "merchant_id",
    })
    # sellers are looked up for matched rows only; transactions without an order have no merchant: spread their NULL key
    merchant = never_matching(F.col("order_merchant_id"), F.col("id"))
    rows = enrich(rows, tables["seller"], [(merchant, "id")], {"order_merchant_name": "name"})
    rows = _with_store(tables, rows)
    status = cashout_status(F.col("cashed_out"), F.col("settled_amount"), F.col("status"), codes.cashout_success)
    return rows.withColumns({
        "internal_settlement_id": F.col("settlementid"),
        "partner_tx_id": F.col("partnertxid"),
        "wallet_merchant_id": F.col("merchantid"),
        "tx_status": status,
        "record_type": F.lit("order details"),
        "updated": shift_hours(F.col("updated"), hours),
        "created": shift_hours(F.col("created"), hours),
        "booking_code": F.col("orderid"),
        "tx_created_at": shift_hours(F.col("transactioncreatedat"), hours),
        "tx_updated_at": shift_hours(F.col("transactionupdatedat"), hours),
        "partner_id": F.col("partnerid"),
        "adjustment_indicator": adjustment_indicator(F.col("adjustment"), F.col("partnerid"), codes.partner_orders),
    }).select(*COLUMNS)


def total_rows(tables: Tables, params: SettlementParams) -> DataFrame:
    """One row per settled settlement."""
    codes, hours = params.codes, params.utc_offset_hours
    rows = tables["settlement"].where(
        (F.col("status") == codes.settlement_done)
        & _partner(params, F.col("partnerid"), codes.partner_multi)
        & one_of(F.col("currency"), params.currencies)
        & between_days(F.to_date("created"), *widened(params.start, params.end, 2, 2))
        & between_days(F.to_date("updated"), *widened(params.updated_start, params.updated_end, 2, 2))
    )
    rows = enrich(rows, cashouts(tables, params), [("manualcashoutrefid", "user_cashout_ref_id")], {
        "cashed_out": "cashed_out",
    }, "inner")
    if _searching(params):
        rows = semi_filter(
            rows, searched_merchants(tables, params), [(F.col("merchantid").cast("string"), "wallet_merchant_id")]
        )
    main = tables["country"].where(F.col("id") <= MAIN_COUNTRY_MAX_ID)
    rows = enrich(rows, main, [("currency", "currency_symbol")], {})  # repeats rows where countries share a currency
    rows = _with_store(tables, rows)
    absent = {
        "partner_tx_id": "string", "booking_code": "string", "tx_created_at": "timestamp", "tx_updated_at": "timestamp",
        "order_id": "string", "short_order_number": "string", "order_create_date_local": "date",
        "order_merchant_name": "string", "order_merchant_id": "string", "adjustment_indicator": "string",
    }
    return rows.withColumns({
        "internal_settlement_id": F.col("settlementid"),
        "external_settlement_id": F.col("manualcashoutrefid"),
        "wallet_merchant_id": F.col("merchantid"),
        "credit_amount": F.col("amount"),
        "tx_status": cashout_status(F.col("cashed_out"), F.col("amount"), F.col("status"), codes.cashout_success),
        "record_type": F.lit("total"),
        "updated": shift_hours(F.col("updated"), hours),
        "created": shift_hours(F.col("created"), hours),
        "partner_id": F.col("partnerid"),
        **{name: typed_null(kind) for name, kind in absent.items()},
    }).select(*COLUMNS)


def settlement_report(tables: Tables, params: SettlementParams) -> DataFrame:
    rows = transaction_rows(tables, params).unionByName(total_rows(tables, params))
    kept = (F.col("external_settlement_id") != "") & one_of(F.col("tx_status"), params.statuses)
    kept = kept & one_of(F.col("external_settlement_id"), params.settlement_ids)
    if params.own_partner_only:
        kept = kept & (F.upper("partner_id") == params.codes.partner_orders)
    return rows.where(kept)
