"""Promo-funded orders: order snapshot against the spend dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import between_days
from ..functions.predicates import one_of, optional
from ..functions.report_rules import recon_labels
from ..functions.scalars import minor_to_major_whole, never_matching
from ..operators.explode import parse_once
from ..operators.joins import enrich, reconcile
from ..operators.skew import reconcile_hot
from ..sources.partitions import partition_between
from ..sources.tables import Tables, union_tables
from .params import PromoParams

_PROMO_DOCUMENT = (
    "cartWithQuote STRUCT<promoCodes: ARRAY<STRUCT<promoCode: STRING, promoAmountInMin: STRING>>,"
    " foodQuoteInMin: STRUCT<reducedPriceInMinorUnit: STRING, promoAmountInMinorUnit: STRING>>"
)


def promo_list(tables: Tables, params: PromoParams) -> DataFrame:
    """Distinct promos of all regions that overlap the period."""
    rows = union_tables(tables, params.regions)
    return rows.where(
        optional(lambda end: F.to_date("start_date") <= F.lit(end).cast("date"), params.end)
        & optional(lambda start: F.to_date("end_date") >= F.lit(start).cast("date"), params.start)
        & one_of(F.col("country"), params.country_names)
        & one_of(F.col("reward_id"), params.reward_ids)
    ).select("country", "promo_code", "reward_id").distinct()


def promo_orders(tables: Tables, params: PromoParams) -> DataFrame:
    """Orders paid with a listed promo; a promo listed under two codes gives the order twice."""
    orders = partition_between(tables["order_snapshot"], params.start, params.end, 1, 1)
    orders = orders.where(
        F.col("reward_id").isNotNull()
        & between_days(F.to_date("created_time"), params.start, params.end)
        & one_of(F.col("city_id"), params.cities)
        & one_of(F.col("country_id"), params.countries)
    )
    kept = ("order_id", "short_order_number", "last_booking_code", "order_state", "booking_state", "merchant_id", "created_time")
    parsed = parse_once(orders, [*kept, "reward_id"], {"doc": ("snapshot_detail", _PROMO_DOCUMENT)})
    cart = F.col("doc.cartWithQuote")
    first, quote = F.get(cart["promoCodes"], F.lit(0)), cart["foodQuoteInMin"]
    flat = parsed.where(cart["promoCodes"].isNotNull()).withColumns({
        "promo_code": first["promoCode"],
        "total_promo_code_expense": minor_to_major_whole(first["promoAmountInMin"]),
        "total_basket_size": minor_to_major_whole(
            quote["reducedPriceInMinorUnit"].try_cast("bigint") + quote["promoAmountInMinorUnit"].try_cast("bigint")
        ),
    }).drop("doc")
    return enrich(
        flat, promo_list(tables, params), [(F.col("reward_id").cast("string"), F.trim("reward_id"))], {}, "inner"
    ).drop("reward_id")


def promo_report(tables: Tables, params: PromoParams) -> DataFrame:
    """Default: filters act after the full join, so orders missing from the dashboard vanish whenever one is set.

    `keep_unmatched` filters the dashboard first and keeps them.
    """
    dashboard = tables["promo_order"].select(
        "order_id", "country_name", "city_name", F.col("merchant_promo_spend").alias("merchant_promo_code_spend"), "product_flag",
        F.to_date("date_local").alias("__day"), F.col("city_id").alias("__city"), F.col("country_id").alias("__country"),
        F.col("reward_id").cast("string").alias("__reward"),
    )
    wanted = (
        between_days(F.col("__day"), params.start, params.end)
        & one_of(F.col("__city"), params.cities)
        & one_of(F.col("__country"), params.countries)
        & one_of(F.col("__reward"), params.reward_ids)
    )
    orders = promo_orders(tables, params)

    def joined(dashboard: DataFrame) -> DataFrame:
        if params.hot_rows is None:
            return reconcile(orders, dashboard, "order_id")
        # what tells rows of one order id apart, or at least orders it may stand for
        return reconcile_hot(
            orders, dashboard, "order_id", ["last_booking_code", "short_order_number", "promo_code"],
            ["merchant_promo_code_spend", "__day", "__city", "__reward"], params.hot_rows,
        )

    rows = joined(dashboard.where(wanted)) if params.keep_unmatched else joined(dashboard).where(wanted)
    # orders found only in the dashboard have no merchant: spread their NULL key
    merchant = never_matching(F.col("merchant_id"), F.coalesce("order_id", "right_order_id"))
    rows = enrich(rows, tables["merchant_dim"], [(merchant, "merchant_id")], {"business_name": "business_name"})
    labels = recon_labels(F.col("product_flag"), F.col("in_right"), F.col("in_left"))
    return rows.withColumns(labels).select(
        "country_name", "city_name", "order_id", "short_order_number", "last_booking_code", "order_state", "booking_state",
        "merchant_id", "business_name", F.to_date("created_time").alias("date_local"), "created_time", "total_basket_size",
        "promo_code", "total_promo_code_expense", "merchant_promo_code_spend", *labels,
        F.col("right_order_id").alias("dashboard_order_id"),
    )
