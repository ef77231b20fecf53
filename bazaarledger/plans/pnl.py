"""Merchant or brand profit and loss per time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import between_days
from ..functions.predicates import any_of, one_of
from ..functions.report_rules import am_tag, pnl_metrics, unit_economics
from ..operators.aggregates import bucket_agg, derive_metrics
from ..operators.joins import enrich, join_valid_by_day
from ..sources.tables import Tables
from .params import Dimension, PnlParams


def _zero(*names: str) -> Column:
    total = F.coalesce(F.col(names[0]), F.lit(0))
    for name in names[1:]:
        total = total + F.coalesce(F.col(name), F.lit(0))
    return total


def pnl_measures() -> dict[str, Column]:
    """Sums follow the input type, so decimal measures add exactly. Row sums without `_zero` are NULL-strict."""
    col = F.col
    sheet = col("sheet_merchant_promo_spend_usd") + col("sheet_platform_promo_spend_usd")
    plain = {
        "gmv_usd": "gmv_usd",
        "basket_size_usd": "basket_size",
        "sub_total_usd": "sub_total",
        "all_incoming_orders": "all_incoming_orders",
        "completed_orders": "completed_orders",
        "total_cancellations": "cancellations",
        "delivery_fare_usd": "delivery_fare",
        "driver_delivery_fare_usd": "driver_delivery_fare",
        "merchant_commission_usd": "merchant_commission",
        "driver_commission_usd": "driver_commission",
        "incentives_usd": "incentives_usd",
        "spot_incentive_bonus_usd": "spot_incentive_bonus_usd",
        "subsidy_usd": "subsidy_usd",
        "total_partner_base_for_merchant_commission": "total_partner_base_for_merchant_commission",
        "total_promo_spend_usd": "total_promo_spend_usd",
        "total_platform_promo_spend_usd": "total_platform_promo_spend_usd",
        "total_discount_usd": "total_discount_usd",
        "total_campaign_merchant_promo_spend_usd": "total_campaign_merchant_promo_spend_usd",
        "code_merchant_promo_spend_usd": "code_merchant_promo_spend_usd",
        "support_expense_usd": "support_expense_usd",
        "ad_spend_usd": "ad_spend_usd",
        "batched_orders": "batched_orders",
    }
    return {
        **{name: F.sum(source) for name, source in plain.items()},
        "adj_gmv": F.sum(col("gmv_usd") + sheet),
        "adj_basket_size": F.sum(col("basket_size") + sheet),
        "order_fee_usd": F.sum(_zero("small_order_fee_usd", "convenience_fee_usd", "platform_fee_usd", "shopper_fee_usd")),
        "total_incentives_spend_usd": F.sum(_zero("incentives_usd", "spot_incentive_bonus_usd", "subsidy_usd")),
        "exchange_one_usd": F.avg("exchange_one_usd"),
    }


def pnl_report(tables: Tables, params: PnlParams) -> DataFrame:
    rows = tables["pnl_base"].where(between_days(F.col("partition_date_local"), params.start, params.end))
    # countries and days of the fact, two columns of it, before any lookup or filter
    instants = rows.select("country_name", F.to_date("date_local").alias("day")).distinct()
    instants = enrich(instants, tables["country"], [("country_name", "name")], {"country_id": "id"})
    rows = enrich(rows, tables["merchant_dim"], [("merchant_id", "merchant_id")], {
        "known_merchant_id": "merchant_id", "merchant_name": "merchant_name", "business_name": "business_name",
        "vertical": "vertical", "business_type_name": "business_type_name", "am_name": "am_name",
    })
    rows = rows.where(
        any_of([F.col("known_merchant_id"), F.col("business_name")], params.merchants)
        & one_of(F.col("business_type_name"), params.business_types)
        & one_of(F.col("vertical"), params.verticals)
    )
    rows = enrich(rows, tables["city"], [("city_name", "name")], {"city_id": "id"})
    rows = enrich(rows, tables["country"], [("country_name", "name")], {"country_id": "id"})
    rows = rows.where(one_of(F.col("city_id"), params.cities) & one_of(F.col("country_id"), params.countries))
    rows = rows.withColumn("day", F.to_date("date_local"))
    rows = join_valid_by_day(
        rows, tables["fx_rate"], [("country_id", "country_id")], "day", F.to_date("start_date"), F.to_date("end_date"),
        {"exchange_one_usd": "exchange_one_usd"}, instants=instants,
    )

    merchant = params.dimension is Dimension.MERCHANT
    rows = rows.withColumns({
        "merchant_business_name": F.col("merchant_name" if merchant else "business_name"),
        "merchant_id_business_name": F.col("merchant_id" if merchant else "business_name"),
        "business_merchant_aggregation": F.lit("By Merchant" if merchant else "By Brand"),
        "am_tagging": am_tag(F.col("am_name")),
        "time_aggregation": F.lit(params.grain.value),
    })
    keys = [
        "merchant_business_name", "merchant_id_business_name", "business_name", "business_merchant_aggregation", "vertical",
        "country_name", "city_name", "partner_status", "is_bd_account", "is_bd_partner", "business_model", "am_tagging",
        "time_aggregation",
    ]
    report = bucket_agg(rows, F.col("day"), params.grain, params.start, params.end, keys, pnl_measures())
    return derive_metrics(report, pnl_metrics(), unit_economics() if params.unit_economics else {})
