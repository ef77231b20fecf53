"""Customer ratings by rating, by rating and category, and per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import Grain, between_days, bucket_start
from ..functions.predicates import any_of, one_of
from ..functions.scalars import typed_null
from ..operators.joins import enrich, join_valid
from ..sources.tables import Tables
from .params import RatingsParams

COLUMNS = [
    "country_id", "city_id", "merchant_id", "merchant_name", "business_name", "order_id", "period_start",
    "aggregation_level", "pax_rating_for_merchant", "rating_category", "specific_feedback", "no_of_orders",
]


def rated_orders(tables: Tables, params: RatingsParams) -> DataFrame:
    """Feedback rows of the wanted service, with merchant and country attributes."""
    rows = tables["rating_feedback"].withColumn("day", F.to_date("date_local"))
    rows = rows.where(between_days(F.col("day"), params.start, params.end) & one_of(F.col("city_id"), params.cities))
    if params.completed_only:
        rows = rows.where(F.col("booking_state_simple") == "COMPLETED")
    service = tables["service_type"].where(F.col("name") == params.codes.service_name)
    rows = join_valid(
        rows, service, [("taxi_type_id", "id")], "day", F.to_date("start_at"), F.to_date("end_at"), {}, "left", "inner"
    )
    rows = enrich(rows, tables["merchant_dim"], [("merchant_id", "merchant_id")], {
        "business_name": "business_name", "merchant_name": "merchant_name",
    })
    rows = enrich(rows, tables["city"], [("city_id", "id")], {"country_id": "country_id"})
    return rows.where(
        any_of([F.col("merchant_id"), F.col("business_name")], params.merchants)
        & one_of(F.col("country_id"), params.countries)
    )


def ratings_report(tables: Tables, params: RatingsParams) -> DataFrame:
    if params.grain is Grain.TOTAL:
        raise ValueError("ratings need a day, week or month grain")
    rows = rated_orders(tables, params)

    # Every order counts once under 'All' and once per listed category, and may be shown itself. All grains come from one pass: the
    # row is expanded into one entry per grain. Entries that are counted agree in all keys but these and fold map-side;
    # an entry that shows its order has a number of its own, and so passes through as a group of one row.
    period, number = bucket_start(F.col("day"), params.grain), F.monotonically_increasing_id()

    def entry(level: str, category: Column, shown: bool = False) -> Column:
        def only(name: str) -> Column:
            return F.col(name) if shown or params.by_merchant else typed_null("string")

        return F.struct(
            F.lit(level).alias("aggregation_level"), category.alias("rating_category"), only("merchant_id").alias("merchant_id"),
            only("merchant_name").alias("merchant_name"), (F.col("day") if shown else period).alias("period_start"),
            *[(F.col(source) if shown else typed_null("string")).alias(name) for name, source in (
                ("order_id", "order_id"), ("specific_feedback", "pax_feedback_for_merchant"))],
            (F.col("number") if shown else typed_null("bigint")).alias("number"),
        )

    entries = F.array(entry("Aggregated by Ratings", F.lit("All")))
    listed = F.transform(
        F.split("pax_rating_category", ";"), lambda part: entry("Aggregated by Ratings and Category", F.trim(part))
    )
    entries = F.when(listed.isNull(), entries).otherwise(F.concat(entries, listed))
    if params.include_orders:
        order = F.array(entry("Order Level", F.col("pax_rating_category"), shown=True))
        entries = F.when(F.col("pax_rating_for_merchant").isNull(), entries).otherwise(F.concat(entries, order))
    kept = ("country_id", "city_id", "business_name", "pax_rating_for_merchant")
    expanded = rows.withColumn("number", number).select(*kept, F.inline(entries))
    report = expanded.groupBy(*expanded.columns).agg(F.count(F.lit(1)).alias("no_of_orders"))
    orders_shown = F.when(F.col("number").isNull(), F.col("no_of_orders"))
    return report.withColumn("no_of_orders", orders_shown).select(*COLUMNS)
