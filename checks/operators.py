"""One query per operator of the survey on the driver's tables, each next to the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarledger.functions import order_rules, payment_rules, report_rules
from bazaarledger.functions import scalars as sc
from bazaarledger.functions.dates import Grain, between_days, compact_date
from bazaarledger.functions.predicates import any_of, contains_ci, not_in_null_safe, one_of, optional
from bazaarledger.operators.aggregates import (
    bucket_agg,
    collapse_max,
    customer_history,
    derive_metrics,
    largest_per_state,
    net_amount,
    pivot_max,
    spread_by_type,
    sum_exploded,
    sum_list,
)
from bazaarledger.operators.explode import explode_keep_empty, explode_list, explode_or_default, parse_once
from bazaarledger.operators.intervals import join_valid_binned
from bazaarledger.operators.joins import (
    enrich,
    exists_any,
    join_valid,
    join_valid_by_day,
    reconcile,
    semi_filter,
)
from bazaarledger.operators.key_filter import KeyFilter
from bazaarledger.operators.skew import enrich_hot, reconcile_hot
from bazaarledger.plans import payments as p
from bazaarledger.plans import ratings_report
from bazaarledger.plans.params import RatingsParams
from bazaarledger.session import prepare
from bazaarledger.sources.documents import ORDER_DOCUMENT
from bazaarledger.sources.logs import log_events
from bazaarledger.sources.partitions import CompactDate, DateText, YearMonthDay, partition_between
from bazaarledger.sources.tables import Tables, union_tables

from . import report_oracles as ro
from .adapters import CODES, ZONES, marketplace, pick
from .reports import AS_OF, comparable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
col = F.col


class Source:
    """Driver tables by attribute, adapted report tables by key."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = prepare(spark), sf_dir
        self.market = marketplace(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def operator(name: str, sql: str) -> Callable[[Callable[[Source], DataFrame]], Callable[[Source], DataFrame]]:
    """Register a query under `name` with its oracle."""
    def register(build: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: comparable(build(Source(spark, sf_dir)))
        ORACLES[name] = sql
        return build

    return register


def cents(column: str) -> F.Column:
    return col(column).cast("decimal(18,2)")


# --- Scans -----------------------------------------------------------------------------------------------------
@operator("partition_window", """
select o_orderkey, 'text' as encoding from orders where o_orderdate between date '1995-05-31' and date '2001-01-01'
union all select o_orderkey, 'parts' from orders where o_orderdate between date '1995-05-17' and date '2001-01-15'
union all select o_orderkey, 'compact' from orders where o_orderdate between date '1995-05-18' and date '2001-01-01'
union all select o_orderkey, 'parsed' from orders where o_orderdate between date '1995-05-29' and date '2001-01-02'
""")
def partition_window(t: Source) -> DataFrame:
    day = col("o_orderdate")
    rows = t.orders.select(
        "o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("partition_date"),
        F.date_format(day, "yyyyMMdd").alias("compact"),
        *[part(day).cast("string").alias(name) for name, part in (("year", F.year), ("month", F.month), ("day", F.day))],
    )
    start, end = "1995-06-01", "2000-12-31"
    found = {
        "text": partition_between(rows, start, end, 1, 1, DateText()),
        "parts": partition_between(rows, start, end, 15, 15, YearMonthDay()),
        "compact": partition_between(rows, start, end, 14, 1, CompactDate("compact")),
        "parsed": rows.where(compact_date(col("compact")).between(
            F.date_sub(F.lit(start).cast("date"), 3), F.date_add(F.lit(end).cast("date"), 2))),
    }
    tagged = Tables.of({name: df.select("o_orderkey", F.lit(name).alias("encoding")) for name, df in found.items()})
    return union_tables(tagged, found)


@operator("regional_union_distinct", """
select distinct nation_key, segment from (
  select c_nationkey as nation_key, c_mktsegment as segment from customer union all
  select s_nationkey, 'SUPPLIER' from supplier union all select n_nationkey, 'NATION' from nation)
""")
def regional_union_distinct(t: Source) -> DataFrame:
    regional = Tables.of({
        "customers": t.customer.select(col("c_nationkey").alias("nation_key"), col("c_mktsegment").alias("segment")),
        "suppliers": t.supplier.select(F.lit("SUPPLIER").alias("segment"), col("s_nationkey").alias("nation_key")),
        "nations": t.nation.select(F.lit("NATION").alias("segment"), col("n_nationkey").alias("nation_key")),
    })
    return union_tables(regional, ["customers", "suppliers", "nations"]).distinct()


@operator("log_event_dedupe", """
select distinct cast(user_id as varchar) as user_key, event_type as kind, cast(ts as date) as day, 'seen' as label
from events where event_type in ('click', 'view', 'signup') and "value" > 1
""")
def log_event_dedupe(t: Source) -> DataFrame:
    logs = t.events.select(
        F.when(col("value") > 1, "web").otherwise("noise").alias("log"), F.to_date("ts").alias("day"),
        F.create_map(
            F.lit("operation.name"),
            F.when(col("event_type").isin("click", "view", "signup"), "track").otherwise("other"),
            F.lit("user"), col("user_id").cast("string"), F.lit("kind"), col("event_type"),
        ).alias("properties"),
    )
    return log_events(logs, "web", "track", {"user_key": "user", "kind": "kind"}, ("day",), ("label", "seen"))


# --- Projection and predicates ---------------------------------------------------------------------------------
@operator("projection_tags", """
select n.*, '`' || n_nationkey as guarded, null::varchar as order_id, null::double as amount, 'detail' as record_type,
  upper(n_name) || '-' || n_regionkey as label from nation n
""")
def projection_tags(t: Source) -> DataFrame:
    n = t.nation.alias("n")
    return n.select(
        "n.*", sc.text_guard(col("n_nationkey").cast("string")).alias("guarded"), sc.typed_null("string").alias("order_id"),
        sc.typed_null("double").alias("amount"), F.lit("detail").alias("record_type"),
        F.concat(F.upper("n_name"), F.lit("-"), "n_regionkey").alias("label"),
    )


@operator("predicate_suite", """
select l_orderkey, l_linenumber, p_name, l_returnflag from lineitem join part on p_partkey = l_partkey
where l_linenumber in (1, 2, 3, 5) and l_quantity between 3 and 48 and p_name ilike '%in%'
  and (p_brand in ('Brand#1', 'Brand#2', 'ECONOMY') or p_type in ('Brand#1', 'Brand#2', 'ECONOMY'))
  and not (coalesce(case when l_returnflag <> 'A' then l_returnflag end, '') in ('N'))
  and case when l_returnflag <> 'A' then l_returnflag end is distinct from 'X'
  and case when l_linestatus = 'F' then l_discount > 0.02 else l_tax > 0.01 end
""")
def predicate_suite(t: Source) -> DataFrame:
    flag = F.when(col("l_returnflag") != "A", col("l_returnflag"))
    by_status = F.when(col("l_linestatus") == "F", col("l_discount") > 0.02).otherwise(col("l_tax") > 0.01)
    rows = t.lineitem.where(
        col("l_linenumber").isin(1, 2, 3, 5) & col("l_quantity").between(3, 48) & not_in_null_safe(flag, ["N"])
        & (flag.isNull() | (flag != "X")) & by_status
    )
    rows = enrich(rows, t.part, [("l_partkey", "p_partkey")], {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type"}, "inner")
    wanted = contains_ci(col("p_name"), "IN") & any_of([col("p_brand"), col("p_type")], ["Brand#1", "Brand#2", "ECONOMY"])
    return rows.where(wanted).select("l_orderkey", "l_linenumber", "p_name", "l_returnflag")


def _optional_orders(t: Source, statuses: tuple[str, ...], floor: float | None) -> DataFrame:
    wanted = one_of(col("o_orderstatus"), statuses) & optional(lambda low: col("o_totalprice") > low, floor)
    return t.orders.where(wanted).select("o_orderkey", "o_orderstatus")


@operator("optional_predicate_unset", "select o_orderkey, o_orderstatus from orders")
def optional_unset(t: Source) -> DataFrame:
    return _optional_orders(t, (), None)


@operator("optional_predicate_set", """
select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'O') and o_totalprice > 100000
""")
def optional_set(t: Source) -> DataFrame:
    return _optional_orders(t, ("F", "O"), 100000.0)


# --- Joins -----------------------------------------------------------------------------------------------------
@operator("lookup_chain", """
select o_orderkey, c_name as customer, n_name as nation, r_name as region, n as same_status_orders
from orders left join customer on c_custkey = o_custkey left join nation on case when n_regionkey < 4 then n_nationkey end = c_nationkey
left join region on r_regionkey = n_regionkey
join (select o_custkey as k, o_orderstatus as s, count(*) as n from orders group by 1, 2) on k = o_custkey and s = o_orderstatus
""")
def lookup_chain(t: Source) -> DataFrame:
    rows = enrich(t.orders, t.customer, [("o_custkey", "c_custkey")], {"customer": "c_name", "nation_key": "c_nationkey"})
    known = F.when(col("n_regionkey") < 4, col("n_nationkey"))
    rows = enrich(rows, t.nation, [("nation_key", known)], {
        "nation": "n_name", "region_key": "n_regionkey",
    })
    rows = enrich(rows, t.region, [("region_key", "r_regionkey")], {"region": "r_name"})
    counts = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    rows = enrich(rows, counts, [("o_custkey", "o_custkey"), ("o_orderstatus", "o_orderstatus")], {
        "same_status_orders": "n",
    }, "inner")
    return rows.select("o_orderkey", "customer", "nation", "region", "same_status_orders")


@operator("right_and_narrowed_outer", """
select 'right' as shape, n_name as k, s_name as v from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 5000
union all
select 'narrowed', cast(o_orderkey as varchar), c_name from orders left join customer on c_custkey = o_custkey and c_acctbal > 5000
  where c_custkey is not null
""")
def right_and_narrowed_outer(t: Source) -> DataFrame:
    home = F.when(col("s_acctbal") > 5000, col("s_nationkey"))
    right = t.supplier.join(t.nation, home == col("n_nationkey"), "right").select(
        F.lit("right").alias("shape"), col("n_name").alias("k"), col("s_name").alias("v")
    )
    kept = t.orders.join(
        t.customer, (col("c_custkey") == col("o_custkey")) & (col("c_acctbal") > 5000), "left"
    ).where("c_custkey is not null")
    return right.unionByName(kept.select(
        F.lit("narrowed").alias("shape"), col("o_orderkey").cast("string").alias("k"), col("c_name").alias("v")))


@operator("reconcile_full_outer", """
select k as order_key, k2 as right_order_key, o_totalprice as total, returned,
  case when k2 is null then 'Not flagged in dashboard' else 'Returned' end as indicator,
  case when k is null then 'Not in orders' else 'In orders' end as indicator_2
from (select case when o_orderstatus <> 'P' then o_orderkey end as k, o_totalprice from orders) full join
  (select case when l_returnflag = 'R' then l_orderkey end as k2, count(*) as returned from lineitem group by 1) on k = k2
""")
def reconcile_full_outer(t: Source) -> DataFrame:
    left = t.orders.select(F.when(col("o_orderstatus") != "P", col("o_orderkey")).alias("order_key"), col("o_totalprice").alias("total"))
    right = t.lineitem.groupBy(F.when(col("l_returnflag") == "R", col("l_orderkey")).alias("order_key")).agg(
        F.count(F.lit(1)).alias("returned")
    )
    rows = reconcile(left, right, "order_key")
    labels = report_rules.recon_labels(F.lit("Returned"), col("in_right"), col("in_left"))
    return rows.withColumns(labels).drop("in_left", "in_right")


@operator("normalised_key_join", """
select s_suppkey, n_name as nation from supplier join nation on s_nationkey = n_nationkey
""")
def normalised_key_join(t: Source) -> DataFrame:
    suppliers = t.supplier.withColumn("nation_text", F.concat(F.lit("  Nation:"), col("s_nationkey").cast("string"), F.lit(" ")))
    key = F.replace(F.lower(F.trim("nation_text")), F.lit(":"), F.lit("_"))
    return enrich(suppliers, t.nation, [(key, F.lower("n_name"))], {"nation": "n_name"}, "inner").select("s_suppkey", "nation")


RATES = """(select r_regionkey as rk, make_date(y, 1, 1) as low, make_date(y, 12, 31) as high,
  r_regionkey + y % 4 * 0.25::double as rate from region, (select unnest(range(1995, 2001))::int as y)
  union all select 0, date '1997-06-01', date '1997-06-30', 8)"""


def _rates(t: Source) -> DataFrame:
    yearly = t.region.select(col("r_regionkey").alias("rk"), F.explode(F.sequence(F.lit(1995), F.lit(2000))).alias("y"))
    yearly = yearly.selectExpr("rk", "make_date(y, 1, 1) low", "make_date(y, 12, 31) high", "rk + y % 4 * 0.25D rate")
    extra = t.region.where("r_regionkey = 0").selectExpr("r_regionkey rk", "date'1997-06-01' low", "date'1997-06-30' high", "8D rate")
    return yearly.unionByName(extra)


FX_SQL = f"""
select o_orderkey, rate from orders left join {RATES} on rk = o_custkey % 5 and o_orderdate between low and high
"""


def _fx(t: Source, join: Callable[..., DataFrame]) -> DataFrame:
    orders = t.orders.withColumn("day", F.to_date("o_orderdate"))
    rows = join(orders, _rates(t), [(col("o_custkey") % 5, "rk")], "day", "low", "high", {"rate": "rate"})
    return rows.select("o_orderkey", "rate")


@operator("fx_closed_range", FX_SQL)
def fx_closed_range(t: Source) -> DataFrame:
    return _fx(t, join_valid)


@operator("fx_closed_range_by_day", FX_SQL)
def fx_closed_range_by_day(t: Source) -> DataFrame:
    return _fx(t, join_valid_by_day)


@operator("fx_average_rate", f"""
select date_trunc('month', o_orderdate)::date as month, sum(rate) / count(rate) as avg_rate, count(*) as n
from orders left join {RATES} on rk = o_custkey % 5 and o_orderdate between low and high group by 1
""")
def fx_average_rate(t: Source) -> DataFrame:
    orders = t.orders.withColumn("day", F.to_date("o_orderdate"))
    rows = join_valid_by_day(orders, _rates(t), [(col("o_custkey") % 5, "rk")], "day", "low", "high", {"rate": "rate"})
    return rows.groupBy(F.trunc("day", "month").alias("month")).agg(
        F.avg("rate").alias("avg_rate"), F.count(F.lit(1)).alias("n")
    )


@operator("validity_half_open", """
select event_id, name from events join (
  select n_nationkey as k, n_name || '-' || v as name, timestamp '2024-01-01' + to_days(cast(n_nationkey % 7 + v * 12 as int)) as low,
    timestamp '2024-01-01' + to_days(cast(n_nationkey % 7 + v * 12 + 12 as int)) as high
  from nation, (select unnest([0, 1]) as v)) on k = user_id % 25 and cast(ts as date) >= low and cast(ts as date) < high
""")
def validity_half_open(t: Source) -> DataFrame:
    versions = t.nation.selectExpr("n_nationkey k", "n_name", "explode(array(0, 1)) v").selectExpr(
        "k", "concat(n_name, '-', v) name", "date_add(date'2024-01-01', cast(k % 7 + v * 12 as int)) low",
        "date_add(date'2024-01-01', cast(k % 7 + v * 12 + 12 as int)) high",
    )
    rows = t.events.withColumn("day", F.to_date("ts"))
    rows = join_valid(rows, versions, [(col("user_id") % 25, "k")], "day", "low", "high", {"name": "name"}, "left", "inner")
    return rows.select("event_id", "name")


_PRICE_LISTS = """(select p_partkey % 3 as k, p_partkey as part, timestamp '2024-01-01' + to_minutes(p_partkey * 37 % 40000) as low,
  case when p_size = 50 then timestamp '2030-01-01' else timestamp '2024-01-01' + to_minutes(p_partkey * 37 % 40000 + p_size * p_size) end as high
  from part)"""


def _price_lists(t: Source) -> DataFrame:
    """Ranges of minutes to days, and a few without an end, thousands of them under each of three keys."""
    start = "timestampadd(MINUTE, cast(p_partkey * 37 % 40000 as int), timestamp'2024-01-01')"
    end = "timestampadd(MINUTE, cast(p_partkey * 37 % 40000 + p_size * p_size as int), timestamp'2024-01-01')"
    return t.part.selectExpr("p_partkey % 3 as k", "p_partkey as part", f"{start} as low", f"if(p_size = 50, timestamp'2030-01-01', {end}) as high")


def _priced(t: Source, join: Callable[..., DataFrame], how: str) -> DataFrame:
    """Thousands of lists hold an event at once; only their count and sum are asked for, so they are merged on the way."""
    taken, merge = {"parts": "part", "part_sum": "part"}, {"parts": "count", "part_sum": "sum"}
    rows = join(t.events, _price_lists(t), [(col("user_id") % 4, "k")], "ts", "low", "high", taken, "left", how, merge=merge)
    return rows.groupBy("event_id").agg(F.coalesce(F.sum("parts"), F.lit(0)).alias("parts"), F.sum("part_sum").alias("part_sum"))


_PRICED_SQL = f"""select event_id, count(part) as parts, cast(sum(part) as bigint) as part_sum
from events {{}} join {_PRICE_LISTS} on k = user_id % 4 and ts >= low and ts < high group by 1"""


@operator("validity_binned", _PRICED_SQL.format(""))
def validity_binned(t: Source) -> DataFrame:
    return _priced(t, join_valid_binned, "inner")


@operator("validity_binned_left", _PRICED_SQL.format("left"))
def validity_binned_left(t: Source) -> DataFrame:
    return _priced(t, join_valid_binned, "left")


@operator("hot_key_lookup", """
select l_orderkey, l_linenumber, s_name as supplier, n_name as nation from (select *, case when l_linenumber < 3 then 1 else l_suppkey end as k from lineitem)
left join supplier on s_suppkey = k and s_acctbal > 0 left join nation on n_nationkey = s_nationkey
""")
def hot_key_lookup(t: Source) -> DataFrame:
    lines = t.lineitem.withColumn("k", F.when(col("l_linenumber") < 3, 1).otherwise(col("l_suppkey")))
    suppliers = enrich(t.supplier.where("s_acctbal > 0"), t.nation, [("s_nationkey", "n_nationkey")], {"nation": "n_name"})
    rows = enrich_hot(lines, suppliers, [("k", "s_suppkey")], {"supplier": "s_name", "nation": "nation"}, ["l_orderkey", "l_linenumber"], hot_rows=1000)
    return rows.select("l_orderkey", "l_linenumber", "supplier", "nation")


_UNEVEN_SQL = """
select o_orderkey, c_custkey, c_name from (
  select o_orderkey, case o_orderpriority when '1-URGENT' then null when '2-HIGH' then 7 when '3-MEDIUM' then -1 else o_custkey end as k from orders)
full join (select c_custkey, c_name, case when c_mktsegment = 'BUILDING' then null when c_custkey % 50 = 3 then 7 else c_custkey end as k2 from customer) on k = k2
"""


@operator("reconcile_hot_keys", _UNEVEN_SQL)
def reconcile_hot_keys(t: Source) -> DataFrame:
    orders = t.orders.select("o_orderkey", F.when(col("o_orderpriority") == "2-HIGH", 7).when(col("o_orderpriority") == "3-MEDIUM", -1).when(
        col("o_orderpriority") != "1-URGENT", col("o_custkey")).alias("k"))
    customers = t.customer.select("c_custkey", "c_name", F.when(col("c_custkey") % 50 == 3, 7).otherwise(col("c_custkey")).alias("number"), "c_mktsegment")
    customers = customers.select("c_custkey", "c_name", F.when(col("c_mktsegment") != "BUILDING", col("number")).alias("k"))
    return reconcile_hot(orders, customers, "k", ["o_orderkey"], ["c_custkey"], hot_rows=100).select("o_orderkey", "c_custkey", "c_name")


@operator("key_filter", """
select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R' and l_quantity > 45)
""")
def key_filter_query(t: Source) -> DataFrame:
    wanted = t.lineitem.where("l_returnflag = 'R' and l_quantity > 45").select("l_orderkey")
    passed = KeyFilter(wanted, "l_orderkey").keep(t.orders, col("o_orderkey"))
    return semi_filter(passed, wanted, [("o_orderkey", "l_orderkey")]).select("o_orderkey", "o_totalprice")


@operator("largest_per_state", """
select user_id, event_type, max(props) as props from events where event_type is not null group by 1, 2
""")
def largest_per_state_query(t: Source) -> DataFrame:
    return largest_per_state(t.events, "user_id", "event_type", "props")


@operator("semi_filter", """
select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')
""")
def semi_filter_query(t: Source) -> DataFrame:
    keys = t.customer.where("c_mktsegment = 'BUILDING'")
    return semi_filter(t.orders, keys, [("o_custkey", "c_custkey")]).select("o_orderkey", "o_custkey")


@operator("exists_any", """
select o_orderkey, returned, c_name as rich_customer from orders
left join (select case when l_returnflag = 'R' then l_orderkey end as rk, count(*) as returned from lineitem group by 1) on rk = o_orderkey
left join (select case when c_acctbal > 8000 then c_custkey end as ck, c_name from customer) on ck = o_custkey
where rk is not null or ck is not null
""")
def exists_any_query(t: Source) -> DataFrame:
    returned = t.lineitem.groupBy(F.when(col("l_returnflag") == "R", col("l_orderkey")).alias("rk")).agg(F.count(F.lit(1)).alias("returned"))
    rows = enrich(t.orders, returned, [("o_orderkey", "rk")], {"returned": "returned"})
    rich = F.when(col("c_acctbal") > 8000, col("c_custkey"))
    rows = enrich(rows, t.customer, [("o_custkey", rich)], {"rich_customer": "c_name"})
    return rows.where(exists_any([col("returned"), col("rich_customer")])).select("o_orderkey", "returned", "rich_customer")


# --- Row generation --------------------------------------------------------------------------------------------
TAGS = "case event_type when 'click' then 'a; b;c' when 'view' then 'x;' when 'error' then null else 'one' end"


@operator("explode_list", f"""
select event_id, trim(part) as tag from (select event_id, unnest(string_split({TAGS}, ';')) as part from events)
""")
def explode_list_query(t: Source) -> DataFrame:
    rows = t.events.selectExpr("event_id", f"{TAGS} as tags")
    return explode_list(rows, F.split("tags", ";"), "part").select("event_id", F.trim("part").alias("tag"))


LISTS = "case l_returnflag when 'A' then '[]' when 'N' then null else concat('[', l_linenumber, ',', l_partkey, ']') end"


@operator("explode_default", """
select l_orderkey, 'No Sub Merchants' as item from lineitem where l_returnflag = 'N'
union all select l_orderkey, cast(l_linenumber as varchar) from lineitem where l_returnflag = 'R'
union all select l_orderkey, cast(l_partkey as varchar) from lineitem where l_returnflag = 'R'
""")
def explode_default(t: Source) -> DataFrame:
    rows = t.lineitem.selectExpr("l_orderkey", f"from_json({LISTS}, 'array<string>') items")
    return explode_or_default(rows, col("items"), F.lit("No Sub Merchants"), "item").select("l_orderkey", "item")


@operator("explode_keep_empty", """
select l_orderkey, null::varchar as item from lineitem where l_returnflag = 'A'
union all select l_orderkey, cast(l_linenumber as varchar) from lineitem where l_returnflag = 'R'
union all select l_orderkey, cast(l_partkey as varchar) from lineitem where l_returnflag = 'R'
""")
def explode_keep_empty_query(t: Source) -> DataFrame:
    rows = t.lineitem.selectExpr("l_orderkey", f"from_json({LISTS}, 'array<string>') items")
    return explode_keep_empty(rows, col("items"), "item").select("l_orderkey", "item")


# --- Aggregation -----------------------------------------------------------------------------------------------
@operator("state_pivot", """
select user_id, max(case when event_type = 'click' then "value" end) as top_click,
  max(case when event_type = 'purchase' then ts end) as last_purchase,
  max(case when event_type = 'error' then 'e' || event_id end) as error_tag from events group by 1
""")
def state_pivot(t: Source) -> DataFrame:
    return pivot_max(t.events, "user_id", "event_type", {
        "top_click": ("click", col("value")), "last_purchase": ("purchase", col("ts")),
        "error_tag": ("error", F.concat(F.lit("e"), col("event_id").cast("string"))),
    })


@operator("type_spread_collapse", f"""with {ro.LINES},
b as (
  select l_orderkey, case when l_partkey % 5 <= 2 then 'Cash' else 'Cashless' end as booking_type, min(l_shipdate) as first_day,
    max(case when l_linenumber = 1 then price_c else 0 end) as fee, max(case when l_linenumber = 14 then price_c else 0 end) as adj,
    max(case when l_linenumber = 1 then price_c else 0 end) as val, max(case when l_linenumber = 1 then disc_c else 0 end) as pr
  from ln group by all)
select booking_type, min(first_day) as first_day, cast(sum(adj) as double) / 100 as earning_adjustments,
  cast(sum(fee - adj) as double) / 100 as delivery_fee, cast(sum(val + pr) as double) / 100 as order_value,
  cast(sum(pr) as double) / 100 as promo, cast(sum(fee - adj + val) as double) / 100 as cash_collection from b group by 1
""")
def type_spread_collapse(t: Source) -> DataFrame:
    from .adapters import line_amounts

    kind, price = col("l_linenumber"), sc.minor_to_major(col("price_c"))
    rows = line_amounts(t.lineitem).withColumn("booking_type", report_rules.booking_type(col("l_partkey") % 5))
    rows = spread_by_type(rows, {
        "delivery_fee_plus_adjustments": (kind == 1, price), "order_value": (kind == 1, price),
        "earning_adjustments": (kind == 14, price),
    }).withColumn("promo", report_rules.promo_amount(kind, col("disc_c")))
    amounts = ["delivery_fee_plus_adjustments", "order_value", "earning_adjustments", "promo"]
    rows = collapse_max(rows, ["l_orderkey", "booking_type"], amounts, ["l_shipdate"])
    return rows.groupBy("booking_type").agg(
        F.min("l_shipdate").alias("first_day"), *[m.alias(name) for name, m in report_rules.cod_metrics().items()]
    )


@operator("conditional_sums", """
select l_returnflag, sum(cast(l_extendedprice as decimal(18,2)))::double as total, min(l_shipdate) as first_ship,
  max(l_linestatus) as last_status, count(*) as n, cast(sum(case when l_linestatus = 'F' then 1 else 0 end) as bigint) as n_f,
  sum(cast(l_tax as decimal(18,2)) + case when l_quantity > 10 then cast(l_discount as decimal(18,2)) end)::double as strict_sum,
  sum(cast(l_tax as decimal(18,2)) + coalesce(case when l_quantity > 10 then cast(l_discount as decimal(18,2)) end, 0))::double
    as tolerant_sum from lineitem group by 1
""")
def conditional_sums(t: Source) -> DataFrame:
    part = F.when(col("l_quantity") > 10, cents("l_discount"))
    return t.lineitem.groupBy("l_returnflag").agg(
        F.sum(cents("l_extendedprice")).alias("total"), F.min("l_shipdate").alias("first_ship"),
        F.max("l_linestatus").alias("last_status"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(col("l_linestatus") == "F", 1).otherwise(0)).alias("n_f"),
        F.sum(cents("l_tax") + part).alias("strict_sum"),
        F.sum(cents("l_tax") + F.coalesce(part, F.lit(0))).alias("tolerant_sum"),
    )


@operator("net_amount_join_back", """with agg as (
  select l_orderkey, sum(cast(l_extendedprice as decimal(18,2)) - cast(l_tax as decimal(18,2))) as net,
    sum(case when l_returnflag = 'R' then cast(l_extendedprice as decimal(18,2)) - cast(l_tax as decimal(18,2)) else 0 end) as adj
  from lineitem group by 1)
select o_orderkey, l_linenumber, net::double as net, adj::double as adjustment, case when adj = 0 then 'plain' else 'adjusted' end as route,
  case when adj <> 0 or upper(o_orderpriority) <> '5-LOW' then 'MPA Involved' end as indicator,
  case when net = cast(l_extendedprice as decimal(18,2)) - cast(l_tax as decimal(18,2)) then 'CASHOUT_SUCCESS' else o_orderstatus end as status
from orders join agg on agg.l_orderkey = o_orderkey join lineitem l on l.l_orderkey = o_orderkey
""")
def net_amount_join_back(t: Source) -> DataFrame:
    credit, debit = cents("l_extendedprice"), cents("l_tax")
    text = F.when(col("l_returnflag") == "R", "an ADJUSTMENT").otherwise("plain")
    agg = t.lineitem.groupBy("l_orderkey").agg(
        net_amount(credit, debit).alias("net"),
        F.sum(report_rules.adjustment_amount(text, credit - debit)).alias("adjustment"),
    )
    rows = enrich(t.lineitem, agg, [("l_orderkey", "l_orderkey")], {"net": "net", "adjustment": "adjustment"}, "inner")
    rows = enrich(rows, t.orders, [("l_orderkey", "o_orderkey")], {
        "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority",
    }, "inner")
    return rows.select(
        col("l_orderkey").alias("o_orderkey"), "l_linenumber", "net", "adjustment",
        report_rules.adjustment_route(col("adjustment")).alias("route"),
        report_rules.adjustment_indicator(col("adjustment"), col("o_orderpriority"), "5-LOW").alias("indicator"),
        report_rules.cashout_status(col("net"), credit - debit, col("o_orderstatus"), "CASHOUT_SUCCESS").alias("status"),
    )


BUCKET_START, BUCKET_END = "2024-01-03", "2024-01-27"


def _bucket(grain: Grain, keys: list[str]) -> Callable[[Source], DataFrame]:
    def build(t: Source) -> DataFrame:
        day = F.to_date("ts")
        rows = t.events.where(between_days(day, BUCKET_START, BUCKET_END))
        return bucket_agg(rows, day, grain, BUCKET_START, BUCKET_END, keys, {
            "total": F.sum(cents("value")), "n": F.count(F.lit(1)),
        })

    return build


def _bucket_sql(low: str, high: str, keys: str) -> str:
    return f"""
select {keys}, {low} as start_date, {high} as end_date, sum(cast("value" as decimal(18,2)))::double as total, count(*) as n
from events where cast(ts as date) between date '{BUCKET_START}' and date '{BUCKET_END}' group by all"""


_FIRST, _LAST = f"date '{BUCKET_START}'", f"date '{BUCKET_END}'"
for _name, _grain, _low, _high, _keys in (
    ("bucket_total", Grain.TOTAL, _FIRST, _LAST, ["event_type"]),
    ("bucket_month", Grain.MONTH, f"greatest(date_trunc('month', ts)::date, {_FIRST})", f"least(last_day(ts), {_LAST})", ["event_type", "user_id"]),
    ("bucket_week", Grain.WEEK, f"greatest(date_trunc('week', ts)::date, {_FIRST})", f"least(date_trunc('week', ts)::date + 6, {_LAST})", ["event_type"]),
    ("bucket_day", Grain.DAY, "cast(ts as date)", "cast(ts as date)", ["user_id"]),
):
    operator(_name, _bucket_sql(_low, _high, ", ".join(_keys)))(_bucket(_grain, _keys))


@operator("derived_metrics", """with agg as (
  select s_suppkey, case when s_acctbal < 5000 then 'Non-AM' else 'AM' end as am_tagging,
    sum(cast(l_extendedprice as decimal(18,2)))::double as sales, count(*) filter (where l_returnflag = 'R') as returns,
    count(*) filter (where l_quantity > 50) as huge
  from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2)
select *, sales / nullif(returns, 0) as sales_per_return, sales / nullif(huge, 0) as sales_per_huge, sales - returns as net,
  (sales - returns) / sales as margin from agg
""")
def derived_metrics(t: Source) -> DataFrame:
    rows = enrich(t.lineitem, t.supplier, [("l_suppkey", "s_suppkey")], {
        "s_suppkey": "s_suppkey", "manager": F.when(col("s_acctbal") >= 5000, "m"),
    }, "inner")
    agg = rows.groupBy("s_suppkey", report_rules.am_tag(col("manager")).alias("am_tagging")).agg(
        F.sum(cents("l_extendedprice")).cast("double").alias("sales"),
        F.count(F.when(col("l_returnflag") == "R", 1)).alias("returns"),
        F.count(F.when(col("l_quantity") > 50, 1)).alias("huge"),
    )
    return derive_metrics(agg, {
        "sales_per_return": sc.safe_ratio(col("sales"), col("returns")),
        "sales_per_huge": sc.safe_ratio(col("sales"), col("huge")),
        "net": col("sales") - col("returns"),
    }, {"margin": sc.safe_ratio(col("net"), col("sales"))})


@operator("pnl_metrics", """with a as (
  select l_returnflag as flag, sum(l_quantity) as sales, sum(cast(l_partkey as double)) as driver, sum(cast(l_suppkey as double)) as merchant,
    count(*)::double as n, count(*) filter (where l_linenumber = 1) as done from lineitem group by 1)
select flag, driver + merchant + n + sales as gross_revenue, driver + merchant + n + sales - n - n as profit_before_overhead,
  (driver + merchant + n + sales - n - n) / sales as profit_margin_on_adj_gmv, sales / nullif(done, 0) as avg_basket_size,
  merchant / sales as blended_commission_rate, (driver + merchant + n + sales - n - n) / nullif(done, 0) as profit_per_order from a
""")
def pnl_metrics_query(t: Source) -> DataFrame:
    count = F.count(F.lit(1)).cast("double")
    agg = t.lineitem.groupBy(col("l_returnflag").alias("flag")).agg(
        F.sum("l_quantity").alias("adj_gmv"), F.sum("l_quantity").alias("ad_spend_usd"), F.sum("l_quantity").alias("basket_size_usd"),
        F.sum("l_quantity").alias("total_partner_base_for_merchant_commission"),
        F.sum(col("l_partkey").cast("double")).alias("driver_commission_usd"),
        F.sum(col("l_suppkey").cast("double")).alias("merchant_commission_usd"),
        *[count.alias(n) for n in ("order_fee_usd", "total_incentives_spend_usd", "total_platform_promo_spend_usd", "support_expense_usd")],
        F.count(F.when(col("l_linenumber") == 1, 1)).alias("completed_orders"),
    )
    return derive_metrics(agg, report_rules.pnl_metrics(), report_rules.unit_economics()).select(
        "flag", "gross_revenue", "profit_before_overhead", "profit_margin_on_adj_gmv", "avg_basket_size",
        "blended_commission_rate", "profit_per_order",
    )


DISCOUNTS_SQL = f"""with {ro.LINES}
select l_orderkey, case when count(*) filter (where l_returnflag = 'R') > 0 then
  cast(sum(disc_c) filter (where l_returnflag = 'R') as double) end as discount_minor from ln group by 1"""


def _discount_texts(t: Source) -> DataFrame:
    from .adapters import line_amounts

    item = "if(l_returnflag = 'R', named_struct('amount', disc_c), null)"
    return line_amounts(t.lineitem).groupBy("l_orderkey").agg(F.expr(f"to_json(named_struct('discounts', collect_list({item})))").alias("doc"))


def _discount_documents(t: Source, variant: bool = False) -> DataFrame:
    rows = _discount_texts(t)
    if variant:
        rows = rows.withColumn("doc", F.try_parse_json("doc"))
    parsed = parse_once(rows, ["l_orderkey"], {"doc": ("doc", "discounts ARRAY<STRUCT<amount: STRING>>")})
    return parsed.select("l_orderkey", col("doc.discounts").alias("discounts"))


@operator("discounts_from_variant", DISCOUNTS_SQL)
def discounts_from_variant(t: Source) -> DataFrame:
    rows = _discount_documents(t, variant=True)
    return rows.select("l_orderkey", sum_list(col("discounts"), lambda d: sc.number(d["amount"])).alias("discount_minor"))


@operator("discounts_from_json", DISCOUNTS_SQL)
def discounts_from_json(t: Source) -> DataFrame:
    rows = _discount_documents(t)
    return rows.select("l_orderkey", sum_list(col("discounts"), lambda d: sc.number(d["amount"])).alias("discount_minor"))


@operator("discounts_exploded", f"select * from ({DISCOUNTS_SQL}) where discount_minor is not null")
def discounts_exploded(t: Source) -> DataFrame:
    rows = _discount_documents(t)
    return sum_exploded(rows, "l_orderkey", col("discounts"), {"discount_minor": lambda d: sc.number(d["amount"])})


@operator("customer_history", """
select case when o_orderpriority <> '3-MEDIUM' then o_custkey end as passenger_id, count(*) as total_attempted_orders,
  cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as total_completed_orders,
  sum(case when o_orderstatus = 'F' then floor(o_totalprice) / fx else 0 end) as total_basket_size_pre_discount_usd,
  sum(case when o_orderstatus = 'F' then (floor(o_totalprice) - floor(o_totalprice / 10000)) / fx else 0 end)
    as total_basket_size_after_discount_usd, date '1995-01-01' as history_start_date, date '1999-12-31' as history_end_date
from (select *, case o_orderkey % 3 when 0 then 1 when 1 then 2 else 4 end as fx from orders)
where o_orderdate <= date '1999-12-31' and (o_custkey % 25) % 5 + 1 in (1, 2, 3) group by 1
""")
def customer_history_query(t: Source) -> DataFrame:
    return customer_history(t.market["booking_base"], "1995-01-01", "1999-12-31", countries=(1, 2, 3))


operator("ratings_grains", ro.r12(True, "day", True, False))(
    lambda t: ratings_report(t.market, RatingsParams(grain=Grain.DAY, start="2024-01-01", end="2024-01-31", include_orders=True))
)


@operator("settlement_rows", """with tx as (
  select l_orderkey, l_suppkey, sum(floor(l_extendedprice)) as net, sum(case when l_returnflag = 'R' then floor(l_extendedprice) else 0 end) as adj
  from lineitem group by 1, 2)
select l_orderkey, l_suppkey, net, 'order details' as record_type, o_orderstatus as status from tx
  left join (select case when o_orderpriority <> '5-LOW' then o_orderkey end as k, o_orderstatus from orders) on k = l_orderkey where adj = 0
union all select l_orderkey, l_suppkey, net, 'order details', o_orderstatus from tx
  left join (select case when o_orderpriority <> '5-LOW' then o_orderkey end as k, o_orderstatus from orders) on k + 1 = l_orderkey where adj <> 0
union all select null, l_suppkey, sum(floor(l_extendedprice)), 'total', null from lineitem group by 2
""")
def settlement_rows(t: Source) -> DataFrame:
    amount = F.floor("l_extendedprice").cast("double")
    tx = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(
        F.sum(amount).alias("net"), F.sum(F.when(col("l_returnflag") == "R", amount).otherwise(0)).alias("adj")
    ).withColumn("route", report_rules.adjustment_route(col("adj")))
    known = F.when(col("o_orderpriority") != "5-LOW", col("o_orderkey"))
    keyed = t.orders.select("o_orderstatus", F.explode(F.array(
        F.struct(F.lit("plain").alias("route"), known.alias("key")),
        F.struct(F.lit("adjusted").alias("route"), (known + 1).alias("key")),
    )).alias("m"))
    detail = enrich(tx, keyed, [("l_orderkey", "m.key"), ("route", "m.route")], {"status": "o_orderstatus"}).select(
        "l_orderkey", "l_suppkey", "net", F.lit("order details").alias("record_type"), "status"
    )
    total = t.lineitem.groupBy("l_suppkey").agg(F.sum(amount).alias("net")).select(
        sc.typed_null("bigint").alias("l_orderkey"), "l_suppkey", "net", F.lit("total").alias("record_type"),
        sc.typed_null("string").alias("status"),
    )
    return detail.unionByName(total)


# --- Dates -----------------------------------------------------------------------------------------------------
@operator("local_time", f"""
select event_id, ts at time zone 'UTC' at time zone zone as at_local, cast(ts at time zone 'UTC' at time zone zone as date) as day_local,
  strftime(ts + to_hours(8), '%Y-%m-%d') as fixed_day, date_trunc('second', ts) as parsed,
  date_trunc('second', ts) - to_hours(8) as parsed_offset, null::timestamp as unreadable
from events join (select n_nationkey, {pick(ZONES, 'n_nationkey % 5')} as zone from nation) on n_nationkey = user_id % 25
""")
def local_time_query(t: Source) -> DataFrame:
    zones = t.nation.selectExpr("n_nationkey", f"{pick(ZONES, 'n_nationkey % 5')} as zone")
    rows = enrich(t.events, zones, [(col("user_id") % 25, "n_nationkey")], {"zone": "zone"}, "inner")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(
        "event_id", sc.local_time(col("ts"), col("zone")).alias("at_local"), sc.local_date(col("ts"), col("zone")).alias("day_local"),
        F.date_format(sc.shift_hours(col("ts"), 8), "yyyy-MM-dd").alias("fixed_day"),
        sc.iso_time(F.regexp_replace(text, "T", " ")).alias("parsed"),
        sc.iso_time(F.concat(text, F.lit("+08:00"))).alias("parsed_offset"),
        sc.iso_time(F.concat(F.lit("x"), text)).alias("unreadable"),
    )


@operator("time_gaps", f"""with {ro.ORDERS}, {ro.LOGS}
select order_id, delay as seconds, date '{AS_OF}' - cast(created_time as date) as age_days, ({ro.AUTO}) as auto_accepted, {ro.LABELS}
from ord left join aa on log_order = order_id and log_merchant = merchant_id
""")
def time_gaps(t: Source) -> DataFrame:
    orders = _states(t)
    auto = order_rules.auto_accepted(col("logged"), AS_OF)
    return orders.select(
        "order_id", order_rules.accept_delay_seconds().alias("seconds"),
        F.datediff(F.lit(AS_OF).cast("date"), F.to_date("created_time")).alias("age_days"), auto.alias("auto_accepted"),
        *[label.alias(name) for name, label in order_rules.accept_labels(auto).items()],
    )


def _with_metadata(orders: DataFrame) -> DataFrame:
    orders = orders.withColumn("meta", F.from_json("metadata", p.ORDER_METADATA))
    return orders.withColumns({"has_metadata": col("metadata") != "", **order_rules.metadata_fields(col("meta"))})


def _states(t: Source) -> DataFrame:
    """Orders with their metadata and whether an acceptance was logged."""
    orders = _with_metadata(t.market["order_snapshot"].drop("snapshot_detail"))
    logs = t.market["app_log"].withColumn("log_date", YearMonthDay().value())
    found = log_events(logs, CODES.accept_log, CODES.accept_operation, {"m": "merchantID", "o": "orderID"}, ("log_date",))
    rows = enrich(orders, found, [("order_id", "o"), ("merchant_id", "m")], {"log_order": "o"})
    return rows.withColumn("logged", col("log_order").isNotNull())


# --- JSON ------------------------------------------------------------------------------------------------------
JSON_PATHS_SQL = """
select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, user_id as first_user, null::varchar as missing,
  user_id * 100 + event_id % 100 as minor, (user_id * 100 + event_id % 100) // 100 as whole, (user_id * 100 + event_id % 100) / 100 as major,
  (user_id * 100 + event_id % 100) / power(10, 2) as by_exponent, event_type as item_name, event_type = 'click' as is_empty, null::double as malformed,
  round(cast("value" as decimal(18,3)) / 1, 2)::double as rounded, coalesce(case when event_type = 'view' then 'v' end, 'other') as first_known
from events
"""


def _event_documents(t: Source) -> DataFrame:
    """Events with a JSON document that holds further documents as text."""
    inner = F.to_json(F.struct(col("event_type").alias("name"), F.when(
        col("event_type") == "click", F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("subs")))
    doc = F.to_json(F.struct(
        F.array(F.struct(col("user_id").alias("c"))).alias("p"), (col("user_id") * 100 + col("event_id") % 100).alias("minor"),
        F.array(inner).alias("items"),
    ))
    return t.events.select("event_id", "value", "event_type", "props", doc.alias("doc"))


@operator("variant_paths", JSON_PATHS_SQL)
def variant_paths(t: Source) -> DataFrame:
    rows = _event_documents(t).select(
        "event_id", "value", "event_type", F.try_parse_json("props").alias("props"), F.try_parse_json("doc").alias("doc"),
        F.try_parse_json(F.substr("doc", F.lit(2))).alias("broken"),
    )
    rows = rows.withColumn("first", F.try_parse_json(F.get(F.try_variant_get("doc", "$.items", "array<string>"), F.lit(0))))
    minor = F.try_variant_get("doc", "$.minor", "string")
    return rows.select(
        "event_id", F.try_variant_get("props", "$.k", "bigint").alias("k"), F.try_variant_get("doc", "$.p[0].c", "bigint").alias("first_user"),
        F.try_variant_get("doc", "$.p[3].c", "string").alias("missing"), F.try_variant_get("doc", "$.minor", "bigint").alias("minor"),
        sc.minor_to_major_whole(minor).alias("whole"), sc.minor_to_major(minor).alias("major"),
        sc.minor_to_major(minor, F.lit(2)).alias("by_exponent"), F.try_variant_get("first", "$.name", "string").alias("item_name"),
        (F.size(F.try_variant_get("first", "$.subs", "array<string>")) == 0).alias("is_empty"),
        F.try_variant_get("broken", "$.minor", "double").alias("malformed"),
        F.round(col("value").cast("decimal(18,3)"), 2).alias("rounded"),
        F.coalesce(F.when(col("event_type") == "view", "v"), F.lit("other")).alias("first_known"),
    )


@operator("json_paths", JSON_PATHS_SQL)
def json_paths(t: Source) -> DataFrame:
    rows = _event_documents(t)
    items = F.from_json(sc.decode_nested_json(F.get_json_object("doc", "$.items")), "array<map<string,string>>")
    first = F.get(items, F.lit(0))
    minor = F.get_json_object("doc", "$.minor")
    return rows.select(
        "event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
        F.get_json_object("doc", "$.p[0].c").try_cast("bigint").alias("first_user"),
        F.get_json_object("doc", "$.p[3].c").alias("missing"), minor.try_cast("bigint").alias("minor"),
        sc.minor_to_major_whole(minor).alias("whole"), sc.minor_to_major(minor).alias("major"),
        sc.minor_to_major(minor, F.lit(2)).alias("by_exponent"), F.element_at(first, F.lit("name")).alias("item_name"),
        (F.size(F.from_json(F.element_at(first, F.lit("subs")), "array<string>")) == 0).alias("is_empty"),
        sc.number(F.get_json_object(F.substr("doc", F.lit(2)), "$.minor")).alias("malformed"),
        F.round(col("value").cast("decimal(18,3)"), 2).alias("rounded"),
        F.coalesce(F.when(col("event_type") == "view", "v"), F.lit("other")).alias("first_known"),
    )


# --- Business rules --------------------------------------------------------------------------------------------
_STATE_SQL = f"with {ro.ORDERS}, {ro.LOGS}\nselect order_id, {{}} from ord {{}}"
_LOG_JOIN = "left join aa on log_order = order_id and log_merchant = merchant_id"


@operator("final_state", _STATE_SQL.format(f"{ro.FINAL_STATE} as final_state, {ro.POS}, {ro.PAYER}", ""))
def final_state_query(t: Source) -> DataFrame:
    orders = _with_metadata(t.market["order_snapshot"].drop("snapshot_detail"))
    flags = order_rules.pos_flags(CODES)
    return orders.select("order_id", order_rules.final_state().alias("final_state"), *[f.alias(n) for n, f in flags.items()])


@operator("pay_status", _STATE_SQL.format(f"{ro.PAY} as pay_status", _LOG_JOIN))
def pay_status_query(t: Source) -> DataFrame:
    return _states(t).select("order_id", order_rules.pay_status(order_rules.auto_accepted(col("logged"), AS_OF)).alias("pay_status"))


@operator("pay_status_v1", _STATE_SQL.format(f"{ro.PAY_V1} as pay_status", _LOG_JOIN))
def pay_status_v1_query(t: Source) -> DataFrame:
    return _states(t).select("order_id", order_rules.pay_status_v1(col("logged")).alias("pay_status"))


@operator("order_values_commissions_net", f"""with {ro.ORDERS}
select order_id, case when o_orderkey % 2 = 0 then (price_c - tax_c) / 100 else price_c / 100 end as order_value_pre_tax,
  case when o_orderkey % 2 = 0 then price_c / 100 else (price_c + tax_c) / 100 end as order_value_with_tax, tax_c / 100 as tax_value,
  (com_c + case when m_key % 4 < 2 then gk_c else 0 end) / 100 as commission_value, com_c / 100 as commission_value_base,
  (com_c // 10 + gk_c // 10) / 100 as commission_value_step_up, cast(0.25 + case when m_key % 4 < 2 then 0.125 else 0 end as double) as commission_rate,
  case when m_key % 4 < 2 then 0.125::double end as commission_rate_kitchen, m_key % 4 < 2 as is_kitchen, m_key % 4 = 0 as is_kitchen_mixed,
  (price_c - funded_ex_c - com_c - case when m_key % 4 < 2 then gk_c else 0 end) / 100 as net_payable,
  (price_c - tax_c) / 100 - com_c / 100 as net_sub_merchant, coalesce(cancel_code, o_orderkey % 4 / 16) as preferred,
  o_custkey % 5 in (0, 1) as pays_out, case when contains(short_order_number, '7') then 'order' else 'mart' end as promo_source from ord
""")
def order_values_commissions_net(t: Source) -> DataFrame:
    doc = F.from_json("snapshot_detail", ORDER_DOCUMENT)
    rows = t.market["order_snapshot"].withColumn("doc", doc)
    info, quote = p.merchant_info(), p.quote()
    pre_tax, tax = payment_rules.quoted_pre_tax(quote), sc.number_or_zero(quote["inclTaxInMin"]) / 100
    shares = payment_rules.commissions(quote, info)
    kept = ("commission_value", "commission_value_base", "commission_value_step_up", "commission_rate", "commission_rate_kitchen")
    currency = F.expr(pick(("SGD", "MYR", "THB", "PHP", "VND"), "buyer_id % 5"))
    return rows.select(
        "order_id", *[v.alias(n) for n, v in payment_rules.order_values(p.doc()).items()], *[shares[n].alias(n) for n in kept],
        *[v.alias(n) for n, v in order_rules.kitchen_flags(info["specialMerchantType"], CODES).items()],
        payment_rules.net_payable(pre_tax, tax, p.discount_fields()["funded_discount_ex_tax"], shares["commission_value"]).alias("net_payable"),
        payment_rules.net_payable_sub_merchant(pre_tax, shares["commission_value_base"]).alias("net_sub_merchant"),
        payment_rules.prefer(col("cancel_code").cast("double"), col("commission")).alias("preferred"),
        payment_rules.payout_filter(currency, F.lit(60), {"SGD": (60,), "MYR": (60,), "THB": (56,)}).alias("pays_out"),
        payment_rules.promo_override(col("short_order_number"), "7", F.lit("order"), F.lit("mart")).alias("promo_source"),
    )


@operator("refund_status_source", """with r as (
  select l_orderkey, sum(floor(l_extendedprice)) as credit from lineitem where l_returnflag = 'R' group by 1),
c as (select l_orderkey as ck, sum(floor(l_quantity)) as amount from lineitem where l_returnflag = 'A' group by 1)
select o_orderkey, case when credit = floor(o_totalprice) or o_orderpriority = '1-URGENT' and credit is not null then 'Full Refund'
    else 'Partial Refund' end as refund_status,
  case when ck is not null then 'Case' when l_orderkey is not null then 'Request' end as source_of_refund, coalesce(credit, amount, 0) as captured
from orders left join r on l_orderkey = o_orderkey left join c on ck = o_orderkey
""")
def refund_status_source(t: Source) -> DataFrame:
    def per_order(flag: str, column: str) -> DataFrame:
        return t.lineitem.where(col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.sum(F.floor(column).cast("double")).alias("amount"))

    rows = enrich(t.orders, per_order("R", "l_extendedprice"), [("o_orderkey", "l_orderkey")], {"credit": "amount", "request": "l_orderkey"})
    rows = enrich(rows, per_order("A", "l_quantity"), [("o_orderkey", "l_orderkey")], {"payout": "amount", "case_key": "l_orderkey"})
    booked = F.when(col("o_orderpriority") == "1-URGENT", col("credit")).otherwise(F.floor("o_totalprice").cast("double"))
    return rows.select(
        "o_orderkey", report_rules.refund_status(col("credit"), booked).alias("refund_status"),
        report_rules.refund_source([("Case", col("case_key")), ("Request", col("request"))]).alias("source_of_refund"),
        report_rules.captured_amount([col("credit"), col("payout")]).alias("captured"),
    )
