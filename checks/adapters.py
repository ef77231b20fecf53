"""Report input tables derived inside Spark from the driver's star-schema tables.

Tables keep all rows of their source, but for these, whose rows are chosen as part of the tested feature: ``promo_order`` (orders of every
fifth customer, not urgent), ``refund_approved`` and the refund request lines (returned lines), ``case`` (orders not of low priority),
and the small lists ``promo_input`` (one region) and the extra row of the booking rates. In the other tables, keys that must find nothing, for the outer joins, are blanked by a property of the row. JSON columns are built from columns, so report oracles can be written without JSON.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarledger.codes import Codes
from bazaarledger.sources.tables import Tables

CODES = Codes(promo_name_pattern="7")

#: Facts whose rows are grouped into JSON lists or joined are dealt by this key before, as plain columns; the grouping and joining reuse it.
FACTS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}

# Fixed lists, by key
ZONES = ("Asia/Singapore", "Asia/Jakarta", "Asia/Bangkok", "Asia/Manila", "America/New_York")
CURRENCIES = ("SGD", "MYR", "THB", "PHP", "VND")


def pick(values: tuple[str, ...], index: str) -> str:
    """SQL text choosing the index-th value; the same in Spark and in the oracle."""
    cases = " ".join(f"when {i} then '{value}'" for i, value in enumerate(values))
    return f"case {index} {cases} end"


PRICE_MINOR = "cast(round(l_extendedprice * 100) as bigint)"


def line_amounts(lines: DataFrame) -> DataFrame:
    """Amounts of a line in minor units, by integer arithmetic only."""
    return lines.withColumns({
        "price_c": F.expr(PRICE_MINOR),
        "disc_pct": F.expr("cast(round(l_discount * 100) as bigint)"),
        "tax_pct": F.expr("cast(round(l_tax * 100) as bigint)"),
    }).withColumns({
        "disc_c": F.expr("price_c * disc_pct div 100"),
        "tax_c": F.expr("price_c * tax_pct div 100"),
        "com_c": F.expr("price_c div 5"),
        "gk_c": F.expr("price_c div 20"),
    })


SUB_MERCHANT = """named_struct(
    'merchantID', concat('M', l_suppkey),
    'subFoodQuoteInMin', named_struct(
        'priceInMinorUnit', price_c, 'priceExcludeTaxInMinorUnit', price_c - tax_c,
        'mexCommission', com_c, 'gkCommission', if(l_linenumber % 2 = 0, gk_c, null),
        'additionalCommissions', named_struct('stepUpCommission', com_c div 10, 'stepUpGKCommission', gk_c div 10)),
    'merchantInfoObj', named_struct(
        'commission', 0.25D, 'gkCommissionRate', if(l_linenumber % 2 = 0, 0.125D, null), 'taxRate', '0.0625',
        'additionalCommissionRates', named_struct('stepUpCommissionRate', 0.5D)))"""

DOCUMENT = """to_json(named_struct(
    'newTaxFlow', o_orderkey % 2 = 0,
    'deliveryOption', case o_orderkey % 3 when 0 then '0' when 1 then '1' end,
    'currency', named_struct('exponent', (o_orderkey % 2) * 2),
    'cartWithQuote', named_struct(
        'discounts', discounts,
        'promoCodes', if(reward_id is not null,
            array(named_struct('promoCode', concat('PROMO', reward_id), 'promoAmountInMin', price_c div 10)), null),
        'foodQuoteInMin', named_struct(
            'priceInMinorUnit', price_c, 'priceExcludeTaxInMinorUnit', price_c - tax_c, 'inclTaxInMin', tax_c,
            'mexCommission', com_c, 'gkCommission', if(m_key % 4 < 2, gk_c, null),
            'reducedPriceInMinorUnit', price_c - disc_c, 'promoAmountInMinorUnit', price_c div 10,
            'additionalCommissions', named_struct('stepUpCommission', com_c div 10, 'stepUpGKCommission', gk_c div 10)),
        'totalQuoteInMin', named_struct('mexCommission', com_c + 1, 'gkCommission', gk_c),
        'merchantCartWithQuoteList', array(named_struct(
            'merchantInfoObj', named_struct(
                'commission', 0.25D, 'gkCommissionRate', if(m_key % 4 < 2, 0.125D, null),
                'taxRate', if(o_orderkey % 5 = 0, null, '0.0625'),
                'specialMerchantType', case m_key % 4 when 0 then 'KITCHENMIXMATCH' when 1 then 'KITCHENNORMAL' end,
                'merchantClusterID', if(m_key % 4 = 0, concat('C', m_key % 25), null),
                'qsrCode', if(o_orderkey % 7 = 0, 'pos-a', null),
                'additionalCommissionRates', named_struct('stepUpCommissionRate', 0.5D)),
            'subMerchants', case when o_orderstatus = 'P' then null
                when o_orderpriority = '5-LOW' then slice(subs, 1, 0) else subs end)))))"""

STATES = {  # status and priority -> (final_state, booking_state)
    "booking_state": """case when o_orderstatus = 'F' then 'COMPLETED'
        when o_orderstatus = 'P' and o_orderpriority = '3-MEDIUM' then 'UNALLOCATED'
        when o_orderpriority = '4-NOT SPECIFIED' then 'CANCELLED' end""",
    "final_state": """case when o_orderstatus = 'F' then 'COMPLETED'
        when o_orderstatus = 'P' then case o_orderpriority when '1-URGENT' then 'UNALLOCATED'
            when '2-HIGH' then 'REALLOCATION_FAILED' when '4-NOT SPECIFIED' then 'CANCELLED_OPERATOR' else '' end
        when o_orderpriority = '3-MEDIUM' then 'CANCELLED_PASSENGER'
        when o_orderpriority = '5-LOW' then 'UNALLOCATED'
        when o_orderpriority = '4-NOT SPECIFIED' then null else '' end""",
}
CREATED = "timestampadd(SECOND, cast(o_orderkey * 7919 % 86400 as int), o_orderdate)"


def after(seconds: str) -> str:
    return f"timestampadd(SECOND, cast({seconds} as int), created_time)"


def city_of(key: str) -> str:
    return f"cast({key} % 25 as int) + 1"


class Adapters:
    """One method per table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._read: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    def dealt(self, name: str) -> DataFrame:
        """A fact by its key. Where rows are only renamed and computed one by one, a report's own joins deal them: `read` is enough."""
        return self.read(name).repartition(FACTS[name])

    def _order_lines(self) -> DataFrame:
        """Orders with their line totals and lists."""
        lines = line_amounts(self.dealt("lineitem")).groupBy("l_orderkey").agg(
            F.min("l_suppkey").alias("m_key"),
            *[F.sum(name).alias(name) for name in ("price_c", "disc_c", "tax_c", "com_c", "gk_c")],
            F.expr(
                "collect_list(if(l_returnflag = 'R', named_struct('mexFundedAmountInMin', disc_c,"
                " 'mexFundedAmountExcludeTaxInMin', disc_c div 2), null))"
            ).alias("discounts"),
            F.expr(f"collect_list({SUB_MERCHANT})").alias("subs"),
        )
        return self.dealt("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))

    def _countries(self) -> DataFrame:
        return self.read("nation").selectExpr("n_nationkey + 1 as city_key", "n_regionkey + 1 as country_id")

    def order_snapshot(self) -> DataFrame:
        rows = self._order_lines().withColumns({
            "reward_id": F.expr("if(o_custkey % 5 = 0, o_custkey % 50 + 1, null)"),
            "created_time": F.expr(CREATED),
            "city_id": F.expr(city_of("o_custkey")),
        })
        rows = rows.join(self._countries(), F.col("city_id") == F.col("city_key"), "left")
        metadata = f"""case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then null else to_json(named_struct(
            'partnerOrderSubmitTime', date_format({after("90")}, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            'qsrCode', if(o_orderkey % 4 = 2, 'pos-a', 'own'), 'FPTAcceptedBy', if(o_custkey % 2 = 0, '3', '1'),
            'payMerchant', if(o_custkey % 3 = 0, 'yes', null))) end"""
        return rows.selectExpr(
            "concat('O', o_orderkey) as order_id",
            "if(o_orderstatus = 'O' and o_orderpriority < '3', null, concat('B', o_orderkey)) as last_booking_code",
            "concat('S', o_orderkey) as short_order_number", "concat('M', m_key) as merchant_id", "o_custkey as buyer_id",
            "city_id", "country_id", "if(o_orderkey % 10 = 9, 2, 1) as order_type",
            "case o_orderstatus when 'F' then 11 when 'P' then 9 else 5 end as order_state",
            *[f"{text} as {name}" for name, text in STATES.items()],
            "reward_id", "if(o_orderstatus = 'F', null, cast(o_orderkey % 7 as int)) as cancel_code",
            "if(o_orderpriority = '4-NOT SPECIFIED', 'Food is out of stock', null) as cancel_msg",
            "cast(o_orderkey % 4 as double) / 16 as commission", "cast(o_orderkey % 3 as double) / 16 as tax",
            f"{metadata} as metadata", f"{DOCUMENT} as snapshot_detail",
            "date_format(created_time, 'yyyy-MM-dd') as partition_date",
            "created_time", f"{after('60')} as ord_new_time",
            f"if(o_orderstatus = 'O', null, {after('60 + o_orderkey % 4 * 30')}) as pre_accepted_time",
            f"if(o_orderstatus = 'P' and o_orderpriority = '5-LOW', {after('600')}, null) as pre_expired_time",
            f"if(o_orderstatus = 'O' and o_orderpriority = '1-URGENT', {after('700')}, null) as pre_cancelled_time",
            f"if(o_orderkey % 3 = 0, {after('300')}, null) as ord_order_in_prepare_time",
            f"if(o_orderstatus = 'F', {after('3600')}, null) as ord_completed_time",
            f"{after('400')} as del_last_picking_up_time", f"{after('500')} as del_first_driver_at_store_time",
            f"{after('900')} as del_food_collected_time", f"{after('1800')} as del_driver_arrived_time",
            f"if(o_orderstatus = 'F', null, {after('2000')}) as del_cancelled_time",
        )

    def booking_base(self) -> DataFrame:
        rows = self.read("orders").withColumns({
            "created_time": F.expr(CREATED), "city_id": F.expr(city_of("o_custkey")),
        })
        rows = rows.join(self._countries(), F.col("city_id") == F.col("city_key"), "left")
        return rows.selectExpr(
            "if(o_orderpriority = '3-MEDIUM', null, concat('O', o_orderkey)) as order_id", "concat('M', o_orderkey % 100) as merchant_id",
            "if(o_orderpriority = '3-MEDIUM', null, o_custkey) as passenger_id", "country_id", "city_id", "o_custkey * 10 as driver_id",
            "o_orderpriority as pickup_area", "o_orderstatus as dropoff_area",
            "cast(floor(o_totalprice / 1000) as double) as driver_fare", "floor(o_totalprice / 500) / 4D as customer_fare",
            "concat('MART', o_orderkey % 20) as promo_code", "cast(floor(o_totalprice / 10000) as double) as promo_expense",
            "cast(floor(o_totalprice) as double) as food_sub_total", "cast(floor(o_totalprice) as double) as basket_size",
            "case o_orderkey % 3 when 0 then 1D when 1 then 2D else 4D end as fx_one_usd",
            "if(o_orderkey % 8 = 7, 'Mart', 'Food') as vertical",
            "if(o_orderstatus = 'F', 'COMPLETED', 'CANCELLED') as booking_state_simple",
            "date_format(o_orderdate, 'yyyy-MM-dd') as date_local", f"{after('3600')} as ended_at_local",
        )

    def cashier_payment(self) -> DataFrame:
        """Ledger lines; all are posted in the first week, so the whole table falls in the reports' windows."""
        return line_amounts(self.read("lineitem")).selectExpr(
            "l_suppkey as user_id", "if(l_returnflag = 'N', 1, 2) as user_type", "concat('B', l_orderkey) as booking_code",
            "concat('O', l_orderkey) as order_id", "timestampadd(SECOND, cast(l_orderkey % 86400 as int), l_shipdate) as created_at",
            "concat('M', l_suppkey) as payee_id", "cast(l_partkey % 5 as int) as order_mode",
            "case l_linenumber when 3 then 14 when 4 then 1001 when 5 then 1099 when 6 then 1100 when 7 then 3"
            " else l_linenumber end as tx_type",
            "price_c as tx_amount", f"{pick(CURRENCIES[:3], 'l_partkey % 3')} as currency",
            "to_json(named_struct('daxDeliveryFee', price_c div 10, 'promotion', disc_c, 'netEarning', price_c - com_c,"
            " 'orderValue', price_c - tax_c, 'taxes', if(l_partkey % 2 = 0, tax_c, null), 'exDeliveryFee', price_c div 50,"
            " 'mexFundCampaign', disc_c, 'mexFundPromo', if(l_partkey % 3 = 0, 100, null), 'GKCommission', gk_c,"
            " 'mexCommission', com_c, 'mexStepUpGKCommission', gk_c div 10, 'mexStepUpCommission', com_c div 10,"
            " 'deliveryCharge', price_c div 100)) as metadata",
            "'1995' as year", "'1' as month", "cast(l_linenumber as string) as day",
        )

    def order_booking(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "concat('B', o_orderkey) as booking_code", "concat('Type ', o_orderpriority) as taxi_type_name",
            "o_custkey % 30 as driver_fleet_id", "concat('M', o_orderkey % 100) as restaurant_id",
            "date_format(o_orderdate, 'yyyy-MM-dd') as partition_date",
        )

    def driver_ledger(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "if(o_orderpriority = '5-LOW', null, concat('B', o_orderkey)) as method", "o_totalprice as amount", *ymd("o_orderdate")
        )

    def fleet(self) -> DataFrame:
        return self.read("nation").selectExpr("cast(n_nationkey as bigint) as id", "concat('Fleet ', n_name) as name")

    def driver(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "s_suppkey as id", "s_name as name",
            "if(s_suppkey % 2 = 0, concat('M', s_suppkey), null) as identification_card_number",
        )

    def merchant(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "concat('M', s_suppkey) as merchant_id", "s_name as name", "concat('Chain ', s_nationkey) as chain_name",
            "concat('CH', s_nationkey) as chain_number",
        )

    def merchant_dim(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "concat('M', s_suppkey) as merchant_id", "s_name as merchant_name", "concat('Brand ', s_nationkey) as business_name",
            "if(s_suppkey % 5 = 0, 'Mart', 'Food') as vertical", "concat('Type ', s_nationkey % 3) as business_type_name",
            "if(s_acctbal < 5000, null, concat('Manager ', s_nationkey)) as am_name",
            "concat('CH', s_nationkey) as chain_number", "s_nationkey % 5 + 1 as country_id",
        )

    def merchant_contract(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "concat('M', s_suppkey) as merchant_id", "concat('W', s_suppkey) as wallet_account_id",
            "concat('m', s_suppkey, '@x.test') as invoice_email",
        )

    def merchant_cluster(self) -> DataFrame:
        return self.read("nation").selectExpr(
            "concat('C', n_nationkey) as merchant_cluster_id", "concat('Cluster ', n_name) as name"
        )

    def store(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "concat('W', s_suppkey) as wallet_account_id", "if(s_acctbal > 1000, 1000000 + s_suppkey, null) as wallet_merchant_id",
            "concat('Store ', s_name) as trading_name",
        )

    def bank_account(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "if(s_acctbal > 2000, concat('W', s_suppkey), null) as store_wallet_account_id", "lpad(cast(s_suppkey as string), 8, '0') as account_number",
            "concat('SW', s_nationkey) as swift_code", "concat('ST', s_suppkey) as bank_statement_code",
            "s_nationkey as bank_name_id",
        )

    def bank(self) -> DataFrame:
        return self.read("nation").selectExpr("n_nationkey as id", "concat('Bank ', n_name) as bank_name")

    def legacy_bank_account(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "s_suppkey as user_id", "lpad(cast(s_suppkey as string), 6, '0') as acc_number", "s_nationkey as bank_id"
        )

    def legacy_bank(self) -> DataFrame:
        return self.read("nation").selectExpr("if(n_regionkey < 3, n_nationkey, null) as id", "concat('LB', n_nationkey) as code")

    def seller(self) -> DataFrame:
        return self.read("supplier").selectExpr("concat('M', s_suppkey) as id", "concat('Seller ', s_suppkey) as name")

    def customer_dim(self) -> DataFrame:
        return self.read("customer").selectExpr("if(c_acctbal > 0, c_custkey, null) as id", "c_name as name")

    def city(self) -> DataFrame:
        return self.read("nation").selectExpr(
            "n_nationkey + 1 as id", "n_name as name", "n_regionkey + 1 as country_id",
            "concat('R', n_regionkey) as country_code", f"{pick(ZONES, 'n_nationkey % 5')} as time_zone",
        )

    def country(self) -> DataFrame:
        return self.read("region").selectExpr(
            "r_regionkey + 1 as id", "r_name as name", "concat('R', r_regionkey) as code",
            f"{pick(CURRENCIES, 'r_regionkey')} as currency_symbol", f"{pick(CURRENCIES, 'r_regionkey')} as iso_currency",
            f"{pick(ZONES, 'r_regionkey')} as country_timezone",
        )

    def service_type(self) -> DataFrame:
        """Two adjoining validity ranges per type."""
        return self.read("nation").selectExpr(
            "n_nationkey as id", "if(n_nationkey % 3 = 2, 'Ride', 'Food') as name", "explode(sequence(0, 1)) as version",
        ).selectExpr(
            "id", "name",
            "timestampadd(DAY, cast(id % 7 + version * 12 as int), timestamp'2024-01-01') as start_at",
            "timestampadd(DAY, cast(id % 7 + version * 12 + 12 as int), timestamp'2024-01-01') as end_at",
        )

    def rating_feedback(self) -> DataFrame:
        return self.read("events").selectExpr(
            "concat('E', event_id) as order_id", "concat('M', user_id % 100) as merchant_id",
            "cast(user_id % 25 as int) as taxi_type_id", "cast(user_id % 25 as int) + 1 as city_id",
            "date_format(ts, 'yyyy-MM-dd') as date_local",
            "if(event_type in ('purchase', 'click', 'error'), 'COMPLETED', 'CANCELLED') as booking_state_simple",
            "if(event_type = 'view', null, cast(floor(value) % 5 + 1 as int)) as pax_rating_for_merchant",
            "case event_type when 'signup' then 'Taste; Portion;' when 'click' then ' Late ;Cold'"
            " when 'purchase' then 'Taste' when 'view' then 'Other' end as pax_rating_category",
            "props as pax_feedback_for_merchant",
        )

    def fx_rate(self) -> DataFrame:
        """Yearly rates; the first country also has an overlapping range."""
        years = self.read("region").selectExpr("r_regionkey + 1 as country_id", "explode(sequence(1995, 2001)) as year")
        yearly = years.selectExpr(
            "country_id", "concat(year, '-01-01') as start_date", "concat(year, '-12-31') as end_date",
            "country_id + year % 4 * 0.25D as exchange_one_usd",
        )
        extra = self.read("region").where("r_regionkey = 0").selectExpr(
            "r_regionkey + 1 as country_id", "'1997-06-01' as start_date", "'1997-06-30' as end_date", "8D as exchange_one_usd"
        )
        return yearly.unionByName(extra)

    def pnl_base(self) -> DataFrame:
        nations = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = self.read("orders").withColumn("v", F.expr("cast(floor(o_totalprice) as double)"))
        rows = rows.join(nations, F.col("o_custkey") % 25 == F.col("n_nationkey"))
        eighths = {
            "delivery_fare": 1, "driver_delivery_fare": 2, "merchant_commission": 3, "driver_commission": 4,
            "small_order_fee_usd": 5, "platform_fee_usd": 6, "shopper_fee_usd": 7, "incentives_usd": 8,
            "subsidy_usd": 9, "total_partner_base_for_merchant_commission": 10, "total_promo_spend_usd": 11,
            "total_platform_promo_spend_usd": 12, "total_discount_usd": 13,
            "total_campaign_merchant_promo_spend_usd": 14, "code_merchant_promo_spend_usd": 15,
            "support_expense_usd": 16, "ad_spend_usd": 17, "sheet_platform_promo_spend_usd": 18,
        }
        return rows.selectExpr(
            "concat('M', o_orderkey % 100) as merchant_id", "r_name as country_name", "n_name as city_name",
            "if(o_orderkey % 2 = 0, 'Active', 'New') as partner_status", "o_orderkey % 3 = 0 as is_bd_account",
            "o_orderkey % 5 = 0 as is_bd_partner", "o_orderpriority as business_model",
            "date_format(o_orderdate, 'yyyy-MM-dd') as date_local", "cast(o_orderdate as date) as partition_date_local",
            "v as gmv_usd", "v / 2 as basket_size", "v / 4 as sub_total",
            "if(o_orderstatus = 'P', null, v / 64) as sheet_merchant_promo_spend_usd",
            "if(o_orderkey % 4 = 0, null, v / 128) as convenience_fee_usd",
            "if(o_orderkey % 4 = 1, null, v / 256) as spot_incentive_bonus_usd",
            *[f"floor(v / {n + 7}) / 8D as {name}" for name, n in eighths.items()],
            "1L as all_incoming_orders", "if(o_orderstatus = 'F', 1L, 0L) as completed_orders",
            "if(o_orderstatus = 'O', 1L, 0L) as cancellations", "if(o_orderkey % 6 = 0, 1L, 0L) as batched_orders",
        )

    def promo_order(self) -> DataFrame:
        nations = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.read("orders").join(nations, F.col("o_custkey") % 25 == F.col("n_nationkey")).selectExpr(
            "if(o_custkey % 5 = 0 and o_orderpriority <> '1-URGENT', concat('O', o_orderkey), null) as order_id", "n_regionkey + 1 as country_id", "r_name as country_name",
            "n_nationkey + 1 as city_id", "n_name as city_name", "date_format(o_orderdate, 'yyyy-MM-dd') as date_local",
            "o_custkey % 50 + 1 as reward_id", "concat('Flag ', o_orderstatus) as product_flag",
            "cast(floor(o_totalprice / 100) as double) as merchant_promo_spend",
        )

    def promo_input(self, region: int) -> DataFrame:
        """One region's promo list; the first reward of each region is listed under two codes."""
        nations = self.read("nation").where(F.col("n_regionkey") == region).join(
            self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return nations.selectExpr(
            "r_name as country", "explode(if(n_nationkey < 5, array('A', 'B'), array('A'))) as variant", "n_nationkey",
        ).selectExpr(
            "country", "concat('PC', n_nationkey, variant) as promo_code", "concat(' ', n_nationkey + 1, ' ') as reward_id",
            "'1995-01-01' as start_date", "if(n_nationkey % 4 = 3, '1994-12-31', '2001-12-31') as end_date",
        )

    def cancel_reason(self) -> DataFrame:
        return self.read("nation").selectExpr(
            "if(n_nationkey < 6, n_nationkey, null) as cancel_code", "concat('REASON_', n_nationkey) as cancel_reason_enum"
        )

    def app_log(self) -> DataFrame:
        return self.read("lineitem").selectExpr(
            "if(l_quantity > 5, 'order-log', 'other-log') as log",
            "map('operation.name', if(l_linenumber <= 5, 'order.auto.accept', 'other'),"
            " 'merchantID', concat('M', l_suppkey), 'orderID', concat('O', l_orderkey)) as properties",
            *ymd("l_shipdate"),
        )

    def wallet_tx(self) -> DataFrame:
        return self.read("lineitem").withColumn(
            "at", F.expr("timestampadd(SECOND, cast(l_partkey % 86400 as int), l_shipdate)")
        ).selectExpr(
            "l_orderkey * 10 + l_linenumber as id", "concat('T', l_orderkey, '-', l_linenumber) as txid",
            "concat(if(l_linenumber % 2 = 0, 'O', 'B'), l_orderkey) as orderid", "concat('CO', l_suppkey % 10) as cashoutid",
            "concat('ST', l_suppkey) as settlementid", "cast(1000000 + l_suppkey as string) as merchantid",
            "case l_partkey % 10 when 0 then 'Lending' when 1 then 'other' else 'Orders' end as partnerid",
            "concat('P', l_partkey) as partnertxid", "cast(floor(l_extendedprice) as double) as amount",
            "cast(floor(l_extendedprice * l_discount) as double) as refundamount",
            f"{pick(CURRENCIES, 'l_suppkey % 5')} as currency", "concat('DONE', l_linestatus) as status",
            "case l_linenumber when 3 then 59 when 4 then 56 else 60 end as txtype",
            "if(l_returnflag = 'R', 'x ADJUSTMENT y', 'plain') as postscript", "at as created",
            "timestampadd(DAY, 1, at) as updated", "timestampadd(HOUR, 1, at) as transactioncreatedat",
            "timestampadd(HOUR, 2, at) as transactionupdatedat", *ymd("l_shipdate"),
        )

    def settlement(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "s_suppkey", "s_acctbal", "explode(if(s_acctbal > 500, array('SETTLE_INITIATED', 'SETTLED'), array('SETTLE_INITIATED')))"
            " as status",
        ).selectExpr(
            "s_suppkey as id", "concat('ST', s_suppkey) as settlementid", "cast(1000000 + s_suppkey as string) as merchantid",
            "if(s_suppkey % 10 = 3, '', concat('EXT', s_suppkey)) as manualcashoutrefid",
            "cast(floor(s_acctbal) as double) as amount", f"{pick(CURRENCIES, 's_suppkey % 5')} as currency", "status",
            "if(s_suppkey % 4 = 0, 'MultiBusinessLine', 'Orders') as partnerid",
            "timestampadd(HOUR, cast(s_suppkey as int), timestamp'1998-01-01') as created",
            "timestampadd(HOUR, cast(s_suppkey as int) + 5, timestamp'1998-01-01') as updated",
        )

    def cashout_event(self) -> DataFrame:
        """Two events per reference that add up to the settlement, or only one of them."""
        return self.read("supplier").selectExpr(
            "s_suppkey", "s_acctbal", "explode(if(s_suppkey % 3 = 0, array(1), array(1, 2))) as part"
        ).selectExpr(
            "if(s_suppkey % 10 = 3, '', concat('EXT', s_suppkey)) as user_cashout_ref_id",
            "cast(if(part = 1, floor(s_acctbal / 2), floor(s_acctbal) - floor(s_acctbal / 2)) as double) as amount",
            "'CASHOUT_SUCCESS' as cashout_status", "if(s_suppkey % 4 = 0, 'MultiBusinessLine', 'orders') as partner_id",
            f"{pick(CURRENCIES, 's_suppkey % 5')} as currency",
            "timestampadd(HOUR, cast(s_suppkey as int), timestamp'1998-01-02') as created",
            "timestampadd(HOUR, cast(s_suppkey as int), timestamp'1998-01-03') as updated",
        )

    def refund_approved(self) -> DataFrame:
        return self.read("lineitem").selectExpr(
            "if(l_returnflag = 'R', concat('B', l_orderkey), null) as booking_code", "cast(floor(l_extendedprice) as double) as credit",
            "l_quantity as balance", "timestampadd(SECOND, cast(l_partkey % 86400 as int), l_shipdate) as tx_time",
            "cast(l_linenumber % 5 as int) as tx_action", f"{pick(CURRENCIES, 'l_suppkey % 6')} as currency", *ymd("l_shipdate"),
        )

    def payment_booking(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "concat('B', o_orderkey) as booking_code", "o_custkey as passenger_id",
            "if(o_orderkey % 6 = 0, 5L, -999L) as driver_id", "cast(floor(o_totalprice) as double) as initial_amount",
            *ymd("o_orderdate"),
        )

    def ticket(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "if(o_orderstatus = 'F', o_orderkey, null) as id", "if(o_orderstatus = 'F', concat('B', o_orderkey), null) as booking_code", "concat('r', o_custkey % 5) as country",
            "if(o_orderkey % 3 = 0, 'ride', 'food') as service", "o_orderpriority as disposition",
            "date_format(o_orderdate, 'yyyyMMdd') as partition_date",
        )

    def case(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "if(o_orderpriority <> '5-LOW', o_orderkey, null) as id", "concat('B', o_orderkey) as booking_code", "o_custkey as passenger_id",
            "concat('R', o_custkey % 5) as region", "if(o_orderstatus = 'O', 'Other', 'FoodMissingWrongItem') as category",
            "cast(o_orderkey as string) as zendesk_ticket_id", f"timestampadd(DAY, cast(o_orderkey % 60 as int), {CREATED}) as created_at",
        )

    def case_state(self) -> DataFrame:
        """A ticket state for every order with lines, a policy state where it has more than one."""
        entity = (
            "named_struct('name', concat('Part ', l_partkey), 'ID', cast(l_partkey as string),"
            " 'quantity', cast(l_quantity as int), 'menuType', l_returnflag, 'singleReducedPrice', price_c / 100D)"
        )
        orders = line_amounts(self.dealt("lineitem")).groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("n"), F.expr(f"collect_list({entity})").alias("entities"),
            F.expr("min(l_returnflag)").alias("flag"), F.min("l_shipdate").alias("at"),
        )
        states = (
            "explode(array(named_struct('state', 'GET_ZENDESK_TICKET_DETAILS', 'inner',"
            " to_json(named_struct('Issue', concat('issue ', flag)))),"
            " named_struct('state', if(n > 1, 'CHECK_FOOD_POLICY_ENGINE', 'SOMETHING_ELSE'), 'inner',"
            " to_json(named_struct('RefundEntities', entities))))) as s"
        )
        return orders.selectExpr("l_orderkey as case_id", "at as created_at", states).selectExpr(
            "case_id", "s.state as state", "to_json(named_struct('stateData', s.inner)) as state_data", "created_at"
        )

    def case_payment(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_orderkey as case_id", "if(o_orderkey % 2 = 0, 'PAX_WALLET', 'OTHER') as payout_target_type",
            "cast(floor(o_totalprice / 100) as double) as payout_amount",
        )

    def refund_request(self) -> DataFrame:
        """One request per order, of another service where nothing was returned; items and sub-items are double-encoded JSON."""
        sub_item = (
            "named_struct('itemName', concat('Extra ', {n}), 'itemID', concat(l_partkey, '-', {n}),"
            " 'itemPriceInMinorUnits', price_c div {n}, 'itemQuantity', {n},"
            " 'totalItemPriceInMinorUnits', price_c, 'totalRefundPriceInMinorUnits', disc_c)"
        )
        two = f"array({sub_item.format(n=2)}, {sub_item.format(n=3)})"
        item = (
            "to_json(named_struct('ItemName', concat('Part ', l_partkey), 'ItemID', cast(l_partkey as string),"
            " 'ItemPriceInMinorUnits', price_c, 'ItemQuantity', cast(l_quantity as int),"
            " 'TotalItemPriceInMinorUnits', price_c * cast(l_quantity as int), 'TotalRefundPriceInMinorUnits', disc_c,"
            f" 'RefundSubItems', case l_linenumber % 3 when 1 then slice({two}, 1, 0) when 2 then {two} end))"
        )
        lines = line_amounts(self.dealt("lineitem")).groupBy("l_orderkey").agg(
            F.expr("min(if(l_returnflag = 'R', l_suppkey, null))").alias("m_key"),
            F.expr("sum(if(l_returnflag = 'R', price_c, null))").alias("total_c"),
            F.expr(f"collect_list(if(l_returnflag = 'R', {item}, null))").alias("items"),
        )
        rows = self.dealt("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        rows = rows.withColumn("created_time", F.expr(f"timestampadd(DAY, cast(o_orderkey % 40 as int), {CREATED})"))
        return rows.selectExpr(
            "concat('R', o_orderkey) as refund_id", "o_custkey as customer_id", "concat('M', m_key) as vendor_id",
            "concat('O', o_orderkey) as source_id", "if(o_orderpriority = '5-LOW' or m_key is null, 'MART', 'FOOD') as source_category",
            "concat('reason ', o_orderstatus) as reason_code", "o_orderpriority as reason_category_code",
            "date_format(created_time, \"yyyy-MM-dd'T'HH:mm:ss\") as created_at", "total_c as total_refund_amount",
            "total_c div 2 as paid_amount", "total_c div 10 as promo_amount", "total_c div 4 as total_clawback_amount",
            f"{pick(CURRENCIES, 'o_custkey % 5')} as currency", "cast(o_custkey % 2 * 2 as int) as currency_exponent",
            "concat('zendesk:', o_orderkey) as ticket_id", "to_json(items) as refund_items", *ymd("o_orderdate"),
        )


def ymd(column: str) -> list[str]:
    """Partition columns; month and day are not padded."""
    return [f"cast({part}({column}) as string) as {part}" for part in ("year", "month", "day")]


REGIONS = tuple(f"promo_input_{region}" for region in range(5))


def marketplace(spark: SparkSession, sf_dir: str) -> Tables:
    """All report inputs over the tables in `sf_dir`."""
    adapters = Adapters(spark, sf_dir)

    def resolve(name: str) -> DataFrame:
        if name in REGIONS:
            return adapters.promo_input(REGIONS.index(name))
        build: Callable[[], DataFrame] = getattr(adapters, name)
        return build()

    return Tables(resolve)
