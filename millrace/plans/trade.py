"""E-commerce metric queries over orders, lineitem, part, customer and nation.

Dates in the test tables are spread over years; a query that speaks of "today"
takes its business date from the data (the newest order date), never from the
clock. Amounts are added as decimals and cast to double at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.operators.aggregates import dealt, interval_rows, on_day, with_dimension, within_days
from millrace.operators.ranking import top_ranked
from millrace.sources.tables import load, money

AMOUNT = "l_extendedprice"


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """Rows of lineitem; Parquet's footers know them."""
    return load(spark, sf_dir, "lineitem").count()


def with_orders(lines: DataFrame, orders: DataFrame, rows: int) -> DataFrame:
    """lines with their orders, dealt by order into tasks that don't grow with the rows."""
    return dealt(lines, rows, "l_orderkey").join(dealt(orders, rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order detail: one row per line with its order's customer and day."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", money(AMOUNT).alias("original"), (money(AMOUNT) * F.col("l_discount").cast("decimal(4,2)")).alias("cut")
    )
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("dt"))
    return with_orders(lines, orders, line_count(spark, sf_dir))


def part_sales(spark: SparkSession, sf_dir: str, sums: dict[str, Column]) -> DataFrame:
    """(l_partkey, orders, buyers, sums): different orders and customers of each part, and sums over its lines.

    Two distinct counts at once would copy every line for each of them. Here an
    order is counted by its first line of the part, where lines lie by order
    anyway, and customers as rows of part and customer.
    """
    own = Window.partitionBy("l_orderkey", "l_partkey").orderBy("o_custkey")
    lines = order_lines(spark, sf_dir).withColumn("_first", (F.row_number().over(own) == 1).cast("int"))
    lines = lines.select("l_partkey", "o_custkey", "_first", *[c.alias(name) for name, c in sums.items()])
    each = dealt(lines, line_count(spark, sf_dir), "l_partkey", "o_custkey").groupBy("l_partkey", "o_custkey").agg(F.sum("_first").alias("_orders"), *[F.sum(name).alias(name) for name in sums])
    return each.groupBy("l_partkey").agg(F.sum("_orders").alias("orders"), F.count("o_custkey").alias("buyers"), *[F.sum(name).alias(name) for name in sums])


def business_date(spark: SparkSession, sf_dir: str) -> Column:
    """The newest order date, as a literal: one value comes to the driver."""
    return F.lit(load(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate"))).first()[0])


def _total(column: str, name: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("double").alias(name)


_DETAIL = """
detail as (
  select l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag, cast(l_extendedprice as decimal(18,2)) as original,
    cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as cut, o_custkey, cast(o_orderdate as date) as dt
  from lineitem join orders on l_orderkey = o_orderkey),
today as (select max(cast(o_orderdate as date)) as d from orders)
"""


def province_order_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per province (nation) and day, aggregated before the dimension join."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("dt"), money("o_totalprice").alias("amount"))
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("c_nationkey", "dt").agg(F.count(F.lit(1)).alias("order_count"), F.sum("amount").cast("double").alias("order_amount"))
    return per.join(nation, per.c_nationkey == nation.n_nationkey, "left").select("n_name", "dt", "order_count", "order_amount")


def user_sku_order_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, sku and day: orders, quantity, original and reduced amounts, with the sku's brand and type."""
    rows = line_count(spark, sf_dir)
    per = (
        dealt(order_lines(spark, sf_dir), rows, "o_custkey", "l_partkey", "dt")
        .groupBy("o_custkey", "l_partkey", "dt")
        .agg(F.count_distinct("l_orderkey").alias("order_count"), F.sum("l_quantity").alias("order_num"), _total("original", "original_amount"), _total("cut", "reduce_amount"), (F.sum("original") - F.sum("cut")).cast("double").alias("total_amount"))
    )
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return with_dimension(per, rows, part, "l_partkey", "p_partkey")


def user_order_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).groupBy("o_custkey", "dt").agg(F.count_distinct("l_orderkey").alias("order_count"), F.sum("l_quantity").alias("order_num"), _total("original", "original_amount"))


def user_order_td(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last order day, days and totals to date."""
    return order_lines(spark, sf_dir).groupBy("o_custkey").agg(F.min("dt").alias("order_date_first"), F.max("dt").alias("order_date_last"), F.count_distinct("l_orderkey").alias("order_count_td"), _total("original", "original_amount_td"))


def user_payment_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of status F stand for payments."""
    orders = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("dt")).agg(F.count(F.lit(1)).alias("payment_count"), F.sum(money("o_totalprice")).cast("double").alias("payment_amount"))


def user_sku_order_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7- and 30-day sums per user and sku by conditional aggregation; both have a lower bound."""
    today = business_date(spark, sf_dir)
    lines = order_lines(spark, sf_dir).where(within_days("dt", today, 30))
    week = within_days("dt", today, 7)
    return lines.groupBy("o_custkey", "l_partkey").agg(
        F.count_if(week).alias("line_count_7d"),
        F.coalesce(F.sum(F.when(week, F.col("original"))), F.lit(0)).cast("double").alias("amount_7d"),
        F.count(F.lit(1)).alias("line_count_30d"),
        _total("original", "amount_30d"),
    )


def province_order_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Province orders for the last 1, 7 and 30 days; days are summed before they are dealt to intervals."""
    today = business_date(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("dt"), money("o_totalprice").alias("amount")).where(within_days("dt", today, 30))
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per_day = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("c_nationkey", "dt").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return interval_rows(per_day, "dt", today, (1, 7, 30)).groupBy("c_nationkey", "recent_days").agg(F.sum("n").alias("order_count"), _total("amount", "order_amount"))


def _stats_1_7_30(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Distinct orders and users by interval; lines are reduced to distinct (key, order, user, day) before they are dealt to intervals."""
    today = business_date(spark, sf_dir)
    lines = order_lines(spark, sf_dir).where(within_days("dt", today, 30))
    part = load(spark, sf_dir, "part").select("p_partkey", key)
    once = lines.join(part, lines.l_partkey == part.p_partkey).select(key, "l_orderkey", "o_custkey", "dt").distinct()
    tagged = interval_rows(once, "dt", today, (1, 7, 30))
    # An order has one user and one day, so distinct orders are rows by now.
    per_user = tagged.groupBy("recent_days", key, "o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return per_user.groupBy("recent_days", key).agg(F.sum("orders").alias("order_count"), F.count(F.lit(1)).alias("order_user_count"))


def brand_stats_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_1_7_30(spark, sf_dir, "p_brand")


def category_stats_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_1_7_30(spark, sf_dir, "p_type")


def order_three_consecutive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who were active on three days running, by lead(day, 2) without a default."""
    days = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("dt")).distinct()
    own = Window.partitionBy("user_id").orderBy("dt")
    hit = days.withColumn("later", F.lead("dt", 2).over(own)).where(F.datediff("later", "dt") == 2)
    return hit.groupBy("user_id").agg(F.min("dt").alias("first_day"), F.count(F.lit(1)).alias("streaks"))


def brand_repeat_purchase_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a brand's buyers of the last 365 days with two orders or more."""
    today = business_date(spark, sf_dir)
    lines = order_lines(spark, sf_dir).where(within_days("dt", today, 365))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    per_user = lines.join(part, lines.l_partkey == part.p_partkey).groupBy("p_brand", "o_custkey").agg(F.count_distinct("l_orderkey").alias("orders"))
    return per_user.groupBy("p_brand").agg(F.count(F.lit(1)).alias("buyers"), F.count_if(F.col("orders") >= 2).alias("repeat_buyers"), F.round(F.try_divide(F.count_if(F.col("orders") >= 2), F.count(F.lit(1))), 6).alias("repeat_rate"))


def _top3_sku(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    part = load(spark, sf_dir, "part").select("p_partkey", key)
    return top_ranked(lines.join(part, lines.l_partkey == part.p_partkey).select(key, "l_partkey", "quantity"), [key], [F.desc("quantity")], 3)


def category_top3_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top3_sku(spark, sf_dir, "p_type")


def brand_top3_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top3_sku(spark, sf_dir, "p_brand")


def order_to_ship_interval_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean whole seconds between order and shipment."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    gap = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).agg(F.floor(F.avg(gap)).cast("long").alias("avg_seconds"), F.count(F.lit(1)).alias("lines"))


def action_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per funnel step and day from one conditional aggregate."""
    events = load(spark, sf_dir, "events")
    step = lambda kind: F.count_distinct(F.when(F.col("event_type") == kind, F.col("user_id")))
    return events.groupBy(F.to_date("ts").alias("dt")).agg(*[step(k).alias(f"{k}_users") for k in ("view", "click", "signup", "purchase")])


def new_old_users_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and returning users per day: a user is new on the first day seen."""
    days = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("dt")).distinct()
    return new_and_returning(days, "user_id", "dt").withColumnRenamed("login_date", "dt")


def new_and_returning(days: DataFrame, user: str, day: str) -> DataFrame:
    """(login_date, new_user, old_user) from distinct (user, day) rows."""
    first = F.min(day).over(Window.partitionBy(user))
    return days.withColumn("first_day", first).groupBy(F.col(day).alias("login_date")).agg(F.count_if(F.col(day) == F.col("first_day")).alias("new_user"), F.count_if(F.col(day) > F.col("first_day")).alias("old_user"))


def user_login_td(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History before the newest day merged with that day's users by a full outer join with a coalesced key."""
    days = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("dt")).distinct()
    newest = F.lit(load(spark, sf_dir, "events").agg(F.to_date(F.max("ts"))).first()[0])
    old = days.where(F.col("dt") < newest).groupBy("user_id").agg(F.max("dt").alias("old_last"), F.count(F.lit(1)).alias("old_days"))
    new = days.where(F.col("dt") == newest).select("user_id", F.col("dt").alias("new_last"), F.lit(1).alias("new_days"))
    return old.join(new, "user_id", "full_outer").select("user_id", F.coalesce("new_last", "old_last").alias("login_date_last"), (F.coalesce("old_days", F.lit(0)) + F.coalesce("new_days", F.lit(0))).alias("login_count_td"))


def sku_refund_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines per sku and ship day."""
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return lines.groupBy("l_partkey", F.to_date("l_shipdate").alias("dt")).agg(F.count(F.lit(1)).alias("refund_count"), F.sum(money(AMOUNT)).cast("double").alias("refund_amount"))


def trade_stats_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-row metrics of the business date joined on a constant key."""
    today = business_date(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").where(on_day(F.to_date("o_orderdate"), today))
    made = orders.agg(F.count(F.lit(1)).alias("order_count"), F.count_distinct("o_custkey").alias("order_users"))
    paid = orders.where("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("paid_count"), F.coalesce(F.sum(money("o_totalprice")), F.lit(0)).cast("double").alias("paid_amount"))
    return made.crossJoin(paid)


QUERIES = {
    f.__name__: f
    for f in (
        province_order_1d,
        user_sku_order_1d,
        user_order_1d,
        user_order_td,
        user_payment_1d,
        user_sku_order_nd,
        province_order_nd,
        brand_stats_1_7_30,
        category_stats_1_7_30,
        order_three_consecutive_days,
        brand_repeat_purchase_rate,
        category_top3_sku,
        brand_top3_sku,
        order_to_ship_interval_avg,
        action_funnel,
        new_old_users_by_day,
        user_login_td,
        sku_refund_1d,
        trade_stats_today,
    )
}


def _stats_sql(key: str) -> str:
    return f"""with {_DETAIL}
select recent_days::int as recent_days, {key}, count(distinct l_orderkey) as order_count, count(distinct o_custkey) as order_user_count
from detail join part on l_partkey = p_partkey, today, (values (1), (7), (30)) as t(recent_days)
where dt > d - recent_days::int and dt <= d group by all"""


def _top_sql(key: str) -> str:
    return f"""select {key}, l_partkey, quantity, rk::int as rk from (
  select {key}, l_partkey, quantity, rank() over (partition by {key} order by quantity desc) as rk
  from (select l_partkey, sum(l_quantity) as quantity from lineitem group by 1) join part on l_partkey = p_partkey) where rk <= 3"""


ORACLE = {
    "province_order_1d": """
select n_name, cast(o_orderdate as date) as dt, count(*) as order_count, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as order_amount
from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by all""",
    "user_sku_order_1d": f"""with {_DETAIL}
select o_custkey, l_partkey, dt, count(distinct l_orderkey) as order_count, sum(l_quantity) as order_num, cast(sum(original) as double) as original_amount,
  cast(sum(cut) as double) as reduce_amount, cast(sum(original) - sum(cut) as double) as total_amount, p_brand, p_type
from detail left join part on l_partkey = p_partkey group by o_custkey, l_partkey, dt, p_brand, p_type""",
    "user_order_1d": f"with {_DETAIL} select o_custkey, dt, count(distinct l_orderkey) as order_count, sum(l_quantity) as order_num, cast(sum(original) as double) as original_amount from detail group by o_custkey, dt",
    "user_order_td": f"with {_DETAIL} select o_custkey, min(dt) as order_date_first, max(dt) as order_date_last, count(distinct l_orderkey) as order_count_td, cast(sum(original) as double) as original_amount_td from detail group by o_custkey",
    "user_payment_1d": "select o_custkey, cast(o_orderdate as date) as dt, count(*) as payment_count, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as payment_amount from orders where o_orderstatus = 'F' group by 1, 2",
    "user_sku_order_nd": f"""with {_DETAIL}
select o_custkey, l_partkey, count(*) filter (dt > d - 7) as line_count_7d, cast(coalesce(sum(original) filter (dt > d - 7), 0) as double) as amount_7d,
  count(*) as line_count_30d, cast(sum(original) as double) as amount_30d
from detail, today where dt > d - 30 and dt <= d group by 1, 2""",
    "province_order_nd": """with today as (select max(cast(o_orderdate as date)) as d from orders)
select c_nationkey, recent_days::int as recent_days, count(*) as order_count, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as order_amount
from orders join customer on o_custkey = c_custkey, today, (values (1), (7), (30)) as t(recent_days)
where cast(o_orderdate as date) > d - recent_days::int and cast(o_orderdate as date) <= d group by 1, 2""",
    "brand_stats_1_7_30": _stats_sql("p_brand"),
    "category_stats_1_7_30": _stats_sql("p_type"),
    "order_three_consecutive_days": """with d as (select distinct user_id, cast(ts as date) as dt from events),
l as (select *, lead(dt, 2) over (partition by user_id order by dt) as later from d)
select user_id, min(dt) as first_day, count(*) as streaks from l where later - dt = 2 group by user_id""",
    "brand_repeat_purchase_rate": f"""with {_DETAIL},
u as (select p_brand, o_custkey, count(distinct l_orderkey) as orders from detail join part on l_partkey = p_partkey, today where dt > d - 365 and dt <= d group by 1, 2)
select p_brand, count(*) as buyers, count(*) filter (orders >= 2) as repeat_buyers, round(count(*) filter (orders >= 2) / count(*), 6) as repeat_rate from u group by 1""",
    "category_top3_sku": _top_sql("p_type"),
    "brand_top3_sku": _top_sql("p_brand"),
    "order_to_ship_interval_avg": "select floor(avg(epoch(l_shipdate)::bigint - epoch(o_orderdate)::bigint))::bigint as avg_seconds, count(*) as lines from lineitem join orders on l_orderkey = o_orderkey",
    "action_funnel": "select cast(ts as date) as dt, " + ", ".join(f"count(distinct user_id) filter (event_type = '{k}') as {k}_users" for k in ("view", "click", "signup", "purchase")) + " from events group by 1",
    "new_old_users_by_day": """with d as (select distinct user_id, cast(ts as date) as dt from events), f as (select user_id, min(dt) as first_day from d group by 1)
select dt, count(*) filter (dt = first_day) as new_user, count(*) filter (dt > first_day) as old_user from d join f using (user_id) group by dt""",
    "user_login_td": "select user_id, max(cast(ts as date)) as login_date_last, count(distinct cast(ts as date)) as login_count_td from events group by user_id",
    "sku_refund_1d": "select l_partkey, cast(l_shipdate as date) as dt, count(*) as refund_count, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as refund_amount from lineitem where l_returnflag = 'R' group by 1, 2",
    "trade_stats_today": """with t as (select max(cast(o_orderdate as date)) as d from orders)
select count(*) as order_count, count(distinct o_custkey) as order_users, count(*) filter (o_orderstatus = 'F') as paid_count,
  cast(coalesce(sum(cast(o_totalprice as decimal(18,2))) filter (o_orderstatus = 'F'), 0) as double) as paid_amount
from orders, t where cast(o_orderdate as date) = d""",
}
