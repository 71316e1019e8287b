"""Fact tables of orders, payments, coupons, carts, items, products and paths, and the accumulating ones.

Events play the logs, see millrace.plans.daily for their roles; orders of status
F are paid, their lines of status F are received.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.functions.columns import surrogate_key
from millrace.operators.aggregates import dealt
from millrace.operators.dims import pattern_kind
from millrace.operators.loads import accumulate_report, accumulating, close_by_status
from millrace.operators.ranking import gap_seconds, latest_per_key
from millrace.plans.dashboards import visits
from millrace.plans.daily import _dwelt
from millrace.plans.dims import dim_activity, dim_coupon
from millrace.plans.trade import business_date, line_count, order_lines
from millrace.sources.tables import load, money


def fact_cart_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(spark, sf_dir).where("kind = 'click'").select("event_id", "user_id", "item", "dt", F.lit(1).alias("quantity"))


def fact_order_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with order, activity and coupon: one inner and two left joins; every line stays."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_tax") * 100).cast("int").alias("activity_id"), F.when(F.col("l_discount") > 0, F.round(F.col("l_discount") * 100).cast("int")).alias("coupon_id"), money("l_extendedprice").cast("double").alias("amount"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("dt"))
    activity = dim_activity(spark, sf_dir).select("activity_id", F.col("rule").alias("activity_rule"))
    coupon = dim_coupon(spark, sf_dir).select("coupon_id", F.col("benefit").alias("coupon_rule"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return joined.join(activity, "activity_id", "left").join(coupon, "coupon_id", "left")


def fact_pay_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of paid orders (inner) with customer and nation (left)."""
    paid = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("dt"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", money("l_extendedprice").cast("double").alias("amount"))
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("province"))
    joined = lines.join(paid, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "o_custkey", "dt", "amount", "province")


def fact_coupon_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that each coupon was used in."""
    used = load(spark, sf_dir, "lineitem").where("l_discount > 0").select("l_orderkey", F.round(F.col("l_discount") * 100).cast("int").alias("coupon_id")).distinct()
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("dt"))
    return used.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("coupon_id", "l_orderkey", "o_custkey", "dt")


def fact_favourite_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(spark, sf_dir).where("kind = 'signup'").select("event_id", "user_id", "item", "dt")


def snapshot_cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items still in the cart: the last add of a user and item that no purchase follows."""
    last = lambda kind, name: visits(spark, sf_dir).where(F.col("kind") == kind).groupBy("user_id", "item").agg(F.max("ts").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    joined = last("click", "added").join(last("purchase", "bought"), ["user_id", "item"], "left")
    return joined.where("bought is null or bought < added").select("user_id", "item", F.to_date("added").alias("dt"), F.col("n_added").alias("adds"))


def order_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, payment and receipt days of every order."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus", F.to_date("l_shipdate").alias("dt"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("order_day"))
    paid = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.date_add("order_day", 1).alias("dt"))
    received = lines.where("l_linestatus = 'F'").select("o_orderkey", "dt")
    return accumulating(orders, {"pay_day": paid, "finish_day": received}, "o_orderkey")


def order_process_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest day's load of the accumulating process: open orders of before with their status now; finished ones close."""
    today = business_date(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("start_date"))
    open_rows = orders.where(F.col("start_date") < today).select("o_orderkey", F.lit("O").alias("status"), "start_date")
    changed = orders.where(F.col("start_date") >= F.date_sub(today, 30)).select("o_orderkey", "status")
    return close_by_status(open_rows, changed, "o_orderkey", ["F"], today)


def _item_fact(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type")
    return visits(spark, sf_dir).where(F.col("kind") == kind).join(part, "item", "left").select("event_id", "user_id", "item", "p_brand", "p_type", "dt")


def item_visit_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_fact(spark, sf_dir, "view")


def item_favourite_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_fact(spark, sf_dir, "signup")


def item_cart_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_fact(spark, sf_dir, "click")


def item_order_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as item orders with their part."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = order_lines(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return dealt(lines, line_count(spark, sf_dir), "l_partkey", "o_custkey", "dt").groupBy("p_brand", "l_partkey", "o_custkey", "dt").agg(F.count_distinct("l_orderkey").alias("orders"), F.sum("l_quantity").alias("quantity"))


def item_payment_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with their quantity rebuilt: the price is looked up by a computed key, the amount divided by it."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("price_key"), F.col("p_retailprice").alias("price"))
    paid = visits(spark, sf_dir).where("kind = 'purchase'").withColumn("price_key", F.when(F.col("item") % 2 == 0, F.col("item")).otherwise(F.col("item") - 1))
    return paid.join(part, "price_key", "left").select("event_id", "item", "dt", F.col("amount").cast("double").alias("amount"), F.coalesce(F.ceil(F.col("amount").cast("double") * 1000 / F.col("price")), F.lit(1)).cast("long").alias("quantity"))


def item_detail_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with their dwell; valid, if it is longer than a second."""
    return _dwelt(spark, sf_dir).where("kind = 'view'").select("event_id", "user_id", "item", "dt", "dwell", (F.col("dwell") > 1).cast("int").alias("is_valid"))


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with type and brand, the type's parent and its parent by self-joins."""
    tree = load(spark, sf_dir, "part").select("p_type").distinct().select(F.col("p_type").alias("id"), F.substring("p_type", 1, 1).alias("parent"))
    top = tree.select(F.col("parent").alias("id")).distinct().select("id", F.when(F.col("id") < "M", "A-L").otherwise("M-Z").alias("parent"))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return part.join(tree.select(F.col("id").alias("p_type"), F.col("parent").alias("middle")), "p_type", "left").join(top.select(F.col("id").alias("middle"), F.col("parent").alias("top")), "middle", "left")


def product_visitor_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with the kind of page by pattern, and whether they were long enough."""
    kinds = {"cli": "cart", "view": "detail", "pur": "order"}
    return _dwelt(spark, sf_dir).select("event_id", "user_id", "item", pattern_kind(F.col("kind"), kinds, "other").alias("page"), "dt", (F.col("dwell") > 1).cast("int").alias("is_valid"))


def product_transaction_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the brand's separator replaced."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_brand", "#", "-").alias("brand"))
    lines = order_lines(spark, sf_dir).select("l_orderkey", "l_partkey", "o_custkey", "dt", F.col("original").cast("double").alias("amount"))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


def instore_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with a key of their own and the seconds since the one before, within a day."""
    v = visits(spark, sf_dir)
    return v.select(surrogate_key(F.col("user_id"), F.col("event_id")).alias("flow_id"), "event_id", "user_id", F.col("kind").alias("page"), "dt", gap_seconds("ts", ["user_id"], ["ts", "event_id"]).alias("gap"))


def wireless_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last access of every user, page and day."""
    return latest_per_key(visits(spark, sf_dir), ["user_id", "kind", "dt"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", F.col("kind").alias("page"), "dt")


def pc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses with the user's first page of the day: by user and day, not by day alone."""
    entry = F.first("kind").over(Window.partitionBy("user_id", "dt").orderBy("ts", "event_id"))
    return visits(spark, sf_dir).select("event_id", "user_id", F.col("kind").alias("page"), "dt", entry.alias("entry"))


def report_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a report so far and those of a rerun of its last ten days: no row twice."""
    today = business_date(spark, sf_dir)
    per = load(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg(F.count(F.lit(1)).alias("orders"))
    return accumulate_report(per, per.where(F.col("dt") > F.date_sub(today, 10)))


QUERIES = {
    f.__name__: f
    for f in (
        fact_cart_add,
        fact_order_detail,
        fact_pay_success,
        fact_coupon_use,
        fact_favourite_add,
        snapshot_cart,
        order_milestones,
        order_process_daily,
        item_visit_fact,
        item_favourite_fact,
        item_cart_fact,
        item_order_fact,
        item_payment_fact,
        item_detail_fact,
        product_info,
        product_visitor_detail,
        product_transaction_detail,
        instore_flow,
        wireless_access,
        pc_entries,
        report_accumulated,
    )
}

_V = """v as (select event_id, user_id, cast(json_extract_string(props, '$.k') as int) as item, event_type as kind, ts, cast(ts as date) as dt, cast(value as decimal(18,4)) as amount from events),
w as (select *, coalesce(least(lead(floor(epoch(ts))::bigint) over (partition by user_id, dt order by ts, event_id) - floor(epoch(ts))::bigint, 3600), 0) as dwell from v)"""


def _item_sql(kind: str) -> str:
    return f"with {_V} select event_id, user_id, item, p_brand, p_type, dt from v left join part on p_partkey = item where kind = '{kind}'"


ORACLE = {
    "fact_cart_add": f"with {_V} select event_id, user_id, item, dt, 1 as quantity from v where kind = 'click'",
    "fact_order_detail": """with l as (select l_orderkey, l_linenumber, l_partkey, round(l_tax * 100)::int as activity_id, case when l_discount > 0 then round(l_discount * 100)::int end as coupon_id, cast(cast(l_extendedprice as decimal(18,2)) as double) as amount from lineitem)
select l.*, o_custkey, cast(o_orderdate as date) as dt, case when activity_id % 2 = 0 then 'from ' || activity_id || ' on free post' else 'every ' || activity_id || 'th half price' end as activity_rule,
  case when coupon_id < 4 then 'over ' || coupon_id * 100 || ' off ' || coupon_id when coupon_id < 8 then 'over 5 pieces ' || (100 - coupon_id) || ' per cent' else 'less ' || coupon_id end as coupon_rule from l join orders on l_orderkey = o_orderkey""",
    "fact_pay_success": "select l_orderkey, l_linenumber, o_custkey, cast(o_orderdate as date) as dt, cast(cast(l_extendedprice as decimal(18,2)) as double) as amount, n_name as province from lineitem join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey where o_orderstatus = 'F'",
    "fact_coupon_use": "select distinct round(l_discount * 100)::int as coupon_id, l_orderkey, o_custkey, cast(o_orderdate as date) as dt from lineitem join orders on l_orderkey = o_orderkey where l_discount > 0",
    "fact_favourite_add": f"with {_V} select event_id, user_id, item, dt from v where kind = 'signup'",
    "snapshot_cart": f"""with {_V}, c as (select user_id, item, max(ts) filter (kind = 'click') as added, max(ts) filter (kind = 'purchase') as bought, count(*) filter (kind = 'click') as adds from v group by all)
select user_id, item, cast(added as date) as dt, adds from c where added is not null and (bought is null or bought < added)""",
    "order_milestones": """with r as (select l_orderkey, min(cast(l_shipdate as date)) as finish_day from lineitem where l_linestatus = 'F' group by 1)
select o_orderkey, o_orderstatus, cast(o_orderdate as date) as order_day, case when o_orderstatus = 'F' then cast(o_orderdate as date) + 1 end as pay_day, finish_day from orders left join r on l_orderkey = o_orderkey""",
    "order_process_daily": """with o as (select o_orderkey, o_orderstatus, cast(o_orderdate as date) as start_date from orders), t as (select max(start_date) as d from o)
select o_orderkey, case when start_date >= d - 30 then o_orderstatus else 'O' end as status, start_date, case when start_date >= d - 30 and o_orderstatus = 'F' then d else date '9999-12-31' end as end_date from o, t where start_date < d""",
    "item_visit_fact": _item_sql("view"),
    "item_favourite_fact": _item_sql("signup"),
    "item_cart_fact": _item_sql("click"),
    "item_order_fact": "select p_brand, l_partkey, o_custkey, cast(o_orderdate as date) as dt, count(distinct l_orderkey) as orders, sum(l_quantity) as quantity from lineitem join orders on l_orderkey = o_orderkey left join part on l_partkey = p_partkey group by all",
    "item_payment_fact": f"with {_V} select event_id, item, dt, cast(amount as double) as amount, coalesce(ceil(cast(amount as double) * 1000 / p_retailprice), 1)::bigint as quantity from v left join part on p_partkey = item - item % 2 where kind = 'purchase'",
    "item_detail_fact": f"with {_V} select event_id, user_id, item, dt, dwell, (dwell > 1)::int as is_valid from w where kind = 'view'",
    "product_info": "select p_partkey, p_name, p_brand, p_type, p_type[1:1] as middle, case when p_type[1:1] < 'M' then 'A-L' else 'M-Z' end as top from part",
    "product_visitor_detail": f"with {_V} select event_id, user_id, item, case kind when 'click' then 'cart' when 'view' then 'detail' when 'purchase' then 'order' else 'other' end as page, dt, (dwell > 1)::int as is_valid from w",
    "product_transaction_detail": "select l_orderkey, l_partkey, o_custkey, cast(o_orderdate as date) as dt, cast(cast(l_extendedprice as decimal(18,2)) as double) as amount, replace(p_brand, '#', '-') as brand from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey",
    "instore_flow": f"""with {_V}, g as (select *, floor(epoch(ts))::bigint - lag(floor(epoch(ts))::bigint) over (partition by user_id order by ts, event_id) as gap from v)
select md5(length(user_id::varchar) || ':' || user_id || length(event_id::varchar) || ':' || event_id) as flow_id, event_id, user_id, kind as page, dt, case when gap is not null then greatest(0, least(86400, gap)) end as gap from g""",
    "wireless_access": f"with {_V} select event_id, user_id, kind as page, dt from v qualify row_number() over (partition by user_id, kind, dt order by ts desc, event_id desc) = 1",
    "pc_entries": f"with {_V} select event_id, user_id, kind as page, dt, first_value(kind) over (partition by user_id, dt order by ts, event_id) as entry from v",
    "report_accumulated": "select cast(o_orderdate as date) as dt, count(*) as orders from orders group by 1",
}
