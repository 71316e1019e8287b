"""Item, product and path dashboards over events, lineitem, part, orders and pages.

Events play the visit log; the item of an event is the value k of its props.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.operators.aggregates import dealt, ratio
from millrace.operators.ranking import gap_seconds, ranks_at_once, latest_per_key, range_starts, rank_by_ranges, running_sum, share, top_ranked
from millrace.plans.trade import business_date, line_count, order_lines
from millrace.sources.scratch import stored
from millrace.sources.tables import load, money


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, item, kind, ts, dt, amount; the item is k of the JSON props."""
    events = load(spark, sf_dir, "events")
    item = F.from_json("props", "struct<k:int>")["k"]
    return events.select("event_id", "user_id", item.alias("item"), F.col("event_type").alias("kind"), "ts", F.to_date("ts").alias("dt"), F.col("value").cast("decimal(18,4)").alias("amount"))


def item_wide_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits, visitors, clicks and purchases per item and day; each measure counts its own branch of a tagged union."""
    v = visits(spark, sf_dir)
    seen = v.where("kind = 'view'").select("item", "dt", "user_id", F.lit("visit").alias("tag"), F.lit(0).cast("decimal(18,4)").alias("amount"))
    clicked = v.where("kind = 'click'").select("item", "dt", "user_id", F.lit("click").alias("tag"), F.lit(0).cast("decimal(18,4)").alias("amount"))
    bought = v.where("kind = 'purchase'").select("item", "dt", "user_id", F.lit("buy").alias("tag"), "amount")
    united = seen.unionByName(clicked).unionByName(bought)
    tag = lambda t: F.col("tag") == t
    return united.groupBy("item", "dt").agg(
        F.count_if(tag("visit")).alias("visits"),
        F.count_distinct(F.when(tag("visit"), F.col("user_id"))).alias("visitors"),
        F.count_if(tag("click")).alias("clicks"),
        F.count_if(tag("buy")).alias("purchases"),
        F.sum(F.when(tag("buy"), F.col("amount")).otherwise(0)).cast("double").alias("amount"),
    )


def user_item_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and item: did they view, click, buy; and the amount."""
    flag = lambda k: F.max(F.when(F.col("kind") == k, 1).otherwise(0))
    return visits(spark, sf_dir).groupBy("user_id", "item").agg(flag("view").alias("viewed"), flag("click").alias("clicked"), flag("purchase").alias("bought"), F.coalesce(F.sum(F.when(F.col("kind") == "purchase", F.col("amount"))), F.lit(0)).cast("double").alias("amount"))


def category_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional distinct users and items per category; the unknown bucket holds items without one."""
    v = visits(spark, sf_dir)
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand")
    bought = F.col("kind") == "purchase"
    return v.join(part, "item", "left").groupBy(F.coalesce("p_brand", F.lit("unknown")).alias("category")).agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(bought, F.col("user_id"))).alias("buyers"), F.count_distinct("item").alias("items"))


def week_month_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per user by ISO week (yyyyww) and month (yyyymm), united."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("dt"), money("o_totalprice").alias("amount"))
    week = F.expr("extract(yearofweek from dt)") * 100 + F.weekofyear("dt")
    summed = lambda kind, key: orders.groupBy("o_custkey", F.lit(kind).alias("period"), key.cast("int").alias("period_key")).agg(F.count(F.lit(1)).alias("orders"), F.sum("amount").cast("double").alias("amount"))
    return summed("week", week).unionByName(summed("month", F.date_format("dt", "yyyyMM")))


def new_old_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and old buyers and amounts per item brand; a buyer is new without a purchase in the 365 days before."""
    lines = order_lines(spark, sf_dir).select("o_custkey", "l_partkey", "dt", "original")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # Lines without a part are days of their buyer, too.
    named = lines.where("o_custkey is not null and dt is not null").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    own = dealt(named.select("o_custkey", "dt", "p_partkey", "p_brand", "original"), line_count(spark, sf_dir), "o_custkey")
    earlier = Window.partitionBy("o_custkey").orderBy(F.unix_date("dt")).rangeBetween(Window.unboundedPreceding, -1)
    before = F.max("dt").over(earlier)
    flagged = own.withColumn("is_new", before.isNull() | (F.datediff("dt", before) > 365)).where("p_partkey is not null")
    new, amount = F.col("is_new"), F.col("original")
    # A row per brand and buyer, in the buyer's task, so that buyers are counted as rows.
    each = flagged.groupBy("p_brand", "o_custkey").agg(F.max(new.cast("int")).alias("new"), F.max((~new).cast("int")).alias("old"), F.sum(F.when(new, amount)).alias("new_amount"), F.sum(F.when(~new, amount)).alias("old_amount"))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("double").alias(name)
    return each.groupBy("p_brand").agg(F.sum("new").alias("new_buyers"), F.sum("old").alias("old_buyers"), total("new_amount"), total("old_amount"))


def item_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, lines and amount by price band."""
    price = F.col("p_retailprice")
    band = F.when(price < 950, "low").when(price < 1200, "middle").otherwise("high")
    part = load(spark, sf_dir, "part").select("p_partkey", band.alias("band"))
    sold = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(money("l_extendedprice")).alias("amount"))
    return part.join(sold, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("band").agg(F.count(F.lit(1)).alias("items"), F.count("lines").alias("sold_items"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("amount"))


def item_ytd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running year-to-date amount per brand and month by a window, not a correlated range subquery."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = order_lines(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    monthly = lines.groupBy("p_brand", F.year("dt").alias("year"), F.month("dt").alias("month")).agg(F.sum("original").alias("amount"))
    return monthly.select("p_brand", "year", "month", F.col("amount").cast("double").alias("amount"), running_sum("amount", ["p_brand", "year"], ["month"]).cast("double").alias("amount_ytd"))


def product_daily_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits and purchases are summed apart, then joined, so that a payment counts once."""
    v = visits(spark, sf_dir)
    seen = v.where("kind = 'view'").groupBy("item", "dt").agg(F.count_distinct("user_id").alias("visitors"))
    bought = v.where("kind = 'purchase'").groupBy("item", "dt").agg(F.count_distinct("user_id").alias("buyers"), F.sum("amount").cast("double").alias("amount"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return seen.join(bought, ["item", "dt"], "left").select("item", "dt", "visitors", zero("buyers").alias("buyers"), F.coalesce("amount", F.lit(0.0)).alias("amount"), ratio(zero("buyers"), F.col("visitors")).alias("conversion"))


def product_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products by amount: rank over the aggregate, overall and within the brand."""
    sold = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(money("l_extendedprice")).alias("amount"))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = sold.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_partkey", "p_brand", "amount")
    starts = range_starts(joined, "amount", int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = rank_by_ranges(joined, "amount", ["p_brand"], starts, "brand_rank")
    return rank_by_ranges(ranked, "amount", [], starts, "overall_rank").withColumn("amount", F.col("amount").cast("double"))


def sku_share_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five skus of a brand with their share of its amount."""
    sold = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(money("l_extendedprice")).alias("amount"))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = sold.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_partkey", "amount", share("amount", ["p_brand"], "amount_share"))
    return top_ranked(joined, ["p_brand"], [F.desc("amount")], 5).withColumn("amount", F.col("amount").cast("double"))


def page_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step to step jumps of a user's events with jumps and visitors."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = load(spark, sf_dir, "events").withColumn("target", F.lead("event_type").over(own)).where("target is not null")
    return steps.groupBy(F.col("event_type").alias("source"), "target").agg(F.count(F.lit(1)).alias("jumps"), F.count_distinct("user_id").alias("visitors"))


def dwell_lag_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between a user's events, clamped to a day; sums per event type."""
    events = load(spark, sf_dir, "events").withColumn("gap", gap_seconds("ts", ["user_id"], ["ts", "event_id"]))
    return events.groupBy("event_type").agg(F.count("gap").alias("gaps"), F.sum("gap").alias("seconds"), F.max("gap").cast("long").alias("longest"))


def entry_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry step per user and day, and the share of those visitors who bought that day."""
    v = visits(spark, sf_dir)
    own = Window.partitionBy("user_id", "dt").orderBy("ts", "event_id")
    marked = v.withColumn("entry", F.first("kind").over(own)).groupBy("user_id", "dt", "entry").agg(F.max((F.col("kind") == "purchase").cast("int")).alias("ordered"))
    return marked.groupBy("entry").agg(F.count(F.lit(1)).alias("sessions"), F.sum("ordered").alias("ordering"), ratio(F.sum("ordered"), F.count(F.lit(1))).alias("conversion"))


def source_host_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host of the URL: pages, rank, share; ties kept, top 20."""
    host = F.try_parse_url("url", F.lit("HOST"))
    per = stored(load(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("pages")))
    whole = per.crossJoin(per.agg(F.sum("pages").alias("all_pages")))
    ranked = ranks_at_once(whole.select("host", "pages", ratio(F.col("pages"), F.col("all_pages"), 6).alias("share")), ["host"], {"pages": "rk"})
    return ranked.where("rk <= 20")


def latest_order_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return latest_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


def shop_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consult (view), order (click) and pay (purchase) per day with zero-guarded rates and mean value."""
    v = visits(spark, sf_dir)
    kind = lambda k: F.count_distinct(F.when(F.col("kind") == k, F.col("user_id")))
    per = v.groupBy("dt").agg(kind("view").alias("consult"), kind("click").alias("ordered"), kind("purchase").alias("paid"), F.coalesce(F.sum(F.when(F.col("kind") == "purchase", F.col("amount"))), F.lit(0)).alias("amount"))
    return per.select("dt", "consult", "ordered", "paid", ratio(F.col("ordered"), F.col("consult")).alias("consult_to_order"), ratio(F.col("paid"), F.col("consult")).alias("consult_to_pay"), ratio(F.col("paid"), F.col("ordered")).alias("order_to_pay"), F.col("amount").cast("double").alias("amount"))


def busy_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten days with the largest order amount."""
    today = business_date(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").where(F.to_date("o_orderdate") <= today)
    per = orders.groupBy(F.to_date("o_orderdate").alias("dt")).agg(F.count(F.lit(1)).alias("orders"), F.sum(money("o_totalprice")).cast("double").alias("amount"))
    return per.orderBy(F.desc("amount"), "dt").limit(10)


QUERIES = {
    f.__name__: f
    for f in (
        item_wide_day,
        user_item_flags,
        category_distinct,
        week_month_summary,
        new_old_buyers,
        item_bands,
        item_ytd,
        product_daily_conversion,
        product_rank,
        sku_share_top5,
        page_transitions,
        dwell_lag_clamped,
        entry_page,
        source_host_share,
        latest_order_per_user,
        shop_funnel,
        busy_days,
    )
}

_V = """v as (select event_id, user_id, cast(json_extract_string(props, '$.k') as int) as item, event_type as kind, ts, cast(ts as date) as dt, cast(value as decimal(18,4)) as amount from events)"""
_D = """detail as (select o_custkey, l_partkey, cast(l_extendedprice as decimal(18,2)) as original, cast(o_orderdate as date) as dt from lineitem join orders on l_orderkey = o_orderkey)"""
_SOLD = """sold as (select l_partkey, p_brand, sum(cast(l_extendedprice as decimal(18,2))) as amount from lineitem join part on l_partkey = p_partkey group by 1, 2)"""

ORACLE = {
    "item_wide_day": f"""with {_V} select item, dt, count(*) filter (kind = 'view') as visits, count(distinct user_id) filter (kind = 'view') as visitors, count(*) filter (kind = 'click') as clicks,
  count(*) filter (kind = 'purchase') as purchases, cast(coalesce(sum(amount) filter (kind = 'purchase'), 0) as double) as amount from v where kind in ('view', 'click', 'purchase') group by 1, 2""",
    "user_item_flags": f"""with {_V} select user_id, item, max((kind = 'view')::int) as viewed, max((kind = 'click')::int) as clicked, max((kind = 'purchase')::int) as bought,
  cast(coalesce(sum(amount) filter (kind = 'purchase'), 0) as double) as amount from v group by 1, 2""",
    "category_distinct": f"""with {_V} select coalesce(p_brand, 'unknown') as category, count(distinct user_id) as users, count(distinct user_id) filter (kind = 'purchase') as buyers, count(distinct item) as items
from v left join part on p_partkey = item group by 1""",
    "week_month_summary": """with o as (select o_custkey, cast(o_orderdate as date) as dt, cast(o_totalprice as decimal(18,2)) as amount from orders)
select o_custkey, 'week' as period, (isoyear(dt) * 100 + weekofyear(dt))::int as period_key, count(*) as orders, cast(sum(amount) as double) as amount from o group by 1, 3
union all select o_custkey, 'month', (year(dt) * 100 + month(dt))::int, count(*), cast(sum(amount) as double) from o group by 1, 3""",
    "new_old_buyers": f"""with {_D}, b as (select o_custkey, dt, lag(dt) over (partition by o_custkey order by dt) as before from (select distinct o_custkey, dt from detail)),
j as (select p_brand, o_custkey, original, before is null or dt - before > 365 as is_new from detail join b using (o_custkey, dt) join part on l_partkey = p_partkey)
select p_brand, count(distinct o_custkey) filter (is_new) as new_buyers, count(distinct o_custkey) filter (not is_new) as old_buyers,
  cast(coalesce(sum(original) filter (is_new), 0) as double) as new_amount, cast(coalesce(sum(original) filter (not is_new), 0) as double) as old_amount from j group by 1""",
    "item_bands": """with s as (select l_partkey, count(*) as lines, sum(cast(l_extendedprice as decimal(18,2))) as amount from lineitem group by 1)
select case when p_retailprice < 950 then 'low' when p_retailprice < 1200 then 'middle' else 'high' end as band, count(*) as items, count(lines) as sold_items,
  coalesce(sum(lines), 0)::bigint as lines, cast(coalesce(sum(amount), 0) as double) as amount from part left join s on l_partkey = p_partkey group by 1""",
    "item_ytd": f"""with {_D}, m as (select p_brand, year(dt)::int as year, month(dt)::int as month, sum(original) as amount from detail join part on l_partkey = p_partkey group by 1, 2, 3)
select p_brand, year, month, cast(amount as double) as amount, cast(sum(amount) over (partition by p_brand, year order by month) as double) as amount_ytd from m""",
    "product_daily_conversion": f"""with {_V}, s as (select item, dt, count(distinct user_id) as visitors from v where kind = 'view' group by 1, 2),
b as (select item, dt, count(distinct user_id) as buyers, cast(sum(amount) as double) as amount from v where kind = 'purchase' group by 1, 2)
select item, dt, visitors, coalesce(buyers, 0) as buyers, coalesce(amount, 0) as amount, round(coalesce(buyers, 0) / visitors, 4) as conversion from s left join b using (item, dt)""",
    "product_rank": f"""with {_SOLD}, r as (select *, rank() over (partition by p_brand order by amount desc) as brand_rank from sold)
select l_partkey, p_brand, cast(amount as double) as amount, brand_rank::int as brand_rank, (rank() over (order by amount desc))::int as overall_rank from r""",
    "sku_share_top5": f"""with {_SOLD}, r as (select p_brand, l_partkey, amount, round(cast(amount as double) / cast(sum(amount) over (partition by p_brand) as double), 4) as amount_share, (rank() over (partition by p_brand order by amount desc))::int as rk from sold)
select p_brand, l_partkey, cast(amount as double) as amount, amount_share, rk from r where rk <= 5""",
    "page_transitions": """with s as (select user_id, event_type as source, lead(event_type) over (partition by user_id order by ts, event_id) as target from events)
select source, target, count(*) as jumps, count(distinct user_id) as visitors from s where target is not null group by 1, 2""",
    "dwell_lag_clamped": """with g as (select event_type, floor(epoch(ts))::bigint - lag(floor(epoch(ts))::bigint) over (partition by user_id order by ts, event_id) as gap from events),
c as (select event_type, case when gap is not null then greatest(0, least(86400, gap)) end as gap from g)
select event_type, count(gap) as gaps, sum(gap)::bigint as seconds, max(gap)::bigint as longest from c group by 1""",
    "entry_page": f"""with {_V}, e as (select user_id, dt, kind, first_value(kind) over (partition by user_id, dt order by ts, event_id) as entry from v),
m as (select user_id, dt, entry, max((kind = 'purchase')::int) as ordered from e group by 1, 2, 3)
select entry, count(*) as sessions, sum(ordered)::bigint as ordering, round(sum(ordered) / count(*), 4) as conversion from m group by 1""",
    "source_host_share": """with p as (select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, count(*) as pages from pages group by 1)
select host, pages, round(pages / (select sum(pages) from p), 6) as share, (rank() over (order by pages desc))::int as rk from p qualify rk <= 20""",
    "latest_order_per_user": "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "shop_funnel": f"""with {_V}, p as (select dt, count(distinct user_id) filter (kind = 'view') as consult, count(distinct user_id) filter (kind = 'click') as ordered, count(distinct user_id) filter (kind = 'purchase') as paid,
  coalesce(sum(amount) filter (kind = 'purchase'), 0) as amount from v group by 1)
select dt, consult, ordered, paid, round(coalesce(ordered / nullif(consult, 0), 0), 4) as consult_to_order, round(coalesce(paid / nullif(consult, 0), 0), 4) as consult_to_pay,
  round(coalesce(paid / nullif(ordered, 0), 0), 4) as order_to_pay, cast(amount as double) as amount from p""",
    "busy_days": "select cast(o_orderdate as date) as dt, count(*) as orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount from orders group by 1 order by amount desc, dt limit 10",
}
