"""Daily metrics of users, items, products, pages and activities.

Of the events, view plays the visit, click the cart add, signup the favourite,
error the removal, purchase the payment; the item is k of the props. Dwell is
the time to the user's next event of the day, at most an hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.operators.aggregates import dealt, ratio, within_days
from millrace.operators.lookups import insert_missing, small_broadcast
from millrace.operators.ranking import top_ranked
from millrace.plans.dashboards import visits
from millrace.plans.streams import _mentions, _pairs
from millrace.plans.trade import business_date, line_count, order_lines, part_sales, with_orders
from millrace.sources.tables import load, money

LONGEST = 3600
BOUNCE = 60
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def _over(top: Column, bottom: Column) -> Column:
    """top / bottom as it is, not rounded; 0 where the base is 0 or missing."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _dwelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """visits() with dwell seconds; the last event of a day has 0."""
    own = Window.partitionBy("user_id", "dt").orderBy("ts", "event_id")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return visits(spark, sf_dir).withColumn("dwell", F.coalesce(F.least(F.lead(at).over(own) - at, F.lit(LONGEST)), F.lit(0)))


def _of(kind: str, value: Column | None = None) -> Column:
    return F.when(F.col("kind") == kind, F.lit(1) if value is None else value)


def _amount(condition: Column, column: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)).cast("double")


def user_cart_add_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(spark, sf_dir).where("kind = 'click'").groupBy("user_id", "dt").agg(F.count(F.lit(1)).alias("cart_adds"), F.count_distinct("item").alias("items"))


def user_coupon_use_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discount of n per cent plays coupon n."""
    coupon = F.round(F.col("l_discount") * 100).cast("int")
    lines = load(spark, sf_dir, "lineitem").where("l_discount > 0").select("l_orderkey", coupon.alias("coupon_id"), (money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).alias("cut"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("dt"))
    rows = line_count(spark, sf_dir)
    return dealt(with_orders(lines, orders, rows), rows, "o_custkey", "coupon_id", "dt").groupBy("o_custkey", "coupon_id", "dt").agg(F.count_distinct("l_orderkey").alias("used_count"), F.sum("cut").cast("double").alias("reduce_amount"))


def sku_favourite_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = visits(spark, sf_dir).where("kind = 'signup'").groupBy("item", "dt").agg(F.count(F.lit(1)).alias("favourites"))
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type")
    return per.join(part, "item", "left")


def session_page_view_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day plays a session: dwell and pages."""
    return _dwelt(spark, sf_dir).groupBy("user_id", "dt").agg(F.sum("dwell").alias("dwell_seconds"), F.count(F.lit(1)).alias("pages"))


def visitor_page_view_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dwelt(spark, sf_dir).groupBy("user_id", F.col("kind").alias("page"), "dt").agg(F.sum("dwell").alias("dwell_seconds"), F.count(F.lit(1)).alias("views"))


def item_full_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything about an item's day from one tagged union; a measure counts its own branch only."""
    v = _dwelt(spark, sf_dir)
    branch = lambda kind, tag, *more: v.where(F.col("kind") == kind).select("item", "dt", "user_id", F.lit(tag).alias("tag"), *more)
    united = branch("view", "visit", "dwell")
    for other in (branch("signup", "favourite"), branch("error", "removal"), branch("click", "cart"), branch("purchase", "pay", "amount")):
        united = united.unionByName(other, allowMissingColumns=True)
    tag = lambda t: F.col("tag") == t
    return united.groupBy("item", "dt").agg(
        F.count_if(tag("visit")).alias("visits"),
        F.count_distinct(F.when(tag("visit"), F.col("user_id"))).alias("visitors"),
        F.coalesce(F.sum("dwell"), F.lit(0)).alias("dwell_seconds"),
        F.count_if(tag("visit") & (F.col("dwell") < BOUNCE)).alias("bounces"),
        F.count_distinct(F.when(tag("visit") & (F.col("dwell") >= BOUNCE), F.col("user_id"))).alias("detail_visitors"),
        F.count_if(tag("favourite")).alias("favourites"),
        (F.count_if(tag("favourite")) - F.count_if(tag("removal"))).alias("net_favourites"),
        F.count_if(tag("cart")).alias("cart_adds"),
        F.count_distinct(F.when(tag("cart"), F.col("user_id"))).alias("cart_users"),
        F.count_if(tag("pay")).alias("payments"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("pay_amount"),
    )


def activity_effect_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, users, orders, payments and refunds per activity (tax rate in per cent) and day; sides are summed before they join."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.round(F.col("l_tax") * 100).cast("int").alias("activity_id"), "l_returnflag", money("l_extendedprice").alias("amount"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("dt"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    keys = ["activity_id", "dt"]
    made = joined.groupBy(*keys).agg(F.count_distinct("l_partkey").alias("items"), F.count_distinct("o_custkey").alias("users"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("l_orderkey"))).alias("payments"))
    refunds = joined.where("l_returnflag = 'R'").groupBy(*keys).agg(F.count(F.lit(1)).alias("refunds"), F.sum("amount").cast("double").alias("refund_amount"))
    return made.join(refunds, keys, "left").fillna({"refunds": 0, "refund_amount": 0.0})


def user_week_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per user by ISO week and month; new, where the period's first order has none in the 365 days before."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("dt"), money("o_totalprice").alias("amount"))
    days = orders.groupBy("o_custkey", "dt").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    before = F.lag("dt").over(Window.partitionBy("o_custkey").orderBy("dt"))
    flagged = days.withColumn("is_new", F.coalesce(F.datediff("dt", before) > 365, F.lit(True)).cast("int"))
    week = F.extract(F.lit("YEAROFWEEK"), F.col("dt")) * 100 + F.weekofyear("dt")
    each = flagged.withColumn("p", F.explode(F.array(F.struct(F.lit("week").alias("period"), week.cast("int").alias("period_key")), F.struct(F.lit("month").alias("period"), F.date_format("dt", "yyyyMM").cast("int").alias("period_key")))))
    return each.groupBy("o_custkey", "p.period", "p.period_key").agg(F.sum("n").alias("orders"), F.sum("amount").cast("double").alias("amount"), F.min_by("is_new", "dt").alias("is_new_buyer"))


def item_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, mean order value, visitor value and the year's amount per item; every side has one row per item before it joins."""
    today = business_date(spark, sf_dir)
    seen = visits(spark, sf_dir).groupBy(F.col("item").alias("p_partkey")).agg(F.count_distinct("user_id").alias("visitors"))
    original = F.col("original")
    sums = {"amount": original, "ytd": F.when(F.year("dt") == F.year(today), original), "refund": F.when(F.col("l_returnflag") == "R", original)}
    sold = part_sales(spark, sf_dir, sums).select(F.col("l_partkey").alias("p_partkey"), "orders", "buyers", "amount", F.coalesce("ytd", F.lit(0)).cast("double").alias("amount_ytd"), "refund")
    joined = load(spark, sf_dir, "part").select("p_partkey").join(sold, "p_partkey", "left").join(seen, "p_partkey", "left")
    amount = F.coalesce(F.col("amount"), F.lit(0))
    return joined.select(
        "p_partkey",
        _zero("visitors").alias("visitors"),
        _zero("buyers").alias("buyers"),
        _zero("orders").alias("orders"),
        amount.cast("double").alias("amount"),
        F.coalesce("amount_ytd", F.lit(0.0)).alias("amount_ytd"),
        _over(amount, F.col("orders")).alias("mean_order_value"),
        _over(amount, F.col("visitors")).alias("visitor_value"),
        _over(_zero("refund"), amount).alias("refund_rate"),
    )


def item_band_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold items, amount, quantity, new buyers of the last 365 days and mean price by price band."""
    today = business_date(spark, sf_dir)
    price = F.col("p_retailprice")
    part = load(spark, sf_dir, "part").select("p_partkey", F.when(price < 950, "low").when(price < 1200, "middle").otherwise("high").alias("band"))
    lines = order_lines(spark, sf_dir)
    first = lines.groupBy("o_custkey").agg(F.min("dt").alias("first_day"))
    recent = lines.where(within_days("dt", today, 365)).join(first, "o_custkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    new = F.when(within_days("first_day", today, 365), F.col("o_custkey"))
    per = recent.groupBy("band").agg(F.count_distinct("l_partkey").alias("sold_items"), F.sum("original").alias("amount"), F.sum("l_quantity").alias("quantity"), F.count_distinct(new).alias("new_buyers"))
    return per.select("band", "sold_items", F.col("amount").cast("double").alias("amount"), "quantity", "new_buyers", ratio(F.col("amount"), F.col("quantity"), 2).alias("mean_price"))


def _product_measures() -> list[Column]:
    buyer = _of("purchase", F.col("user_id"))
    return [
        F.count_distinct(_of("view", F.col("user_id"))).alias("visitors"),
        F.count(_of("purchase")).alias("orders"),
        F.count_distinct(buyer).alias("buyers"),
        _amount(F.col("kind") == "purchase").alias("amount"),
        F.coalesce(F.sum(_of("view", F.col("dwell"))), F.lit(0)).alias("stay_seconds"),
        F.count(_of("view")).alias("views"),
        F.count(_of("error")).alias("refunds"),
        F.count_distinct(_of("click", F.col("user_id"))).alias("cart_visitors"),
    ]


def _rated(df: DataFrame) -> DataFrame:
    return df.withColumn("conversion", ratio(F.col("buyers"), F.col("visitors"))).withColumn("mean_stay", ratio(F.col("stay_seconds"), F.col("views"), 2))


def product_full_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(_dwelt(spark, sf_dir).groupBy("item", "dt").agg(*_product_measures()))


def product_source_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_full_day by traffic source; the source's key is computed by CASE and looked up by name (regions play the sources)."""
    user = F.col("user_id") % 10
    source = F.when(user < 4, 0).when(user < 6, 1).when(user < 8, 2).when(user < 9, 3).otherwise(4)
    names = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("source_id"), F.col("r_name").alias("source"))
    per = _dwelt(spark, sf_dir).withColumn("source_id", source).groupBy("item", "source_id", "dt").agg(*_product_measures())
    return _rated(per.join(names, "source_id", "left").drop("source_id"))


def product_sku_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts per brand, sku and day, split by refund."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = order_lines(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    back = F.col("l_returnflag") == "R"
    return lines.groupBy("p_brand", "l_partkey", "dt").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("o_custkey").alias("buyers"), _amount(~back, "original").alias("kept_amount"), _amount(back, "original").alias("refund_amount"))


def page_visits_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits, visitors, mean stay and rank of every page and day."""
    per = _dwelt(spark, sf_dir).groupBy("dt", F.col("kind").alias("page")).agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("user_id").alias("visitors"), F.sum("dwell").alias("stay"))
    ranked = per.withColumn("rk", F.rank().over(Window.partitionBy("dt").orderBy(F.desc("visits"))))
    return ranked.select("dt", "page", "visits", "visitors", ratio(F.col("stay"), F.col("visits"), 2).alias("mean_stay"), "rk")


def page_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps from page to page with visitors, and those of them who bought on the day."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought = F.max((F.col("kind") == "purchase").cast("int")).over(Window.partitionBy("user_id", "dt"))
    steps = visits(spark, sf_dir).withColumn("target", F.lead("kind").over(own)).withColumn("bought", bought).where("target is not null")
    return steps.groupBy(F.col("kind").alias("source"), "target").agg(F.count(F.lit(1)).alias("jumps"), F.count_distinct("user_id").alias("visitors"), F.count_distinct(F.when(F.col("bought") == 1, F.col("user_id"))).alias("ordering_visitors"))


def shop_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of consulting, ordering and paying users per day, and the mean payment; 0 where the base is 0."""
    kind = lambda k: F.count_distinct(_of(k, F.col("user_id")))
    per = visits(spark, sf_dir).groupBy("dt").agg(kind("view").alias("consult"), kind("click").alias("ordered"), kind("purchase").alias("paid"), F.count(_of("purchase")).alias("payments"), F.sum(_of("purchase", F.col("amount"))).alias("amount"))
    rate = lambda top, base: ratio(F.col(top), F.col(base)).alias(f"{base}_to_{top}")
    return per.select("dt", rate("ordered", "consult"), rate("paid", "consult"), rate("paid", "ordered"), ratio(F.col("amount"), F.col("payments"), 2).alias("mean_payment"))


def consult_order_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from consulting over ordering to paying by user and item: each step joins its first time, then counts by the day of the consultation."""
    v = visits(spark, sf_dir)
    step = lambda k, name: v.where(F.col("kind") == k).groupBy("user_id", "item").agg(F.min("ts").alias(name))
    chain = step("view", "consulted").join(step("click", "ordered"), ["user_id", "item"], "left").join(step("purchase", "paid"), ["user_id", "item"], "left")
    ordered = F.col("ordered") >= F.col("consulted")
    return chain.groupBy(F.to_date("consulted").alias("dt")).agg(F.count(F.lit(1)).alias("consulted"), F.count_if(ordered).alias("ordered"), F.count_if(ordered & (F.col("paid") >= F.col("ordered"))).alias("paid"))


def order_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """refund before payment before order; orders by type and day."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("refund"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("dt"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("payment"))
    kind = F.when(F.col("refund").isNotNull(), "refund").when(F.col("payment").isNotNull(), "payment").otherwise("order")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(kind.alias("event_type"), "dt").agg(F.count(F.lit(1)).alias("n"))


def customers_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers of the last 365 days, and the customers that aren't among them."""
    today = business_date(spark, sf_dir)
    have = load(spark, sf_dir, "orders").where(within_days(F.to_date("o_orderdate"), today, 365)).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("origin", F.lit("orders"))
    rows = load(spark, sf_dir, "customer").select("c_custkey").withColumn("origin", F.lit("customer"))
    return insert_missing(have, rows, ["c_custkey"])


def lines_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per category; the parts are broadcast where their count allows it."""
    part = small_broadcast(load(spark, sf_dir, "part").select("p_partkey", "p_type"))
    return load(spark, sf_dir, "lineitem").select("l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.count(F.lit(1)).alias("lines"))


def sample_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a sample: the 100 least ids of customers with orders."""
    return load(spark, sf_dir, "orders").select("o_custkey").distinct().orderBy("o_custkey").limit(100)


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ship day, sorted, with its place and lines."""
    per = load(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("dt")).agg(F.count(F.lit(1)).alias("lines"))
    return per.withColumn("nth", F.row_number().over(Window.orderBy("dt"))).orderBy("dt")


def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 names that most sentences hold; of equal ones the first by name."""
    per = _mentions(spark, sf_dir, ["doc_id", "nth"]).groupBy("name").agg(F.count(F.lit(1)).alias("sentences"))
    return per.orderBy(F.desc("sentences"), "name").limit(20)


def top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).orderBy(F.desc("weight"), "a", "b").limit(20)


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of rows of every table."""
    counts = None
    for name in TABLES:
        one = load(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def brand_price_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest parts of each brand, ties kept."""
    return top_ranked(load(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice")], 3)


QUERIES = {
    f.__name__: f
    for f in (
        user_cart_add_1d,
        user_coupon_use_1d,
        sku_favourite_1d,
        session_page_view_1d,
        visitor_page_view_1d,
        item_full_day,
        activity_effect_1d,
        user_week_month,
        item_overview,
        item_band_sales,
        product_full_day,
        product_source_day,
        product_sku_day,
        page_visits_ranked,
        page_jumps,
        shop_conversion,
        consult_order_pay,
        order_event_types,
        customers_inserted,
        lines_by_category,
        sample_customers,
        ship_days,
        top_names,
        top_edges,
        table_rows,
        brand_price_leaders,
    )
}

_V = f"""v as (select event_id, user_id, cast(json_extract_string(props, '$.k') as int) as item, event_type as kind, ts, cast(ts as date) as dt, cast(value as decimal(18,4)) as amount from events),
w as (select *, coalesce(least(lead(floor(epoch(ts))::bigint) over (partition by user_id, dt order by ts, event_id) - floor(epoch(ts))::bigint, {LONGEST}), 0) as dwell from v)"""
_D = """d as (select l_orderkey, l_partkey, o_custkey, l_returnflag, l_quantity, cast(l_extendedprice as decimal(18,2)) as original, cast(o_orderdate as date) as dt from lineitem join orders on l_orderkey = o_orderkey),
today as (select max(cast(o_orderdate as date)) as today from orders)"""
_MEASURES = """count(distinct user_id) filter (kind = 'view') as visitors, count(*) filter (kind = 'purchase') as orders, count(distinct user_id) filter (kind = 'purchase') as buyers,
  cast(coalesce(sum(amount) filter (kind = 'purchase'), 0) as double) as amount, coalesce(sum(dwell) filter (kind = 'view'), 0)::bigint as stay_seconds, count(*) filter (kind = 'view') as views,
  count(*) filter (kind = 'error') as refunds, count(distinct user_id) filter (kind = 'click') as cart_visitors"""
_RATES = "round(coalesce(buyers / nullif(visitors, 0), 0), 4) as conversion, round(coalesce(stay_seconds / nullif(views, 0), 0), 2) as mean_stay"
_NAMES = r"""
with names as (select distinct unnest(regexp_extract_all(text, '[\p{L}\p{N}]{6,}')) as name from benchmark),
split as (select doc_id, regexp_split_to_array(text, '[.!?\n]') as s from documents),
sentences as (select doc_id, unnest(range(len(s))) as nth, unnest(s) as sentence from split),
said as (select doc_id, nth, unnest(list_distinct(regexp_extract_all(sentence, '[\p{L}\p{N}]+'))) as name from sentences),
mentions as (select doc_id, nth, name from said join names using (name))
"""

ORACLE = {
    "user_cart_add_1d": f"with {_V} select user_id, dt, count(*) as cart_adds, count(distinct item) as items from v where kind = 'click' group by all",
    "user_coupon_use_1d": """select o_custkey, round(l_discount * 100)::int as coupon_id, cast(o_orderdate as date) as dt, count(distinct l_orderkey) as used_count,
  cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2))) as double) as reduce_amount from lineitem join orders on l_orderkey = o_orderkey where l_discount > 0 group by all""",
    "sku_favourite_1d": f"with {_V}, f as (select item, dt, count(*) as favourites from v where kind = 'signup' group by all) select f.*, p_brand, p_type from f left join part on p_partkey = item",
    "session_page_view_1d": f"with {_V} select user_id, dt, sum(dwell)::bigint as dwell_seconds, count(*) as pages from w group by all",
    "visitor_page_view_1d": f"with {_V} select user_id, kind as page, dt, sum(dwell)::bigint as dwell_seconds, count(*) as views from w group by all",
    "item_full_day": f"""with {_V} select item, dt, count(*) filter (kind = 'view') as visits, count(distinct user_id) filter (kind = 'view') as visitors, coalesce(sum(dwell) filter (kind = 'view'), 0)::bigint as dwell_seconds,
  count(*) filter (kind = 'view' and dwell < {BOUNCE}) as bounces, count(distinct user_id) filter (kind = 'view' and dwell >= {BOUNCE}) as detail_visitors, count(*) filter (kind = 'signup') as favourites,
  count(*) filter (kind = 'signup') - count(*) filter (kind = 'error') as net_favourites, count(*) filter (kind = 'click') as cart_adds, count(distinct user_id) filter (kind = 'click') as cart_users,
  count(*) filter (kind = 'purchase') as payments, cast(coalesce(sum(amount) filter (kind = 'purchase'), 0) as double) as pay_amount from w group by 1, 2""",
    "activity_effect_1d": """select round(l_tax * 100)::int as activity_id, cast(o_orderdate as date) as dt, count(distinct l_partkey) as items, count(distinct o_custkey) as users, count(distinct l_orderkey) as orders,
  count(distinct l_orderkey) filter (o_orderstatus = 'F') as payments, count(*) filter (l_returnflag = 'R') as refunds, cast(coalesce(sum(cast(l_extendedprice as decimal(18,2))) filter (l_returnflag = 'R'), 0) as double) as refund_amount
from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""",
    "user_week_month": """with o as (select o_custkey, cast(o_orderdate as date) as dt, cast(o_totalprice as decimal(18,2)) as amount from orders),
b as (select o_custkey, dt, lag(dt) over (partition by o_custkey order by dt) as before from (select distinct o_custkey, dt from o)),
f as (select o.*, (before is null or dt - before > 365)::int as is_new from o join b using (o_custkey, dt)),
p as (select *, 'week' as period, (isoyear(dt) * 100 + weekofyear(dt))::int as period_key from f union all select *, 'month', (year(dt) * 100 + month(dt))::int from f)
select o_custkey, period, period_key, count(*) as orders, cast(sum(amount) as double) as amount, arg_min(is_new, dt) as is_new_buyer from p group by all""",
    "item_overview": f"""with {_V}, {_D}, s as (select item as p_partkey, count(distinct user_id) as visitors from v group by 1),
l as (select l_partkey as p_partkey, count(distinct l_orderkey) as orders, count(distinct o_custkey) as buyers, sum(original) as amount, sum(original) filter (year(dt) = year(today)) as ytd, coalesce(sum(original) filter (l_returnflag = 'R'), 0) as refund from d, today group by 1)
select p_partkey, coalesce(visitors, 0) as visitors, coalesce(buyers, 0) as buyers, coalesce(orders, 0) as orders, cast(coalesce(amount, 0) as double) as amount, cast(coalesce(ytd, 0) as double) as amount_ytd,
  coalesce(cast(amount as double) / orders, 0) as mean_order_value, coalesce(cast(coalesce(amount, 0) as double) / visitors, 0) as visitor_value, coalesce(cast(refund as double) / cast(amount as double), 0) as refund_rate
from part left join l using (p_partkey) left join s using (p_partkey)""",
    "item_band_sales": f"""with {_D}, f as (select o_custkey, min(dt) as first_day from d group by 1)
select case when p_retailprice < 950 then 'low' when p_retailprice < 1200 then 'middle' else 'high' end as band, count(distinct l_partkey) as sold_items, cast(sum(original) as double) as amount, sum(l_quantity) as quantity,
  count(distinct o_custkey) filter (first_day > today - 365) as new_buyers, round(cast(sum(original) as double) / sum(l_quantity), 2) as mean_price
from d join f using (o_custkey) join part on l_partkey = p_partkey, today where dt > today - 365 and dt <= today group by 1""",
    "product_full_day": f"with {_V}, m as (select item, dt, {_MEASURES} from w group by all) select *, {_RATES} from m",
    "product_source_day": f"""with {_V}, m as (select item, dt, case when user_id % 10 < 4 then 0 when user_id % 10 < 6 then 1 when user_id % 10 < 8 then 2 when user_id % 10 < 9 then 3 else 4 end as source_id, {_MEASURES} from w group by all)
select m.* exclude (source_id), r_name as source, {_RATES} from m left join region on r_regionkey = source_id""",
    "product_sku_day": f"""with {_D} select p_brand, l_partkey, dt, count(*) as lines, count(distinct o_custkey) as buyers, cast(coalesce(sum(original) filter (l_returnflag <> 'R'), 0) as double) as kept_amount,
  cast(coalesce(sum(original) filter (l_returnflag = 'R'), 0) as double) as refund_amount from d join part on l_partkey = p_partkey group by all""",
    "page_visits_ranked": f"with {_V}, p as (select dt, kind as page, count(*) as visits, count(distinct user_id) as visitors, sum(dwell) as stay from w group by all) select dt, page, visits, visitors, round(stay / visits, 2) as mean_stay, (rank() over (partition by dt order by visits desc))::int as rk from p",
    "page_jumps": f"""with {_V}, s as (select user_id, kind as source, lead(kind) over (partition by user_id order by ts, event_id) as target, max((kind = 'purchase')::int) over (partition by user_id, dt) as bought from v)
select source, target, count(*) as jumps, count(distinct user_id) as visitors, count(distinct user_id) filter (bought = 1) as ordering_visitors from s where target is not null group by all""",
    "shop_conversion": f"""with {_V}, p as (select dt, count(distinct user_id) filter (kind = 'view') as c, count(distinct user_id) filter (kind = 'click') as o, count(distinct user_id) filter (kind = 'purchase') as p, count(*) filter (kind = 'purchase') as n, sum(amount) filter (kind = 'purchase') as amount from v group by 1)
select dt, round(coalesce(o / nullif(c, 0), 0), 4) as consult_to_ordered, round(coalesce(p / nullif(c, 0), 0), 4) as consult_to_paid, round(coalesce(p / nullif(o, 0), 0), 4) as ordered_to_paid, round(coalesce(cast(amount as double) / nullif(n, 0), 0), 2) as mean_payment from p""",
    "consult_order_pay": f"""with {_V}, c as (select user_id, item, min(ts) filter (kind = 'view') as c, min(ts) filter (kind = 'click') as o, min(ts) filter (kind = 'purchase') as p from v group by all)
select cast(c as date) as dt, count(*) as consulted, count(*) filter (o >= c) as ordered, count(*) filter (o >= c and p >= o) as paid from c where c is not null group by 1""",
    "order_event_types": """with l as (select distinct l_orderkey from lineitem where l_returnflag = 'R')
select case when l_orderkey is not null then 'refund' when o_orderstatus = 'F' then 'payment' else 'order' end as event_type, cast(o_orderdate as date) as dt, count(*) as n from orders left join l on l_orderkey = o_orderkey group by all""",
    "customers_inserted": """with h as (select distinct o_custkey as c_custkey from orders where cast(o_orderdate as date) > (select max(cast(o_orderdate as date)) from orders) - 365)
select c_custkey, 'orders' as origin from h union all select c_custkey, 'customer' from customer where c_custkey not in (select c_custkey from h)""",
    "lines_by_category": "select p_type, count(*) as lines from lineitem join part on l_partkey = p_partkey group by 1",
    "sample_customers": "select distinct o_custkey from orders order by 1 limit 100",
    "ship_days": "select cast(l_shipdate as date) as dt, count(*) as lines, (row_number() over (order by cast(l_shipdate as date)))::int as nth from lineitem group by 1 order by 1",
    "top_names": f"{_NAMES} select name, count(*) as sentences from mentions group by 1 order by sentences desc, name limit 20",
    "top_edges": f"{_NAMES} select l.name as a, r.name as b, count(*) as weight from mentions l join mentions r on l.doc_id = r.doc_id and l.nth = r.nth and l.name < r.name group by all order by weight desc, a, b limit 20",
    "table_rows": " union all ".join(f"select '{t}' as name, count(*) as n_rows from {t}" for t in TABLES),
    "brand_price_leaders": "select p_brand, p_partkey, p_retailprice, (rank() over (partition by p_brand order by p_retailprice desc))::int as rk from part qualify rk <= 3",
}
