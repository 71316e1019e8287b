"""Logistics metric queries. Suppliers play organs; nation and region are the levels above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.aggregates import cumulative, dealt, full_outer, interval_rows, ratio, within_days
from millrace.plans.trade import business_date, line_count, order_lines
from millrace.sources.tables import load, money


def organ_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """organ_id with city and province by joining up the hierarchy."""
    supplier = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("organ_id"), F.col("s_nationkey").alias("city_id"))
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city"), F.col("n_regionkey").alias("province_id"))
    region = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("province_id"), F.col("r_name").alias("province"))
    return supplier.join(nation, "city_id", "left").join(region, "province_id", "left")


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("organ_id"), "l_returnflag", "l_linestatus", "l_quantity", F.to_date("l_shipdate").alias("dt"), money("l_extendedprice").alias("amount"))


def _newest(spark: SparkSession, sf_dir: str) -> Column:
    return F.lit(load(spark, sf_dir, "lineitem").agg(F.to_date(F.max("l_shipdate"))).first()[0])


def organ_order_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organ and cargo type per day; lines are summed per order first, so that an order counts once."""
    lines = dealt(order_lines(spark, sf_dir), line_count(spark, sf_dir), "l_suppkey", "l_returnflag", "dt")
    per_order = lines.groupBy("l_suppkey", "l_returnflag", "dt", "l_orderkey").agg(F.sum("original").alias("amount"))
    per = per_order.groupBy(F.col("l_suppkey").alias("organ_id"), F.col("l_returnflag").alias("cargo_type"), "dt").agg(F.count(F.lit(1)).alias("order_count"), F.sum("amount").cast("double").alias("order_amount"))
    return per.join(organ_dim(spark, sf_dir).select("organ_id", "city"), "organ_id", "left")


def organ_order_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = business_date(spark, sf_dir)
    tagged = interval_rows(order_lines(spark, sf_dir).where(within_days("dt", today, 30)), "dt", today, (7, 30))
    return tagged.groupBy(F.col("l_suppkey").alias("organ_id"), F.col("l_returnflag").alias("cargo_type"), "recent_days").agg(F.count_distinct("l_orderkey").alias("order_count"), F.sum("original").cast("double").alias("order_amount"))


def dispatch_td(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To date = the to-date rows before the newest day, and that day's rows."""
    today = _newest(spark, sf_dir)
    shipped = _shipped(spark, sf_dir)
    summed = lambda df: df.groupBy("organ_id").agg(F.count(F.lit(1)).alias("lines_td"), F.sum("amount").alias("amount_td"))
    merged = cumulative(summed(shipped.where(F.col("dt") < today)), summed(shipped.where(F.col("dt") == today)), ["organ_id"])
    return merged.select("organ_id", "lines_td", F.col("amount_td").cast("double").alias("amount_td"))


def in_transit_td(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatched minus finished per organ, by a signed union that keeps equal rows."""
    shipped = _shipped(spark, sf_dir)
    sent = shipped.select("organ_id", F.lit(1).alias("n"), "amount")
    done = shipped.where("l_linestatus = 'F'").select("organ_id", F.lit(-1).alias("n"), (-F.col("amount")).cast("decimal(18,2)").alias("amount"))
    return sent.unionByName(done).groupBy("organ_id").agg(F.sum("n").alias("in_transit"), F.sum("amount").cast("double").alias("in_transit_amount"))


def received_dispatched_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders received and lines dispatched per interval, by a full outer join of two reports that are summed by day first."""
    newest, days = _newest(spark, sf_dir), (1, 7, 30, 365)

    def report(rows: DataFrame, name: str) -> DataFrame:
        per_day = rows.where(within_days("dt", newest, max(days))).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
        return interval_rows(per_day, "dt", newest, days).groupBy("recent_days").agg(F.sum("n").alias(name))

    orders = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("dt"))
    return full_outer(report(orders, "received"), report(_shipped(spark, sf_dir).select("dt"), "dispatched"), ["recent_days"], {"received": 0, "dispatched": 0})


def organ_stats_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City statistics of open and returned lines with means: conditional sums of one pass, by organ before the organ's city is met."""
    open_, back = F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    amount = lambda where: F.coalesce(F.sum(F.when(where, F.col("amount"))), F.lit(0))
    per = _shipped(spark, sf_dir).where(open_ | back).groupBy("organ_id").agg(F.count_if(open_).alias("open_lines"), amount(open_).alias("open_amount"), F.count_if(back).alias("returned_lines"), amount(back).alias("returned_amount"))
    named = per.join(organ_dim(spark, sf_dir).select("organ_id", "city"), "organ_id")
    total = named.groupBy("city").agg(*[F.sum(c).alias(c) for c in per.columns if c != "organ_id"])
    double = lambda c: F.col(c).cast("double").alias(c)
    return total.select("city", "open_lines", double("open_amount"), "returned_lines", double("returned_amount"), ratio(F.col("open_amount"), F.col("open_lines"), 2).alias("mean_open"))


def express_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received, delivered and returned per province: three counts of one pass instead of two full outer joins; a side without rows is null."""
    sides = {"received": F.col("l_linestatus") == "O", "delivered": F.col("l_linestatus") == "F", "returned": F.col("l_returnflag") == "R"}
    per = _shipped(spark, sf_dir).groupBy("organ_id").agg(*[F.count_if(where).alias(name) for name, where in sides.items()])
    named = per.join(organ_dim(spark, sf_dir).select("organ_id", "province"), "organ_id")
    return named.groupBy("province").agg(*[F.nullif(F.sum(name), F.lit(0)).alias(name) for name in sides])


def late_shipments_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line of business and interval: trips, orders and late trips (shipped 60 days or more after the order)."""
    newest = _newest(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("ordered"))
    trips = _shipped(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    tagged = interval_rows(trips.where(within_days("dt", newest, 365)), "dt", newest, (30, 365))
    late = F.datediff("dt", "ordered") >= 60
    return tagged.groupBy("o_orderpriority", "recent_days").agg(F.count(F.lit(1)).alias("trips"), F.count_distinct("l_orderkey").alias("orders"), F.sum(late.cast("int")).cast("long").alias("late"))


def split_share_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of two drivers count half for each: array of structs, exploded. Part and supplier keys play the drivers."""
    shipped = _shipped(spark, sf_dir)
    first, second = F.col("organ_id") % 50, F.col("l_partkey") % 50
    drivers = F.when(first == second, F.array(F.struct(first.alias("id"), F.lit(1.0).alias("part")))).otherwise(F.array(F.struct(first.alias("id"), F.lit(0.5).alias("part")), F.struct(second.alias("id"), F.lit(0.5).alias("part"))))
    rows = shipped.select(F.explode(drivers).alias("d"), "l_quantity")
    return rows.groupBy(F.col("d.id").alias("driver_id")).agg(F.sum("d.part").alias("trips"), F.sum(F.col("d.part") * F.col("l_quantity")).alias("quantity"))


def cargo_type_orders_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by cargo type and interval: the 1-day and the n-day branch are united."""
    today = business_date(spark, sf_dir)
    lines = order_lines(spark, sf_dir).where(within_days("dt", today, 30))
    one = lines.where(F.col("dt") == today).withColumn("recent_days", F.lit(1))
    many = interval_rows(lines, "dt", today, (7, 30))
    counted = lambda df: df.groupBy("recent_days", F.col("l_returnflag").alias("cargo_type")).agg(F.count_distinct("l_orderkey").alias("order_count"), F.sum("original").cast("double").alias("order_amount"))
    return counted(one).unionByName(counted(many))


def level_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organs of level 1 stand for themselves, of level 2 for their parent city (even and odd keys play the levels)."""
    organ = organ_dim(spark, sf_dir).withColumn("level", (F.col("organ_id") % 2 + 1).cast("int"))
    key = F.when(F.col("level") == 1, F.concat(F.lit("organ "), F.col("organ_id").cast("string"))).otherwise(F.col("city"))
    return organ.withColumn("place", key).groupBy("place", "level").agg(F.count(F.lit(1)).alias("organs"))


QUERIES = {
    f.__name__: f
    for f in (
        organ_order_1d,
        organ_order_nd,
        dispatch_td,
        in_transit_td,
        received_dispatched_1_7_30,
        organ_stats_full_outer,
        express_three_way,
        late_shipments_nd,
        split_share_explode,
        cargo_type_orders_1_7_30,
        level_hierarchy,
    )
}

_SHIPPED = """
shipped as (select l_orderkey, l_partkey, l_suppkey as organ_id, l_returnflag, l_linestatus, l_quantity, cast(l_shipdate as date) as dt,
    cast(l_extendedprice as decimal(18,2)) as amount from lineitem),
organ as (select s_suppkey as organ_id, n_name as city, r_name as province
  from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey),
newest as (select max(dt) as d from shipped)
"""
_DETAIL = """
detail as (select l_orderkey, l_suppkey, l_returnflag, cast(l_extendedprice as decimal(18,2)) as original, cast(o_orderdate as date) as dt
  from lineitem join orders on l_orderkey = o_orderkey),
today as (select max(cast(o_orderdate as date)) as d from orders)
"""

ORACLE = {
    "organ_order_1d": f"""with {_DETAIL}
select l_suppkey as organ_id, l_returnflag as cargo_type, dt, count(distinct l_orderkey) as order_count, cast(sum(original) as double) as order_amount, n_name as city
from detail left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey group by all""",
    "organ_order_nd": f"""with {_DETAIL}
select l_suppkey as organ_id, l_returnflag as cargo_type, recent_days::int as recent_days, count(distinct l_orderkey) as order_count, cast(sum(original) as double) as order_amount
from detail, today, (values (7), (30)) as t(recent_days) where dt > d - recent_days::int and dt <= d group by all""",
    "dispatch_td": f"with {_SHIPPED} select organ_id, count(*) as lines_td, cast(sum(amount) as double) as amount_td from shipped group by 1",
    "in_transit_td": f"with {_SHIPPED} select organ_id, (count(*) - count(*) filter (l_linestatus = 'F'))::bigint as in_transit, cast(sum(amount) - coalesce(sum(amount) filter (l_linestatus = 'F'), 0) as double) as in_transit_amount from shipped group by 1",
    "received_dispatched_1_7_30": f"""with {_SHIPPED}, n as (select unnest([1, 7, 30, 365])::int as recent_days),
r as (select recent_days, count(*) as received from orders, newest, n where cast(o_orderdate as date) > d - recent_days and cast(o_orderdate as date) <= d group by 1),
s as (select recent_days, count(*) as dispatched from shipped, newest, n where dt > d - recent_days and dt <= d group by 1)
select coalesce(r.recent_days, s.recent_days) as recent_days, coalesce(received, 0) as received, coalesce(dispatched, 0) as dispatched from r full join s on r.recent_days = s.recent_days""",
    "organ_stats_full_outer": f"""with {_SHIPPED}, j as (select * from shipped join organ using (organ_id)),
g as (select city, count(*) filter (l_linestatus = 'O') as open_lines, coalesce(sum(amount) filter (l_linestatus = 'O'), 0) as oa,
  count(*) filter (l_returnflag = 'R') as returned_lines, coalesce(sum(amount) filter (l_returnflag = 'R'), 0) as ra from j where l_linestatus = 'O' or l_returnflag = 'R' group by 1)
select city, open_lines, cast(oa as double) as open_amount, returned_lines, cast(ra as double) as returned_amount,
  case when open_lines = 0 then 0 else round(cast(oa as double) / open_lines, 2) end as mean_open from g""",
    "express_three_way": f"""with {_SHIPPED}, j as (select * from shipped join organ using (organ_id))
select province, nullif(count(*) filter (l_linestatus = 'O'), 0) as received, nullif(count(*) filter (l_linestatus = 'F'), 0) as delivered, nullif(count(*) filter (l_returnflag = 'R'), 0) as returned from j group by 1""",
    "late_shipments_nd": f"""with {_SHIPPED}
select o_orderpriority, recent_days::int as recent_days, count(*) as trips, count(distinct l_orderkey) as orders, count(*) filter (dt - cast(o_orderdate as date) >= 60) as late
from shipped join orders on l_orderkey = o_orderkey, newest, (values (30), (365)) as t(recent_days) where dt > d - recent_days::int and dt <= d group by 1, 2""",
    "split_share_explode": f"""with {_SHIPPED}, s as (
  select organ_id % 50 as id, case when organ_id % 50 = l_partkey % 50 then 1.0::double else 0.5::double end as part, l_quantity from shipped
  union all select l_partkey % 50, 0.5::double, l_quantity from shipped where organ_id % 50 <> l_partkey % 50)
select id as driver_id, sum(part) as trips, sum(part * l_quantity) as quantity from s group by 1""",
    "cargo_type_orders_1_7_30": f"""with {_DETAIL}
select recent_days::int as recent_days, l_returnflag as cargo_type, count(distinct l_orderkey) as order_count, cast(sum(original) as double) as order_amount
from detail, today, (values (1), (7), (30)) as t(recent_days) where dt > d - recent_days::int and dt <= d group by all""",
    "level_hierarchy": """select case when s_suppkey % 2 = 0 then 'organ ' || s_suppkey else n_name end as place, (s_suppkey % 2 + 1)::int as level, count(*) as organs
from supplier left join nation on s_nationkey = n_nationkey group by 1, 2""",
}
