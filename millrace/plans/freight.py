"""Logistics summaries by stage, organ, city, province, shift, line and truck.

Lines of orders play cargo. A line is received on its order's day, sorted and
dispatched on its ship day, delivered on that day once its status is F. A line
of status F is a finished trip: its quantity plays the kilometres, the days from
order to shipment its duration. Every n-day summary is a sum of the 1-day rows of
the last n days; the test for the longest interval comes first, so that it
reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.aggregates import cumulative, dealt, full_outer, interval_rows, merge_sides, ratio, within_days
from millrace.plans.logistics import organ_dim
from millrace.plans.trade import business_date, line_count, with_orders
from millrace.sources.tables import load, money

#: A trip that takes longer is late.
PLANNED_SECONDS = 60 * 86_400
#: stage: (condition on the line, its day)
STAGES = {
    "dispatched": ("true", "shipped"),
    "delivered": ("l_linestatus = 'F'", "shipped"),
    "received": ("true", "ordered"),
    "sorted": ("l_returnflag = 'N'", "shipped"),
}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("organ_id"), "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", F.to_date("l_shipdate").alias("shipped"), money("l_extendedprice").alias("amount"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("line"), F.to_date("o_orderdate").alias("ordered"))
    return with_orders(lines, orders, line_count(spark, sf_dir))


def _stage(spark: SparkSession, sf_dir: str, stage: str, since: Column | None = None) -> DataFrame:
    """(organ_id, dt, order_count, order_amount): orders of the stage, each counted once a day with its largest amount."""
    where, day = STAGES[stage]
    rows = _lines(spark, sf_dir).where(where).withColumn("dt", F.col(day))
    rows = rows.where(since) if since is not None else rows
    once = dealt(rows, line_count(spark, sf_dir), "organ_id", "dt").groupBy("organ_id", "dt", "l_orderkey").agg(F.max("amount").alias("amount"))
    return once.groupBy("organ_id", "dt").agg(F.count(F.lit(1)).alias("order_count"), F.sum("amount").alias("order_amount"))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("order_amount", F.col("order_amount").cast("double"))


def _named(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    organ = organ_dim(spark, sf_dir).select("organ_id", "city", "province")
    return df.join(organ, "organ_id", "left")


def _stage_nd(spark: SparkSession, sf_dir: str, stage: str, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(organ_id, recent_days, order_count, order_amount) from the stage's 1-day rows."""
    today = business_date(spark, sf_dir)
    rows = _stage(spark, sf_dir, stage, within_days("dt", today, max(days)))
    return interval_rows(rows, "dt", today, days).groupBy("organ_id", "recent_days").agg(F.sum("order_count").alias("order_count"), F.sum("order_amount").alias("order_amount"))


def bound_finish_td(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered orders per organ to date: the rows before the newest day, and that day's."""
    today = business_date(spark, sf_dir)
    rows = _stage(spark, sf_dir, "delivered").where(F.col("dt") <= today)
    part = lambda where: rows.where(where).groupBy("organ_id").agg(F.sum("order_count").alias("order_count"), F.sum("order_amount").alias("order_amount"))
    return _shown(cumulative(part(F.col("dt") < today), part(F.col("dt") == today), ["organ_id"]))


def dispatch_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_stage(spark, sf_dir, "dispatched"))


def dispatch_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_stage_nd(spark, sf_dir, "dispatched"))


def organ_delivered_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_named(spark, sf_dir, _stage(spark, sf_dir, "delivered")))


def organ_delivered_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_named(spark, sf_dir, _stage_nd(spark, sf_dir, "delivered")))


def organ_received_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_named(spark, sf_dir, _stage(spark, sf_dir, "received")))


def organ_received_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_named(spark, sf_dir, _stage_nd(spark, sf_dir, "received")))


def _by_level(spark: SparkSession, sf_dir: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """Organs of level 1 stand for themselves, of level 2 for their city; even and odd keys play the levels."""
    organ = organ_dim(spark, sf_dir)
    place = F.when(F.col("organ_id") % 2 == 0, F.concat(F.lit("organ "), F.col("organ_id").cast("string"))).otherwise(F.col("city"))
    named = df.join(organ.select("organ_id", place.alias("place")), "organ_id", "left")
    return _shown(named.groupBy("place", *keys).agg(F.sum("order_count").alias("order_count"), F.sum("order_amount").alias("order_amount")))


def organ_sorted_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_level(spark, sf_dir, _stage(spark, sf_dir, "sorted"), ["dt"])


def organ_sorted_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_level(spark, sf_dir, _stage_nd(spark, sf_dir, "sorted"), ["recent_days"])


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished trips with km, seconds, shift (the part's brand) and truck_type (its type)."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("shift"), F.col("p_type").alias("truck_type"))
    done = _lines(spark, sf_dir).where("l_linestatus = 'F'").withColumn("dt", F.col("shipped")).withColumn("km", F.col("l_quantity")).withColumn("seconds", F.datediff("shipped", "ordered").cast("long") * 86_400)
    return done.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")


def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("trips"), F.sum("km").alias("km"), F.sum("seconds").alias("seconds")]


def truck_transport_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips(spark, sf_dir).groupBy("organ_id", "truck_type", "dt").agg(*_measures())


def _trips_nd(spark: SparkSession, sf_dir: str, days: tuple[int, ...]) -> DataFrame:
    today = business_date(spark, sf_dir)
    return interval_rows(_trips(spark, sf_dir).where(within_days("dt", today, max(days))), "dt", today, days)


def shift_transport_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips, km, seconds, orders and late trips per shift and line for the last 7 and 30 days."""
    late = F.count_if(F.col("seconds") > PLANNED_SECONDS).alias("late_trips")
    return _trips_nd(spark, sf_dir, (7, 30)).groupBy("shift", "line", "recent_days").agg(*_measures(), F.count_distinct("l_orderkey").alias("orders"), late)


def transport_totals_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips_nd(spark, sf_dir, (1, 7, 30)).groupBy("recent_days").agg(*_measures())


def orders_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their amount by interval; days are summed before they are dealt to intervals."""
    today = business_date(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("dt"), money("o_totalprice").alias("amount")).where(within_days("dt", today, 30))
    per_day = orders.groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return interval_rows(per_day, "dt", today, (1, 7, 30)).groupBy("recent_days").agg(F.sum("n").alias("order_count"), F.sum("amount").cast("double").alias("order_amount"))


def _stats(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Orders and trips of a place; a place of either side has a row, with means of the trips."""
    organ = organ_dim(spark, sf_dir).select("organ_id", F.col("organ_id").cast("string").alias("organ"), "city").select("organ_id", F.col(key).alias(key))
    orders = _stage_nd(spark, sf_dir, "received", (1, 7, 30)).join(organ, "organ_id").groupBy(key, "recent_days").agg(F.sum("order_count").alias("order_count"), F.sum("order_amount").cast("double").alias("order_amount"))
    trips = _trips_nd(spark, sf_dir, (1, 7, 30)).join(organ, "organ_id").groupBy(key, "recent_days").agg(*_measures())
    both = full_outer(orders, trips, [key, "recent_days"], {"order_count": 0, "order_amount": 0.0, "trips": 0, "km": 0.0, "seconds": 0})
    return both.select("*", ratio(F.col("km"), F.col("trips"), 2).alias("mean_km"), ratio(F.col("seconds"), F.col("trips"), 2).alias("mean_seconds"))


def city_stats_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, "city")


def organ_stats_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, "organ")


def _trip_report(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return _trips_nd(spark, sf_dir, (1, 7, 30)).groupBy(key, "recent_days").agg(*_measures(), F.count_distinct("l_orderkey").alias("orders"))


def shift_stats_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trip_report(spark, sf_dir, "shift")


def line_stats_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trip_report(spark, sf_dir, "line")


def truck_stats_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trip_report(spark, sf_dir, "truck_type")


def _express(spark: SparkSession, sf_dir: str, key: str | None) -> DataFrame:
    """Received, sorted and delivered orders of a level in one row, 0 where a side has none."""
    keys = ([key] if key else []) + ["recent_days"]
    organ = organ_dim(spark, sf_dir).select("organ_id", F.col("organ_id").cast("string").alias("organ"), "city", "province")

    def side(stage: str) -> DataFrame:
        rows = _stage_nd(spark, sf_dir, stage, (1, 7, 30))
        return (rows.join(organ, "organ_id") if key else rows).groupBy(*keys).agg(F.sum("order_count").alias(stage))

    return merge_sides([side(s) for s in ("received", "sorted", "delivered")], keys).fillna(0, ["received", "sorted", "delivered"])


def express_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _express(spark, sf_dir, None)


def express_by_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _express(spark, sf_dir, "province")


def express_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _express(spark, sf_dir, "city")


def express_by_organ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _express(spark, sf_dir, "organ")


QUERIES = {
    f.__name__: f
    for f in (
        bound_finish_td,
        dispatch_1d,
        dispatch_nd,
        organ_delivered_1d,
        organ_delivered_nd,
        organ_received_1d,
        organ_received_nd,
        organ_sorted_1d,
        organ_sorted_nd,
        truck_transport_1d,
        shift_transport_nd,
        transport_totals_1_7_30,
        orders_1_7_30,
        city_stats_1_7_30,
        organ_stats_1_7_30,
        shift_stats_1_7_30,
        line_stats_1_7_30,
        truck_stats_1_7_30,
        express_totals,
        express_by_province,
        express_by_city,
        express_by_organ,
    )
}

_BASE = """
base as (select l_orderkey, l_suppkey as organ_id, l_partkey, l_returnflag, l_linestatus, l_quantity, cast(l_shipdate as date) as shipped,
    cast(l_extendedprice as decimal(18,2)) as amount, o_orderpriority as line, cast(o_orderdate as date) as ordered
  from lineitem join orders on l_orderkey = o_orderkey),
today as (select max(cast(o_orderdate as date)) as d from orders),
organs as (select s_suppkey as organ_id, s_suppkey::varchar as organ, n_name as city, r_name as province,
    case when s_suppkey % 2 = 0 then 'organ ' || s_suppkey else n_name end as place
  from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey),
trips as (select base.*, shipped as dt, l_quantity as km, (shipped - ordered) * 86400 as seconds, p_brand as shift, p_type as truck_type
  from base left join part on l_partkey = p_partkey where l_linestatus = 'F')
"""


def _stage_sql(stage: str) -> str:
    where, day = STAGES[stage]
    return f"{stage} as (select organ_id, dt, count(*) as order_count, sum(amount) as order_amount from (select organ_id, {day} as dt, l_orderkey, max(amount) as amount from base where {where} group by all) group by all)"


def _days_sql(days: tuple[int, ...]) -> str:
    values = ", ".join(f"({n})" for n in days)
    return f"(values {values}) as t(recent_days)"


def _nd_sql(source: str, days: tuple[int, ...]) -> str:
    return f"(select {source}.*, recent_days::int as recent_days from {source}, today, {_days_sql(days)} where dt > d - recent_days::int and dt <= d)"


_SUMS = "sum(order_count)::bigint as order_count, cast(sum(order_amount) as double) as order_amount"
_TRIP_SUMS = "count(*) as trips, sum(km) as km, sum(seconds)::bigint as seconds"


def _stats_sql(key: str) -> str:
    return f"""with {_BASE}, {_stage_sql("received")},
o as (select {key}, recent_days, {_SUMS} from {_nd_sql("received", (1, 7, 30))} join organs using (organ_id) group by all),
t as (select {key}, recent_days, {_TRIP_SUMS} from {_nd_sql("trips", (1, 7, 30))} join organs using (organ_id) group by all)
select {key}, recent_days, coalesce(order_count, 0) as order_count, coalesce(order_amount, 0) as order_amount, coalesce(trips, 0) as trips, coalesce(km, 0) as km, coalesce(seconds, 0) as seconds,
  round(coalesce(km / trips, 0), 2) as mean_km, round(coalesce(seconds / trips, 0), 2) as mean_seconds
from o full join t using ({key}, recent_days)"""


def _report_sql(key: str) -> str:
    return f"with {_BASE} select {key}, recent_days, {_TRIP_SUMS}, count(distinct l_orderkey) as orders from {_nd_sql('trips', (1, 7, 30))} group by all"


def _express_sql(key: str | None) -> str:
    keys = f"{key}, recent_days" if key else "recent_days"
    sides = " union all ".join(f"select {keys}, '{s}' as side, order_count from {_nd_sql(s, (1, 7, 30))}" + (" join organs using (organ_id)" if key else "") for s in ("received", "sorted", "delivered"))
    sums = ", ".join(f"coalesce(sum(order_count) filter (side = '{s}'), 0)::bigint as {s}" for s in ("received", "sorted", "delivered"))
    return f"with {_BASE}, {', '.join(_stage_sql(s) for s in ('received', 'sorted', 'delivered'))}, u as ({sides}) select {keys}, {sums} from u group by all"


def _named_sql(stage: str, days: tuple[int, ...] | None) -> str:
    source, key = (_nd_sql(stage, days), "recent_days") if days else (stage, "dt")
    return f"with {_BASE}, {_stage_sql(stage)} select organ_id, city, province, {key}, {_SUMS} from {source} left join organs using (organ_id) group by all"


def _place_sql(days: tuple[int, ...] | None) -> str:
    source, key = (_nd_sql("sorted", days), "recent_days") if days else ("sorted", "dt")
    return f"with {_BASE}, {_stage_sql('sorted')} select place, {key}, {_SUMS} from {source} left join organs using (organ_id) group by all"


ORACLE = {
    "bound_finish_td": f"with {_BASE}, {_stage_sql('delivered')} select organ_id, {_SUMS} from delivered, today where dt <= d group by 1",
    "dispatch_1d": f"with {_BASE}, {_stage_sql('dispatched')} select organ_id, dt, order_count, cast(order_amount as double) as order_amount from dispatched",
    "dispatch_nd": f"with {_BASE}, {_stage_sql('dispatched')} select organ_id, recent_days, {_SUMS} from {_nd_sql('dispatched', (7, 30))} group by all",
    "organ_delivered_1d": _named_sql("delivered", None),
    "organ_delivered_nd": _named_sql("delivered", (7, 30)),
    "organ_received_1d": _named_sql("received", None),
    "organ_received_nd": _named_sql("received", (7, 30)),
    "organ_sorted_1d": _place_sql(None),
    "organ_sorted_nd": _place_sql((7, 30)),
    "truck_transport_1d": f"with {_BASE} select organ_id, truck_type, dt, {_TRIP_SUMS} from trips group by all",
    "shift_transport_nd": f"with {_BASE} select shift, line, recent_days, {_TRIP_SUMS}, count(distinct l_orderkey) as orders, count(*) filter (seconds > {PLANNED_SECONDS}) as late_trips from {_nd_sql('trips', (7, 30))} group by all",
    "transport_totals_1_7_30": f"with {_BASE} select recent_days, {_TRIP_SUMS} from {_nd_sql('trips', (1, 7, 30))} group by all",
    "orders_1_7_30": f"""with today as (select max(cast(o_orderdate as date)) as d from orders)
select recent_days::int as recent_days, count(*) as order_count, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as order_amount
from orders, today, {_days_sql((1, 7, 30))} where cast(o_orderdate as date) > d - recent_days::int and cast(o_orderdate as date) <= d group by 1""",
    "city_stats_1_7_30": _stats_sql("city"),
    "organ_stats_1_7_30": _stats_sql("organ"),
    "shift_stats_1_7_30": _report_sql("shift"),
    "line_stats_1_7_30": _report_sql("line"),
    "truck_stats_1_7_30": _report_sql("truck_type"),
    "express_totals": _express_sql(None),
    "express_by_province": _express_sql("province"),
    "express_by_city": _express_sql("city"),
    "express_by_organ": _express_sql("organ"),
}
