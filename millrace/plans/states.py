"""Metrics of the last days and to date, built on stored states of days; and zipper tables over all days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.daystates import day_rows, interval_states, roll_forward, store_days, stored_days
from millrace.operators.loads import versions_of_runs
from millrace.operators.ranking import ranks_at_once
from millrace.plans.trade import _DETAIL, ORACLE as TRADE
from millrace.plans.trade import order_lines, part_sales
from millrace.sources.scratch import scratch_folder, stored
from millrace.sources.tables import load, money

INTERVALS = (1, 7, 30)


def _newest_order_day(spark: SparkSession, sf_dir: str) -> date:
    return load(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate"))).first()[0] or date(1970, 1, 1)


def _key_states(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Orders and users of the last 1, 7 and 30 days.

    The days are stored as by 30 daily runs; an order has one day, so orders are
    added, and users are sets.
    """
    last, path = _newest_order_day(spark, sf_dir), scratch_folder(spark)
    lines = order_lines(spark, sf_dir).where(F.col("dt") > F.lit(last - timedelta(30)))
    part = load(spark, sf_dir, "part").select("p_partkey", key)
    once = lines.join(part, lines.l_partkey == part.p_partkey).select(key, "l_orderkey", "o_custkey", "dt").distinct()
    store_days(day_rows(once, [key], "dt", {"order_count": F.count(F.lit(1))}, "o_custkey"), path)
    return interval_states(stored_days(spark, path, last, 30), [key], ["order_count"], last, INTERVALS, "order_user_count")


def brand_states_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_states(spark, sf_dir, "p_brand")


def category_states_1_7_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_states(spark, sf_dir, "p_type")


def user_order_td_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last order day, orders and amount to date: the state of 30 days ago, rolled forward over stored days in three runs."""
    last, path = _newest_order_day(spark, sf_dir), scratch_folder(spark)
    start = last - timedelta(30)
    facts = order_lines(spark, sf_dir).groupBy("o_custkey", "dt").agg(F.count_distinct("l_orderkey").alias("order_count_td"), F.sum("original").alias("original_amount_td"))
    facts = facts.withColumns({"order_date_first": F.col("dt"), "order_date_last": F.col("dt")})
    merges = {"order_date_first": "min", "order_date_last": "max", "order_count_td": "sum", "original_amount_td": "sum"}
    state = stored(roll_forward(facts.where(F.col("dt") <= F.lit(start)).limit(0), facts.where(F.col("dt") <= F.lit(start)), ["o_custkey"], merges))
    store_days(facts.where(F.col("dt") > F.lit(start)), path)
    for days in (20, 9, 1):
        start += timedelta(days)
        state = stored(roll_forward(state, stored_days(spark, path, start, days), ["o_custkey"], merges))
    return state.withColumn("original_amount_td", F.col("original_amount_td").cast("double"))


def user_active_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active users per kind over the last 1, 7 and 30 days of the events, and their events."""
    events, path = load(spark, sf_dir, "events").withColumn("dt", F.to_date("ts")), scratch_folder(spark)
    last = events.agg(F.max("dt")).first()[0] or date(1970, 1, 1)
    store_days(day_rows(events, ["event_type"], "dt", {"events": F.count(F.lit(1))}, "user_id"), path)
    return interval_states(stored_days(spark, path, last, 30), ["event_type"], ["events"], last, INTERVALS, "users")


def customer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's states (the status of the day's last order) as versions over all days, in one pass."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("dt"))
    return versions_of_runs(orders, ["o_custkey"], ["status"], "dt", ["o_orderkey"])


def customer_versions_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of versions and changes that come late: every fifth order arrives after all others, whatever its day."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("dt"))
    late = F.col("o_orderkey") % 5 == 0
    kept = stored(orders.where(~late))
    return versions_of_runs(kept.unionByName(orders.where(late)), ["o_custkey"], ["status"], "dt", ["o_orderkey"])


def product_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's rank by orders, pieces, amount and buyers, over all parts, from one pass."""
    per = part_sales(spark, sf_dir, {"pieces": F.col("l_quantity"), "amount": F.col("original")})
    return ranks_at_once(stored(per), ["l_partkey"], {"orders": "rk_orders", "pieces": "rk_pieces", "amount": "rk_amount", "buyers": "rk_buyers"}).select("l_partkey", "orders", "buyers", "rk_orders", "rk_pieces", "rk_amount", "rk_buyers")


def user_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' ranks by orders and by amount within their nation."""
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum(money("o_totalprice")).alias("amount"))
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_nationkey", "orders", "amount")
    return ranks_at_once(stored(rows), ["c_custkey"], {"orders": "rk_orders", "amount": "rk_amount"}, within=["c_nationkey"]).select("c_custkey", "c_nationkey", "rk_orders", "rk_amount")


QUERIES = {f.__name__: f for f in (brand_states_1_7_30, category_states_1_7_30, user_order_td_states, user_active_weeks, customer_versions, customer_versions_late, product_ranks, user_ranks)}

_VERSIONS = """with d as (select o_custkey, o_orderstatus as status, cast(o_orderdate as date) as dt from orders qualify row_number() over (partition by o_custkey, cast(o_orderdate as date) order by o_orderkey desc) = 1),
c as (select *, lag(status) over (partition by o_custkey order by dt) as before from d)
select o_custkey, status, dt as start_date, coalesce(lead(dt) over (partition by o_custkey order by dt) - 1, date '9999-12-31') as end_date from c where before is distinct from status"""

ORACLE = {
    "brand_states_1_7_30": TRADE["brand_stats_1_7_30"],
    "category_states_1_7_30": TRADE["category_stats_1_7_30"],
    "user_order_td_states": TRADE["user_order_td"],
    "user_active_weeks": "with t as (select max(cast(ts as date)) as d from events) select n::int as recent_days, event_type, count(*) as events, count(distinct user_id) as users from events, t, (values (1), (7), (30)) as i(n) where cast(ts as date) > d - n group by all",
    "customer_versions": _VERSIONS,
    "customer_versions_late": _VERSIONS,
    "product_ranks": f"""with {_DETAIL}, p as (select l_partkey, count(distinct l_orderkey) as orders, sum(l_quantity) as pieces, sum(original) as amount, count(distinct o_custkey) as buyers from detail group by 1)
select l_partkey, orders, buyers, (rank() over (order by orders desc))::int as rk_orders, (rank() over (order by pieces desc))::int as rk_pieces, (rank() over (order by amount desc))::int as rk_amount, (rank() over (order by buyers desc))::int as rk_buyers from p""",
    "user_ranks": """with o as (select o_custkey, count(*) as orders, sum(cast(o_totalprice as decimal(18,2))) as amount from orders group by 1)
select c_custkey, c_nationkey, (rank() over (partition by c_nationkey order by orders desc nulls last))::int as rk_orders, (rank() over (partition by c_nationkey order by amount desc nulls last))::int as rk_amount from customer left join o on o_custkey = c_custkey""",
}
