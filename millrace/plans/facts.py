"""Logistics facts over orders and lines. The status O, P, F plays the stages, lines play cargo, parts play shifts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.facts import order_details, process_first, stage_daily, stage_first, station_fact, transport_finish
from millrace.sources.tables import load, money

STAGES = ["O", "P", "F"]
NAMES = ["placed", "part_shipped", "finished"]


def _cargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_linenumber", "l_partkey", F.col("l_suppkey").alias("organ_id"), "l_returnflag", "l_linestatus", money("l_extendedprice").alias("amount"), "l_shipdate")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), "o_orderdate")


def _per_stage(build) -> DataFrame:
    parts = [build(at).withColumn("stage", F.lit(name)) for at, name in enumerate(NAMES)]
    return reduce(DataFrame.unionByName, parts)


def stage_facts_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and amount per stage, cargo type and day of its first load; placed on the order's day, later stages on the line's."""
    details = order_details(_cargo(spark, sf_dir), _orders(spark, sf_dir), "order_id")
    facts = _per_stage(lambda at: stage_first(details, "status", STAGES, at, F.col("l_shipdate") if at else F.col("o_orderdate")))
    return facts.groupBy("stage", "l_returnflag", "dt").agg(F.count(F.lit(1)).alias("lines"), F.sum("amount").cast("double").alias("amount"))


def stage_facts_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that reached each stage on the newest order day.

    Older orders count as placed on the day before; those with a line shipped
    on that day have their status of the table since.
    """
    orders = _orders(spark, sf_dir).withColumn("day", F.to_date("o_orderdate"))
    today = F.lit(orders.agg(F.max("day")).first()[0])
    columns = ["order_id", "status"]
    placed = orders.where(F.col("day") < today).select("order_id", F.lit("O").alias("status"))
    new = orders.where(F.col("day") == today).select(*columns)
    shipped = load(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= today) & (F.col("l_shipdate") < F.date_add(today, 1))).select(F.col("l_orderkey").alias("order_id"))
    changed = orders.select(*columns).join(shipped, "order_id", "left_semi")
    return _per_stage(lambda at: stage_daily(placed, new, changed, "order_id", "status", STAGES, at, today))


def order_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulating process: finished orders end with their last shipment, others stay open."""
    last = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_shipdate").alias("last_ship"))
    details = _orders(spark, sf_dir).join(last, "order_id", "left")
    return process_first(details, "status", ["F"], F.col("o_orderdate"), F.col("last_ship")).select("order_id", "status", "start_date", "end_date")


def transport_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered lines with the time since their order; a part's size is its planned number of days."""
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    lines = order_details(_cargo(spark, sf_dir), _orders(spark, sf_dir), "order_id")
    tasks = lines.select("order_id", "l_linenumber", F.col("l_partkey").alias("shift_id"), millis("o_orderdate").alias("start"), F.when(F.col("l_linestatus") == "F", millis("l_shipdate")).alias("end"))
    shifts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("shift_id"), F.col("p_size").alias("estimated_time"))
    done = transport_finish(tasks, shifts, "shift_id", "start", "end")
    return done.select("order_id", "l_linenumber", "shift_id", "finish_dur_sec", "estimate_end_time", "dt")


def station_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in, sorted and out per organ and day: in with the order, sorted once delivered, out if not returned."""
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    lines = order_details(_cargo(spark, sf_dir), _orders(spark, sf_dir), "order_id")
    bounds = lines.select(
        "organ_id",
        millis("o_orderdate").cast("string").alias("inbound"),
        F.when(F.col("l_linestatus") == "F", millis("l_shipdate")).cast("string").alias("sort"),
        F.when(F.col("l_returnflag") != "R", millis("l_shipdate")).cast("string").alias("outbound"),
    )
    steps = [station_fact(bounds, step, "organ_id", ["organ_id"]).withColumn("step", F.lit(step)) for step in ("inbound", "sort", "outbound")]
    return reduce(DataFrame.unionByName, steps).groupBy("step", "organ_id", "dt").agg(F.count(F.lit(1)).alias("lines"))


QUERIES = {f.__name__: f for f in (stage_facts_first, stage_facts_daily, order_process, transport_finished, station_facts)}

_L = "l as (select *, cast(l_shipdate as date) as ship, cast(o_orderdate as date) as day, cast(l_extendedprice as decimal(18,2)) as amt from lineitem join orders on l_orderkey = o_orderkey)"
ORACLE = {
    "stage_facts_first": f"""with {_L}, f as (
  select 'placed' as stage, l_returnflag, day as dt, amt from l
  union all select 'part_shipped', l_returnflag, ship, amt from l where o_orderstatus in ('P', 'F')
  union all select 'finished', l_returnflag, ship, amt from l where o_orderstatus = 'F')
select stage, l_returnflag, dt, count(*) as lines, cast(sum(amt) as double) as amount from f group by all""",
    "stage_facts_daily": """with t as (select max(cast(o_orderdate as date)) as d from orders),
o as (select o_orderkey as order_id, o_orderstatus as status, cast(o_orderdate as date) as day, d from orders, t),
c as (select * from o where day = d or order_id in (select l_orderkey from lineitem, t where cast(l_shipdate as date) = d))
select order_id, status, d as dt, 'placed' as stage from o where day = d
union all select order_id, status, d, 'part_shipped' from c where status in ('P', 'F')
union all select order_id, status, d, 'finished' from c where status = 'F'""",
    "order_process": "select o_orderkey as order_id, o_orderstatus as status, cast(o_orderdate as date) as start_date, case when o_orderstatus = 'F' then cast(max(l_shipdate) as date) else date '9999-12-31' end as end_date from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus, o_orderdate",
    "transport_finished": f"with {_L} select l_orderkey as order_id, l_linenumber, l_partkey as shift_id, (epoch_ms(l_shipdate) - epoch_ms(o_orderdate)) // 1000 as finish_dur_sec, p_size as estimate_end_time, ship as dt from l left join part on l_partkey = p_partkey where l_linestatus = 'F'",
    "station_facts": f"""with {_L}, s as (select 'inbound' as step, l_suppkey as organ_id, day as dt from l
  union all select 'sort', l_suppkey, ship from l where l_linestatus = 'F' union all select 'outbound', l_suppkey, ship from l where l_returnflag <> 'R')
select step, organ_id, dt, count(*) as lines from s group by all""",
}
