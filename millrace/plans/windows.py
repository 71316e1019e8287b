"""Window metrics over events, as tables. Clicks play orders, purchases payments, errors refunds, and views consultations or displays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.tables import load
from millrace.streaming.events import first_visit
from millrace.streaming.metrics import displays, kind_stats, product_days, revenue, sessions, trade_stats, views_and_users


def _events(spark: SparkSession, sf_dir: str, roles: dict[str, str]) -> DataFrame:
    rows = load(spark, sf_dir, "events").where(F.col("event_type").isin(list(roles)))
    role = F.lit(None)
    for kind, name in roles.items():
        role = F.when(F.col("event_type") == kind, name).otherwise(role)
    return rows.select("event_id", "ts", "user_id", role.alias("event_type"), F.col("value").cast("decimal(18,4)").alias("amount"), F.from_json("props", "struct<k:long>")["k"].alias("sku_id"))


TRADE = {"click": "order", "purchase": "payment", "error": "refund"}


def sku_orders_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kind_stats(_events(spark, sf_dir, TRADE), "ts", ["sku_id"], "order").drop("window_end")


def sku_trade_10min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with payments and refunds of the same window; ten minutes, as the events lie far apart."""
    return trade_stats(_events(spark, sf_dir, TRADE), "ts", ["sku_id"], width="10 minutes").drop("window_end")


def area_views_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and users by area, channel (the event type) and is_new."""
    events = load(spark, sf_dir, "events").select("ts", "user_id", F.col("event_type").alias("channel"), F.to_date("ts").alias("dt"))
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n"))
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("area"))
    return views_and_users(first_visit(events, "user_id", "dt").join(users.join(nation, "n", "left"), "user_id", "left"), "ts", ["area", "channel", "is_new"]).drop("window_end")


def session_starts_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups play starts; the type of the user's event before it is the page they come from."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    starts = load(spark, sf_dir, "events").select("ts", "event_type", before.alias("last_page_id")).where("event_type = 'signup'")
    return sessions(starts, "ts", []).drop("window_end")


def item_displays_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return displays(_events(spark, sf_dir, {"view": "display", "click": "click"}), "ts", [], item="sku_id").drop("window_end")


def revenue_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revenue(_events(spark, sf_dir, {"purchase": "payment"}), "ts").drop("window_end")


def product_days_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_days(_events(spark, sf_dir, {"view": "consult", "click": "order", "purchase": "payment"}), "ts", "sku_id").drop("window_end")


QUERIES = {f.__name__: f for f in (sku_orders_10s, sku_trade_10min, area_views_10s, session_starts_10s, item_displays_10s, revenue_5min, product_days_1d)}

_E = "e as (select event_id, ts, user_id, event_type as kind, cast(value as decimal(18,4)) as amount, cast(props::json->>'k' as bigint) as sku_id from events)"


def _side(name: str, kind: str, bucket: str) -> str:
    return f"{name} as (select time_bucket(interval '{bucket}', ts) as window_start, sku_id, count(*) as {name}_ct, count(distinct user_id) as {name}_user_ct, cast(sum(amount) as double) as {name}_amount from e where kind = '{kind}' group by all)"


def _filled(name: str) -> str:
    return f"coalesce({name}_ct, 0) as {name}_ct, coalesce({name}_user_ct, 0) as {name}_user_ct, coalesce({name}_amount, 0) as {name}_amount"


_SAME = "{0}.window_start = {1}.window_start and {0}.sku_id is not distinct from {1}.sku_id"
ORACLE = {
    "sku_orders_10s": f"with {_E}, {_side('order', 'click', '10 seconds').replace('order as', 'o as', 1)} select * from o",
    "sku_trade_10min": f"""with {_E}, {_side('order', 'click', '10 minutes').replace('order as', 'o as', 1)}, {_side('payment', 'purchase', '10 minutes')}, {_side('refund', 'error', '10 minutes')}
select o.*, {_filled('payment')}, {_filled('refund')} from o left join payment on {_SAME.format('o', 'payment')} left join refund on {_SAME.format('o', 'refund')}""",
    "area_views_10s": """with v as (select ts, user_id, event_type as channel, cast(cast(ts as date) = min(cast(ts as date)) over (partition by user_id) as int) as is_new from events)
select time_bucket(interval '10 seconds', ts) as window_start, n_name as area, channel, is_new, count(*) as pv_ct, count(distinct user_id) as uv_ct
from v left join customer on c_custkey = user_id left join nation on n_nationkey = c_nationkey group by all""",
    "session_starts_10s": """with s as (select ts, event_type, lag(event_type) over (partition by user_id order by event_id) as last_page from events)
select time_bucket(interval '10 seconds', ts) as window_start, count(*) as sv_ct, count(*) filter (last_page is null) as uj_ct from s where event_type = 'signup' group by 1""",
    "item_displays_10s": f"with {_E} select time_bucket(interval '10 seconds', ts) as window_start, count(*) filter (kind = 'view') as disp_ct, count(distinct sku_id) filter (kind = 'view') as disp_sku_num from e where kind in ('view', 'click') and sku_id is not null group by 1",
    "revenue_5min": f"with {_E} select time_bucket(interval '5 minutes', ts) as window_start, cast(sum(amount) as double) as revenue, count(distinct user_id) as payers from e where kind = 'purchase' group by 1",
    "product_days_1d": f"with {_E} select time_bucket(interval '1 day', ts) as window_start, sku_id, "
    + ", ".join(f"count(*) filter (kind = '{k}') as {n}_ct, count(distinct user_id) filter (kind = '{k}') as {n}_user_ct, cast(coalesce(sum(amount) filter (kind = '{k}'), 0) as double) as {n}_amount" for k, n in (("view", "consult"), ("click", "order"), ("purchase", "payment")))
    + " from e where kind in ('view', 'click', 'purchase') group by 1, 2",
}
