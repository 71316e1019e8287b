"""Streams of the events, run to their end.

The events arrive in three batches in order of their number; every query reads
them as a stream, keeps its state over the batches and returns what its sink
holds at the end. A batch that is run again overwrites its own folder. Times of
the events have no zone; streams need instants, so they are read in the session's
zone, which is UTC for windows of a day to begin at midnight.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.lookups import interval_join, lookup, lookup_first
from millrace.sources.scratch import scratch_folder
from millrace.sources.tables import load
from millrace.sources.topics import messages, typed_topic
from millrace.streaming.changes import after_images, appends, by_table, change_records, event_time, query, routed, shaped, slim, source_tagged, united
from millrace.streaming.closed import user_windows
from millrace.streaming.events import drop_repeats, merge_parts, newest_only, parsed, split_log
from millrace.streaming.kept import first_visits_into
from millrace.streaming.metrics import product_days, revenue, trade_stats, views_and_users
from millrace.streaming.state import ROCKS

BATCHES = 3
#: Events in a file of a batch, about.
FILE_ROWS = 250_000
#: Longest wait for a stream to end, in seconds.
PATIENCE = 1800
KINDS = ("view", "click", "purchase")


def stream_session(spark: SparkSession, *, timers: bool = False, **conf: str) -> SparkSession:
    """A session of a stream's own, with the settings that matter here.

    Empty batches let watermarks close windows after the last row. State with a
    processing-time timeout would make them for ever, so `timers` is for it.
    """
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        if value := spark.conf.get(name, None):
            # A static setting can't be set again, and needn't be.
            if own.conf.isModifiable(name) or own.conf.get(name, None) is None:
                own.conf.set(name, value)
    # State lies in as many stores as there are partitions; more than there are cores only cost time.
    parts = min(int(own.conf.get("spark.sql.shuffle.partitions")), max(8, spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.shuffle.partitions", str(parts))
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false" if timers else "true")
    for name, value in conf.items():
        own.conf.set(name.replace("__", "."), value)
    return own


def arrivals(spark: SparkSession, sf_dir: str, *, closing: bool = False) -> DataFrame:
    """The events as a stream of BATCHES batches in order of event_id.

    All batches have the same number of files, as the source counts files; else
    rows of one batch would come with the next.
    With `closing` one more batch follows: a row of each kind 400 days later,
    without user or value, which lets every window before it close.
    """
    events, path = load(spark, sf_dir, "events"), scratch_folder(spark)
    cuts = events.agg(F.percentile_approx("event_id", [k / BATCHES for k in range(1, BATCHES)], 1000)).first()[0] or [0] * (BATCHES - 1)
    edges, files = [None, *cuts, None], max(1, -(-events.count() // (BATCHES * FILE_ROWS)))
    for n, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1):
        above, upto = (F.lit(True) if low is None else F.col("event_id") > low), (F.lit(True) if high is None else F.col("event_id") <= high)
        events.where(above & upto).repartition(files, "event_id").write.mode("append").parquet(path)
        # Parts without rows have no file.
        for _ in range(n * files - len(spark.read.schema(events.schema).parquet(path).inputFiles())):
            events.limit(0).write.mode("append").parquet(path)
    if closing:
        blank = {c: F.lit(None).cast(t).alias(c) for c, t in events.dtypes}
        last = events.groupBy("event_type").agg(F.max("ts").alias("ts")).withColumn("ts", F.max("ts").over(Window.partitionBy()) + F.expr("interval 400 days"))
        last.select(*[c if c in ("ts", "event_type") else blank[c] for c in events.columns]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def collected(df: DataFrame, mode: str = "append", *, into: Callable[[Callable, str], Callable] | None = None, schema: str | None = None) -> DataFrame:
    """The stream's output at its end: all batches, or in complete mode the last.

    into(put, folder) makes of each batch what put gets, of that schema, with what it keeps in a folder.
    """
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    folder = (lambda n: path) if mode == "complete" else (lambda n: f"{path}/batch={n}")
    put = lambda batch, n: batch.write.mode("overwrite").parquet(folder(n))
    run = query(df, f"{path}-state", into(put, f"{path}-kept") if into else put, mode=mode).start()
    if not run.awaitTermination(PATIENCE):
        run.stop()
        raise TimeoutError("the stream has not ended")
    return spark.read.schema(schema or df.schema).parquet(*([path] if mode == "complete" else [f"{path}/batch=*"]))


def _role(spark: SparkSession, sf_dir: str, roles: dict[str, str], **how) -> DataFrame:
    role = F.lit(None).cast("string")
    for kind, name in roles.items():
        role = F.when(F.col("event_type") == kind, name).otherwise(role)
    rows = arrivals(spark, sf_dir, **how).where(F.col("event_type").isin(list(roles)))
    return rows.select("event_id", "ts", "user_id", role.alias("event_type"), F.col("value").cast("decimal(18,4)").alias("amount"), F.from_json("props", "struct<k:long>")["k"].alias("sku_id"))


def _plain(df: DataFrame) -> DataFrame:
    """Window starts without a zone, as the tables have them."""
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).drop("window_end")


def stream_windows_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(spark, sf_dir, closing=True).withColumn("value", F.col("value").cast("decimal(18,4)"))
    days = user_windows(rows, "ts", "1 day", ["event_type"], {"any": F.lit(True)}, user="user_id", amount="value")
    return _plain(collected(days)).select("window_start", "event_type", F.col("any_ct").alias("events"), F.col("any_user_ct").alias("users"), F.col("any_amount").cast("double").alias("amount"))


def stream_trade_10min(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _role(spark, sf_dir, {"click": "order", "purchase": "payment", "error": "refund"}, closing=True)
    return _plain(collected(trade_stats(rows, "ts", ["sku_id"], width="10 minutes")))


def stream_views_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(spark, sf_dir, closing=True).select("ts", "user_id", F.col("event_type").alias("channel"))
    return _plain(collected(views_and_users(rows, "ts", ["channel"])))


def stream_revenue_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(collected(revenue(_role(spark, sf_dir, {"purchase": "payment"}, closing=True), "ts")))


def stream_product_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(collected(product_days(_role(spark, sf_dir, {"view": "consult", "click": "order", "purchase": "payment"}, closing=True), "ts", "sku_id")))


def stream_first_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is an event on the first day that its user was seen on so far?"""
    days = arrivals(spark, sf_dir).select("event_id", "user_id", F.to_date("ts").alias("dt"))
    into = lambda put, folder: first_visits_into(put, folder, "user_id", "dt", lifetime_ms=None)
    return collected(days, into=into, schema="event_id long, user_id long, dt date, is_new int")


def stream_newest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(spark, sf_dir).select("event_id", "user_id", F.from_json("props", "struct<k:long>")["k"].alias("item"))
    return collected(newest_only(rows, "user_id", "item", "event_id"))


def stream_repeats_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user, type and props over all batches; the watermark's delay is longer than the events' span."""
    rows = arrivals(spark, sf_dir).select("ts", "user_id", "event_type", "props")
    return collected(drop_repeats(rows, ["user_id", "event_type", "props"], ts="ts", delay="400 days")).drop("ts")


def stream_wide_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest view, click and purchase value of each user, merged as the parts arrive."""
    parts = arrivals(spark, sf_dir).select("user_id", "ts", "event_id", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in KINDS])
    return collected(merge_parts(parts, ["user_id"], ["ts", "event_id"], list(KINDS)), "complete")


def stream_latest_refund(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest refund (error event) of each user."""
    rows = _role(spark, sf_dir, {"error": "refund"})
    return collected(merge_parts(rows.select("user_id", "event_id", "amount", F.col("event_id").alias("refund_id")), ["user_id"], ["event_id"], ["refund_id", "amount"]), "complete").withColumn("amount", F.col("amount").cast("double"))


def stream_dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their item's part under dim_ names; items without a part pass."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    rows = _role(spark, sf_dir, {"click": "order"}).select("event_id", (F.col("sku_id") * 5).alias("sku_id"))
    return collected(lookup(rows, part, F.col("sku_id"), "p_partkey"))


def stream_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item's key is looked for at the top of the record, then in its common part, then in its displays; the part's columns overwrite the record's."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_brand").alias("brand"))
    k = F.from_json("props", "struct<k:long>")["k"]
    rows = arrivals(spark, sf_dir).select("event_id", F.when(k % 3 == 0, k).alias("top"), F.when(k % 3 == 1, k).alias("common"), F.when(k % 3 == 2, k * 7).alias("display"), F.lit("none").alias("brand"))
    found = lookup_first(rows, part, [F.col("top"), F.col("common"), F.col("display")], "sku", ["brand"])
    return collected(found).select("event_id", "brand")


def stream_payment_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with customer and nation, two lookups."""
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = _role(spark, sf_dir, {"purchase": "payment"}).select("event_id", "user_id")
    found = lookup(lookup(rows, customer, F.col("user_id"), "c_custkey"), nation, F.col("dim_c_nationkey"), "n_nationkey")
    return collected(found).select("event_id", "user_id", F.col("dim_c_mktsegment").alias("segment"), F.col("dim_n_name").alias("province"))


def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments (errors) with the orders (clicks) of the same user up to two days before or six hours behind."""
    side = lambda kind, name: arrivals(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    joined = interval_join(side("error", "comment_id"), side("click", "order_id"), "user_id", "ts", before="2 days", after="6 hours", delay="400 days")
    return collected(joined).select("user_id", "comment_id", "info_order_id")


def stream_tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three logs with their own columns, tagged and united, counted by type and day."""
    events = arrivals(spark, sf_dir)
    logs = [source_tagged(events.where(F.col("event_type") == kind).select("event_id", "user_id", F.unix_millis("ts").alias("ms"), F.col("value").alias(f"{kind}_value")), kind, F.concat(F.lit("device "), F.col("user_id").cast("string")), F.col("ms")) for kind in KINDS]
    both = united(logs).groupBy("event_type", F.to_date("event_time").alias("dt"))
    return collected(both.agg(F.count(F.lit(1)).alias("events"), F.count("purchase_value").alias("with_value"), F.max("device").alias("last_device")), "complete")


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as JSON lines of a log, every seventh cut off in the middle."""
    common = F.struct(F.col("user_id").alias("uid")).alias("common")
    page = F.when(F.col("event_type") != "signup", F.struct(F.col("event_type").alias("page_id"))).alias("page")
    start = F.when(F.col("event_type") == "signup", F.struct(F.col("event_id").alias("entry"))).alias("start")
    shown = F.when(F.col("event_type") == "view", F.array(F.struct(F.lit(1).alias("item")), F.struct(F.lit(2).alias("item")))).alias("displays")
    acted = F.when(F.col("event_type") == "click", F.array(F.struct(F.lit("add").alias("action")))).alias("actions")
    err = F.when(F.col("event_type") == "error", F.struct(F.lit(1).alias("code"))).alias("err")
    text = F.to_json(F.struct(common, page, start, shown, acted, err, (F.unix_millis("ts") / 1000).cast("long").alias("ts")))
    return arrivals(spark, sf_dir).select(F.when(F.col("event_id") % 7 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))


_LOG = "common struct<uid:long>, page struct<page_id:string>, start struct<entry:long>, displays array<struct<item:int>>, actions array<struct<action:string>>, err struct<code:int>, ts long"


def stream_log_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each part of the split log, and the dirty lines."""
    good, bad = parsed(_log_lines(spark, sf_dir), _LOG)
    parts = [df.select(F.lit(name).alias("part")) for name, df in split_log(good).items()] + [bad.select(F.lit("dirty").alias("part"))]
    return collected(united(parts).groupBy("part").agg(F.count(F.lit(1)).alias("n")), "complete")


def stream_timed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines per day of the time that their text holds; lines without one count apart."""
    good, bad = event_time(_log_lines(spark, sf_dir), F.col("value"), "ts", delay="1 day")
    both = united([good.select(F.to_date("event_time").alias("dt")), bad.select(F.lit(None).cast("date").alias("dt"))])
    return collected(both.groupBy("dt").agg(F.count(F.lit(1)).alias("n")), "complete")


def stream_typed_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines as typed rows; lines that aren't JSON go."""
    rows = typed_topic(_log_lines(spark, sf_dir), _LOG).select(F.col("common.uid").alias("user_id"), F.col("page.page_id").alias("page"))
    return collected(rows.groupBy("user_id", "page").agg(F.count(F.lit(1)).alias("n")), "complete")


_ROW = "id long, customer long, status string, amount double"
_IMAGE = "struct<id:long,customer:long,status:string,amount:double>"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records of orders (snapshot reads, updates of paid ones, deletes of every ninth) and customers (inserts)."""
    image = lambda id_, customer, status, amount: F.struct(id_.alias("id"), customer.alias("customer"), status.alias("status"), amount.alias("amount"))
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    old = image(key, F.col("o_custkey"), F.lit("O"), F.col("o_totalprice"))
    new = image(key, F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_totalprice"))
    op = F.when(key % 9 == 0, "d").when(F.col("o_orderstatus") == "F", "u").otherwise("r")
    record = lambda op, before, after, name: F.to_json(F.struct(op.alias("op"), before.alias("before"), after.alias("after"), F.struct(F.lit(name).alias("table"), F.lit("false").alias("snapshot")).alias("source"), F.lit(1000).cast("long").alias("ts_ms")))
    orders = load(spark, sf_dir, "orders").select(record(op, F.when(key % 9 == 0, old), F.when(key % 9 != 0, new), "orders").alias("value"))
    person = image(F.col("c_custkey"), F.col("c_custkey"), none, F.col("c_acctbal"))
    return orders.unionByName(load(spark, sf_dir, "customer").select(record(F.lit("c"), F.lit(None).cast(_IMAGE), person, "customer").alias("value")))


def change_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows per table and operation, without envelope."""
    good, _ = change_records(_changes(spark, sf_dir), _ROW)
    rows = after_images(good)
    return rows.groupBy("table", "operation").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


def change_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records per sink of a configuration by table and operation, with a fallback."""
    good, _ = change_records(_changes(spark, sf_dir), _ROW)
    config = spark.createDataFrame([("orders", "update", "paid_orders", "id,amount", "id"), ("orders", None, "orders", "id,status", "id")], "source_table string, op string, sink_table string, sink_columns string, sink_row_key string")
    return slim(routed(good, config, "rest")).groupBy("sink_table", "sink_columns").agg(F.count(F.lit(1)).alias("n"))


def change_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per table of the demultiplexed stream, and appended rows with the columns of their own table."""
    good, _ = change_records(_changes(spark, sf_dir), _ROW)
    split = by_table(good, ["orders"])
    shapes = shaped(good, {"orders": {"order_id": "id", "state": "status"}, "customer": {"user_id": "id"}})
    sizes = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"all {name}").alias("part"), "n") for name, df in split.items()]
    sizes += [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"shaped {name}").alias("part"), "n") for name, df in shapes.items()]
    sizes += [appends(good).agg(F.count(F.lit(1)).alias("n")).select(F.lit("appends").alias("part"), "n")]
    return united(sizes)


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages: key and JSON value; the check reads a field back."""
    rows = messages(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderkey"])
    return rows.select("key", F.get_json_object("value", "$.o_orderstatus").alias("status"))


#: Queries with state of their own, which needs another store and no empty batches.
_KEYED = ("stream_newest_only",)


def _own_session(f):
    """f over a session of its own, so that queries at the same time don't change each other's settings."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keyed = f.__name__ in _KEYED
        return f(stream_session(spark, timers=keyed, **(ROCKS if keyed else {})), sf_dir)

    return run


QUERIES = {
    f.__name__: _own_session(f) if f.__name__.startswith("stream_") else f
    for f in (
        stream_windows_1d,
        stream_trade_10min,
        stream_views_10s,
        stream_revenue_5min,
        stream_product_days,
        stream_first_visits,
        stream_newest_only,
        stream_repeats_dropped,
        stream_wide_row,
        stream_latest_refund,
        stream_dim_lookup,
        stream_fallback_lookup,
        stream_payment_dims,
        stream_interval_join,
        stream_tagged_union,
        stream_log_parts,
        stream_timed_log,
        stream_typed_topic,
        change_operations,
        change_routes,
        change_tables,
        order_messages,
    )
}

_E = "e as (select event_id, ts, cast(ts as date) as dt, user_id, event_type as kind, value, props, cast(value as decimal(18,4)) as amount, cast(props::json->>'k' as bigint) as k from events)"


def _counts(kinds: dict[str, str]) -> str:
    return ", ".join(f"count(*) filter (kind = '{k}') as {n}_ct, count(distinct user_id) filter (kind = '{k}') as {n}_user_ct, cast(coalesce(sum(amount) filter (kind = '{k}'), 0) as double) as {n}_amount" for k, n in kinds.items())


ORACLE = {
    "stream_windows_1d": "select time_bucket(interval '1 day', ts) as window_start, event_type, count(*) as events, count(distinct user_id) as users, cast(sum(cast(value as decimal(18,4))) as double) as amount from events group by all",
    "stream_trade_10min": f"with {_E} select time_bucket(interval '10 minutes', ts) as window_start, k as sku_id, {_counts({'click': 'order', 'purchase': 'payment', 'error': 'refund'})} from e where kind in ('click', 'purchase', 'error') group by 1, 2 having count(*) filter (kind = 'click') > 0",
    "stream_views_10s": "select time_bucket(interval '10 seconds', ts) as window_start, event_type as channel, count(*) as pv_ct, count(distinct user_id) as uv_ct from events group by all",
    "stream_revenue_5min": f"with {_E} select time_bucket(interval '5 minutes', ts) as window_start, cast(sum(amount) as double) as revenue, count(distinct user_id) as payers from e where kind = 'purchase' group by 1",
    "stream_product_days": f"with {_E} select time_bucket(interval '1 day', ts) as window_start, k as sku_id, {_counts({'view': 'consult', 'click': 'order', 'purchase': 'payment'})} from e where kind in ('view', 'click', 'purchase') group by 1, 2",
    "stream_first_visits": "select event_id, user_id, cast(ts as date) as dt, cast(cast(ts as date) = min(cast(ts as date)) over (partition by user_id) as int) as is_new from events",
    "stream_newest_only": f"with {_E}, b as (select event_id, user_id, k as item, max(k) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from e) select event_id, user_id, item from b where item is not null and (before is null or item > before)",
    "stream_repeats_dropped": "select distinct user_id, event_type, props from events",
    "stream_wide_row": "select user_id, " + ", ".join(f'(list(value order by ts desc, event_id desc) filter (event_type = \'{k}\' and value is not null))[1] as "{k}"' for k in KINDS) + " from events group by user_id",
    "stream_latest_refund": f"with {_E} select user_id, event_id as refund_id, cast(amount as double) as amount from e where kind = 'error' qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "stream_dim_lookup": f"with {_E} select event_id, k * 5 as sku_id, p_partkey as dim_p_partkey, p_brand as dim_p_brand, p_type as dim_p_type from e left join part on p_partkey = k * 5 where kind = 'click'",
    "stream_fallback_lookup": f"with {_E} select event_id, coalesce(p_brand, 'none') as brand from e left join part on p_partkey = case when k % 3 = 2 then k * 7 else k end",
    "stream_payment_dims": "select event_id, user_id, c_mktsegment as segment, n_name as province from events left join customer on c_custkey = user_id left join nation on n_nationkey = c_nationkey where event_type = 'purchase'",
    "stream_interval_join": """select c.user_id, c.event_id as comment_id, o.event_id as info_order_id from events c join events o on c.user_id = o.user_id and o.ts between c.ts - interval '2 days' and c.ts + interval '6 hours'
where c.event_type = 'error' and o.event_type = 'click'""",
    "stream_tagged_union": "select event_type, cast(ts as date) as dt, count(*) as events, count(*) filter (event_type = 'purchase' and value is not null) as with_value, max('device ' || user_id) as last_device from events where event_type in ('view', 'click', 'purchase') group by all",
    "stream_log_parts": """with g as (select * from events where event_id % 7 <> 0)
select 'err' as part, count(*) as n from g where event_type = 'error' union all select 'start', count(*) from g where event_type = 'signup' union all select 'displays', 2 * count(*) from g where event_type = 'view'
union all select 'actions', count(*) from g where event_type = 'click' union all select 'page', count(*) from g where event_type <> 'signup' union all select 'dirty', count(*) from events where event_id % 7 = 0""",
    "stream_timed_log": "select case when event_id % 7 <> 0 then cast(ts as date) end as dt, count(*) as n from events group by 1",
    "stream_typed_topic": "select user_id, case when event_type <> 'signup' then event_type end as page, count(*) as n from events where event_id % 7 <> 0 group by all",
    "change_operations": """select 'orders' as "table", case when o_orderstatus = 'F' then 'update' else 'insert' end as operation, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount from orders where o_orderkey % 9 <> 0 group by all
union all select 'customer', 'insert', count(*), cast(sum(cast(c_acctbal as decimal(18,2))) as double) from customer""",
    "change_routes": """with c as (select case when o_orderkey % 9 <> 0 and o_orderstatus = 'F' then 'paid_orders' else 'orders' end as sink_table from orders union all select 'rest' from customer)
select sink_table, case sink_table when 'paid_orders' then 'id,amount' when 'orders' then 'id,status' end as sink_columns, count(*) as n from c group by 1""",
    "change_tables": """select 'all orders' as part, count(*) as n from orders union all select 'all rest', count(*) from customer union all select 'shaped orders', count(*) from orders where o_orderkey % 9 <> 0
union all select 'shaped customer', count(*) from customer union all select 'appends', (select count(*) from orders where o_orderkey % 9 <> 0) + (select count(*) from customer)""",
    "order_messages": "select o_custkey || '_' || o_orderkey as key, o_orderstatus as status from orders",
}
