"""Window metrics of events. Each takes a stream or a table and gives the same rows for both.

On a table distinct users are counted in one aggregation. A stream can't count
distinct values; there two aggregations follow each other (closed.user_windows),
windows come out once they are closed, and the state forgets them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.streaming.closed import user_windows
from millrace.streaming.events import windowed


def _kinds(df: DataFrame, ts: str, keys: list[str], kinds: list[str], user: str, amount: str, width: str, **how) -> DataFrame:
    """Rows, users and amount of each kind of event per window and keys."""
    if df.isStreaming:
        mine = {k: F.col("event_type") == k for k in kinds}
        found = user_windows(df, ts, width, keys, mine, user=user, amount=amount, **how)
    else:
        measures = []
        for kind in kinds:
            mine = F.col("event_type") == kind
            measures += [F.count_if(mine).alias(f"{kind}_ct"), F.count_distinct(F.when(mine, F.col(user))).alias(f"{kind}_user_ct"), F.sum(F.when(mine, F.col(amount))).alias(f"{kind}_amount")]
        found = windowed(df, ts, width, keys, measures, **how)
    return found.withColumns({f"{k}_amount": F.coalesce(F.col(f"{k}_amount").cast("double"), F.lit(0.0)) for k in kinds})


def _users(df: DataFrame, ts: str, width: str, keys: list[str], value: Column, where: Column, names: tuple[str, str], **how) -> DataFrame:
    """Rows and distinct values of those that satisfy `where`, per window and keys, under these names."""
    if df.isStreaming:
        return user_windows(df.withColumn("_value", value), ts, width, keys, {"_m": where}, user="_value", **how).withColumnsRenamed({"_m_ct": names[0], "_m_user_ct": names[1]})
    return windowed(df, ts, width, keys, [F.count_if(where).alias(names[0]), F.count_distinct(F.when(where, value)).alias(names[1])], **how)


def trade_stats(df: DataFrame, ts: str, keys: list[str], *, user: str = "user_id", amount: str = "amount", width: str = "10 seconds", **how) -> DataFrame:
    """Orders, payments and refunds per window and keys, where there is an order.

    One conditional aggregate stands for three aggregates and their joins: a
    single shuffle, and a single state on a stream.
    """
    return _kinds(df, ts, keys, ["order", "payment", "refund"], user, amount, width, **how).where("order_ct > 0")


def kind_stats(df: DataFrame, ts: str, keys: list[str], kind: str, *, user: str = "user_id", amount: str = "amount", width: str = "10 seconds", **how) -> DataFrame:
    """Count, users and amount of one kind of event per window and keys."""
    mine = df.where(F.col("event_type") == kind)
    return _kinds(mine, ts, keys, [kind], user, amount, width, **how)


def views_and_users(df: DataFrame, ts: str, keys: list[str], *, user: str = "user_id", width: str = "10 seconds", **how) -> DataFrame:
    return _users(df, ts, width, keys, F.col(user), F.lit(True), ("pv_ct", "uv_ct"), **how)


def sessions(df: DataFrame, ts: str, keys: list[str], *, last_page: str = "last_page_id", width: str = "10 seconds", **how) -> DataFrame:
    """Session starts, and those without a page before them."""
    return windowed(df, ts, width, keys, [F.count(F.lit(1)).alias("sv_ct"), F.count_if(F.col(last_page).isNull()).alias("uj_ct")], **how)


def displays(df: DataFrame, ts: str, keys: list[str], *, item: str = "item", width: str = "10 seconds", **how) -> DataFrame:
    """Displays and distinct items displayed, in windows that have displays or clicks of an item."""
    seen = df.where(F.col(item).isNotNull() & F.col("event_type").isin("display", "click"))
    shown = F.col("event_type") == "display"
    return _users(seen, ts, width, keys, F.col(item), shown, ("disp_ct", "disp_sku_num"), **how)


def revenue(df: DataFrame, ts: str, *, user: str = "user_id", amount: str = "amount", width: str = "5 minutes", **how) -> DataFrame:
    """Sum of payments and number of different payers per window, over everything."""
    if df.isStreaming:
        closed = user_windows(df, ts, width, [], {"_m": F.lit(True)}, user=user, amount=amount, **how)
        return closed.select("window_start", "window_end", F.col("_m_amount").cast("double").alias("revenue"), F.col("_m_user_ct").alias("payers"))
    return windowed(df, ts, width, [], [F.sum(amount).cast("double").alias("revenue"), F.count_distinct(user).alias("payers")], **how)


def product_days(df: DataFrame, ts: str, product: str, *, user: str = "user_id", amount: str = "amount", **how) -> DataFrame:
    """Consultations, orders and payments per product and day."""
    return _kinds(df, ts, [product], ["consult", "order", "payment"], user, amount, "1 day", **how)
