"""Windows that close: append mode, distinct users without sets in the state, and late rows in an output of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Put = Callable[[DataFrame, int], None]


def user_windows(df: DataFrame, ts: str, width: str, keys: list[str], kinds: dict[str, Column], *, user: str, amount: str | None = None, delay: str | None = "5 seconds") -> DataFrame:
    """Per window and keys, and for each kind (name: condition): `_ct` rows, `_user_ct` distinct users and `_amount`.

    Two aggregations follow each other, per window, keys and user, then per
    window and keys, so that no set of users is held: a user of an open window is a
    row of the state, which is dealt out by key. On a stream both forget a
    window, and the second gives it out, once the watermark (`delay` behind the
    newest row; None if df has one already) has passed its end; later rows of
    that window are left out. Null users have rows and amounts, but don't count
    as users. On a table there is no lateness.
    """
    df = df.withWatermark(ts, delay) if df.isStreaming and delay else df
    each = [F.count_if(where).alias(f"{k}_ct") for k, where in kinds.items()]
    each += [F.sum(F.when(where, F.col(amount))).alias(f"{k}_amount") for k, where in kinds.items()] if amount else []
    per_user = df.groupBy(F.window(ts, width).alias("_w"), *keys, F.col(user).alias("_user")).agg(*each)
    both = []
    for k in kinds:
        both += [F.sum(f"{k}_ct").alias(f"{k}_ct"), F.count_if((F.col(f"{k}_ct") > 0) & F.col("_user").isNotNull()).alias(f"{k}_user_ct")]
        both += [F.sum(f"{k}_amount").alias(f"{k}_amount")] if amount else []
    closed = per_user.groupBy(F.window(F.window_time("_w"), width).alias("_w"), *keys).agg(*both)
    names = [c for c in closed.columns if c != "_w"]
    return closed.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *names)


def late_split(ts: str, width: str, delay: str, marks: str, on_time: Put, late: Put) -> Put:
    """For foreachBatch: rows whose window was closed when their batch began go to `late`, all others to `on_time`.

    A window is closed when its end isn't after the newest time of all earlier
    batches less `delay`, as for a watermark. Each batch leaves its newest time
    in a folder of its own below `marks`, so that a batch that is run again, by
    a query that was stopped or on another driver, is split in the same way.
    Rows without a time are late.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        kept = batch.persist()
        try:
            # One small row per batch.
            kept.agg(F.max(ts).alias("newest")).select(F.lit(n).alias("n"), "newest").coalesce(1).write.mode("overwrite").parquet(f"{marks}/mark={n}")
            seen = spark.read.schema(f"n int, newest {dict(batch.dtypes)[ts]}").parquet(f"{marks}/mark=*")
            mark = seen.where(F.col("n") < n).agg((F.max("newest") - F.expr(f"interval {delay}")).alias("mark")).first().mark
            closed = F.coalesce(F.window(ts, width)["end"] <= F.lit(mark), F.col(ts).isNull()) if mark is not None else F.col(ts).isNull()
            # window() drops rows without a time, so they are told apart first.
            timed = kept.where(F.col(ts).isNotNull()).withColumn("_closed", closed)
            untimed = kept.where(F.col(ts).isNull())
            late(timed.where("_closed").drop("_closed").unionByName(untimed), n)
            on_time(timed.where("not _closed").drop("_closed"), n)
        finally:
            kept.unpersist()

    return put
