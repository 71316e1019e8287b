"""Tables that a stream of foreachBatch batches keeps from batch to batch: state for joins and groups of whole batches.

Two folders take turns. A batch reads the one that the batch before it has left
and writes the other, so that a batch that is run again, after a stop or on
another driver, begins with the same rows, and no more than two copies lie there.
A query runs its batches by number, none before the one before it is committed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.streaming.state import DAY_MS

Put = Callable[[DataFrame, int], None]


def kept_before(like: DataFrame, folder: str, n: int) -> DataFrame:
    """The rows that batch n - 1 has left, with the columns of `like`; none before the first batch."""
    spark = like.sparkSession
    return spark.read.schema(like.schema).parquet(f"{folder}/turn={(n - 1) % 2}") if n else spark.createDataFrame([], like.schema)


def kept_after(rows: DataFrame, folder: str, n: int) -> None:
    """Leave rows for batch n + 1."""
    rows.write.mode("overwrite").parquet(f"{folder}/turn={n % 2}")


def first_visits_into(put: Put, state: str, device: str, day: str, *, lifetime_ms: int | None = DAY_MS) -> Put:
    """For foreachBatch: put gets the batch with is_new, as first_visits() has it.

    A batch's devices are met by one group and one join, so rows stay out of
    Python. Below `state` lies a row per device, which goes once lifetime_ms have
    passed without a row of it (None: never).
    """

    def step(batch: DataFrame, n: int) -> None:
        now = datetime.now(timezone.utc)
        fresh = batch.groupBy(device).agg(F.min(day).alias("first"), F.lit(now).alias("seen"))
        held = kept_before(fresh, state, n)
        if lifetime_ms is not None:
            held = held.where(F.col("seen") > F.lit(now - timedelta(milliseconds=lifetime_ms)))
        firsts = held.unionByName(fresh).groupBy(device).agg(F.min("first").alias("first"), F.max("seen").alias("seen"))
        kept_after(firsts.where("first is not null"), state, n)
        known = kept_before(fresh, state, n + 1).select(F.col(device).alias("_device"), "first")
        # As many devices as there may be: never broadcast.
        both = batch.join(known.hint("merge"), F.col(device).eqNullSafe(F.col("_device")), "left")
        put(both.select(*[F.col(c) for c in batch.columns if c != "is_new"], F.coalesce(F.col(day) == F.col("first"), F.lit(False)).cast("int").alias("is_new")), n)

    return step
