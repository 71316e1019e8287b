"""Joins of several streams, and of a stream with a configuration that is a stream itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.streaming.kept import kept_after, kept_before

Put = Callable[[DataFrame, int], None]


def wide_join(left: DataFrame, ts: str, others: list[tuple[DataFrame, list[tuple[str, str]], str]], *, within: str, delay: str) -> DataFrame:
    """Rows of left with those of several other streams, chained left outer joins.

    others holds (stream, pairs of equal columns of left and the stream, its
    time); a row matches from left's time on for `within`. Column names must
    differ. Each stream has a watermark of its own, `delay` behind its newest
    row, and state waits for the slowest. A row of left without a match comes
    out once, with nulls, when no match can come any more. Rows behind the
    watermark are left out. Keys that are null match nothing.
    """
    streaming = left.isStreaming
    out = left.withWatermark(ts, delay) if streaming else left
    for other, keys, at in others:
        other = other.withWatermark(at, delay) if streaming else other
        same = (F.col(at) >= F.col(ts)) & (F.col(at) <= F.col(ts) + F.expr(f"interval {within}"))
        for a, b in keys:
            same &= F.col(a) == F.col(b)
        out = out.join(other, same, "left_outer")
    return out


def configured_rows(rows: DataFrame, config: DataFrame, *, key: str, ts: str, valid_from: str, version: str, value: str) -> DataFrame:
    """rows, as structs in `_row`, and the configuration's rows in one table or stream, for as_configured() and configured_into()."""
    both = rows.select(F.struct(*rows.columns).alias("_row"), F.col(key).alias("_key"), F.col(ts).alias("_at"), F.lit(None).cast("long").alias("_version"), F.lit(None).cast("struct<v:string>").alias("_value"), F.lit(1).alias("_last"))
    return both.unionByName(config.select(F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col(key).alias("_key"), F.col(valid_from).alias("_at"), F.col(version).cast("long").alias("_version"), F.struct(F.col(value).cast("string").alias("v")).alias("_value"), F.lit(0).alias("_last")))


def _valued(both: DataFrame, value: str, fallback: str | None) -> DataFrame:
    """The rows of configured_rows() with the value that was valid for them."""
    order = Window.partitionBy("_key").orderBy("_at", "_last", F.asc_nulls_first("_version")).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("_valid", F.last("_value", ignorenulls=True).over(order)).where("_row is not null")
    sound = F.col("_key").isNotNull() & F.col("_at").isNotNull() & F.col("_valid").isNotNull()
    return known.select("_row.*", F.when(sound, F.col("_valid.v")).otherwise(F.lit(fallback)).alias(value))


def as_configured(rows: DataFrame, config: DataFrame, *, key: str, ts: str, valid_from: str, version: str, value: str, fallback: str | None = None) -> DataFrame:
    """Rows of a table with the value of the configuration that was valid for their key at their time.

    A configuration row is valid for its key from its time on, until the next
    one (of equal times, that of the greatest version). Without one, and without
    a time or a key, rows get the fallback. configured_into() does it for streams.
    """
    return _valued(configured_rows(rows, config, key=key, ts=ts, valid_from=valid_from, version=version, value=value), value, fallback)


def configured_into(put: Put, state: str, *, value: str, fallback: str | None = None, delay: str = "5 seconds") -> Put:
    """For foreachBatch on a stream of configured_rows(): put gets rows with their value, as in as_configured().

    A row waits until the watermark, `delay` behind the newest time of all rows
    and configurations, has passed its time: no configuration that came in time
    is missed, whichever came first. What comes behind the watermark, or without
    a time or a key, goes. Below `state` lie the waiting rows, and of each key the
    versions since the watermark and one before it; a batch that is run again
    begins with the same ones.
    """

    def step(batch: DataFrame, n: int) -> None:
        sound = batch.where("_key is not null and _at is not null")
        marks = kept_before(sound.select(F.col("_at").alias("newest")), f"{state}/mark", n)
        before = marks.agg((F.max("newest") - F.expr(f"interval {delay}")).alias("mark")).first().mark
        kept_after(marks.unionByName(sound.select(F.col("_at").alias("newest"))).agg(F.max("newest").alias("newest")), f"{state}/mark", n)
        mark = kept_before(marks, f"{state}/mark", n + 1).agg((F.max("newest") - F.expr(f"interval {delay}")).alias("mark")).first().mark
        timely = sound if before is None else sound.where(F.col("_at") > F.lit(before))
        both = kept_before(batch, f"{state}/rows", n).unionByName(timely)
        over = F.coalesce(F.col("_at") <= F.lit(mark), F.lit(False))
        put(_valued(both.where(over), value, fallback), n)
        # Of the versions that no waiting or coming row is older than, the newest is enough.
        old = both.where(over & F.col("_row").isNull()).groupBy("_key").agg(F.max_by(F.struct("_at", "_version", "_value"), F.struct("_at", "_version")).alias("v"))
        old = old.select(F.lit(None).cast(batch.schema["_row"].dataType).alias("_row"), "_key", "v.*", F.lit(0).alias("_last"))
        kept_after(both.where(~over).unionByName(old), f"{state}/rows", n)

    return step
