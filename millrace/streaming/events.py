"""Operators for event streams. Each takes a streaming or a static DataFrame unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.streaming.state import newest_versions

LOG_PARTS = ("err", "start", "displays", "actions", "page")


def parsed(raw: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows of JSON text as columns, and the dirty rows (value, error) that don't parse."""
    read = raw.select(F.col(value).alias("value"), F.from_json(value, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("row"))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return read.where(~bad).select("row.*").drop("_bad"), read.where(bad).select("value", F.lit("not valid JSON of the schema").alias("error"))


def windowed(df: DataFrame, ts: str, width: str, keys: list[str], measures: list[Column], *, delay: str = "5 seconds") -> DataFrame:
    """Tumbling windows by event time; on a stream a window is final once the watermark passes it.

    Watermarks need an instant: on a stream a time without zone is read in the
    session's zone, and its windows are given back without zone.
    """
    plain = df.isStreaming and dict(df.dtypes)[ts] == "timestamp_ntz"
    df = df.withColumn(ts, F.col(ts).cast("timestamp")) if plain else df
    df = df.withWatermark(ts, delay) if df.isStreaming else df
    grouped = df.groupBy(F.window(ts, width).alias("_w"), *keys).agg(*measures)
    edge = lambda name: (F.col(f"_w.{name}").cast("timestamp_ntz") if plain else F.col(f"_w.{name}")).alias(f"window_{name}")
    return grouped.select(edge("start"), edge("end"), *[c for c in grouped.columns if c != "_w"])


def split_log(df: DataFrame) -> dict[str, DataFrame]:
    """One parsed log frame as five: errors, starts, displays, actions and pages.

    A start has no page; displays and actions are a row per element with their page.
    """
    page = df.where("start is null and page is not null")
    each = lambda name: page.select("common", "page", "ts", F.explode(name).alias(name))
    return {
        "err": df.where("err is not null"),
        "start": df.where("start is not null").select("common", "start", "ts"),
        "displays": each("displays"),
        "actions": each("actions"),
        "page": page.select("common", "page", "ts"),
    }


def drop_repeats(df: DataFrame, keys: list[str], *, ts: str | None = None, delay: str = "1 day") -> DataFrame:
    """One row per key; a stream forgets keys once the watermark has passed them."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def newest_only(df: DataFrame, key: str, version: str, arrival: str) -> DataFrame:
    """Rows whose version is above all that arrived before for their key. Rows without a version go.

    A stream keeps one number per key, see state.newest_versions(). The version
    is a long. Rows of one micro-batch are taken in order of arrival.
    """
    if df.isStreaming:
        return newest_versions(df, key, version, [arrival])
    before = F.max(version).over(Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(version) > F.col("_before"))).where(F.col(version).isNotNull()).drop("_before")


def merge_parts(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Partial rows in one wide row per key: of every column the newest value that isn't null."""
    newest = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), newest)).alias(c) for c in columns])


def first_visit(df: DataFrame, device: str, day: str) -> DataFrame:
    """df (static) with is_new put right: 1 on the device's first day, else 0."""
    first = F.min(day).over(Window.partitionBy(device))
    return df.withColumn("is_new", (F.col(day) == first).cast("int"))


def latest_sink(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the newest row per key of each batch, in a folder of its own.

    A batch that is run again overwrites its folder, so a restart writes no row twice.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        columns = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
        newest.select(*keys, "_row.*").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return put
