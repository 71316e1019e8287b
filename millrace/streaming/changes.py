"""Change records of databases: (op, before, after, source, ts_ms) to rows per table. state.py has keyed state over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from millrace.streaming.events import parsed

#: Operation codes of change records and their names.
OPERATIONS = {"c": "insert", "r": "insert", "u": "update", "d": "delete"}


def change_records(raw: DataFrame, row: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON text as change records whose rows have the fields `row` (DDL), and the dirty rows."""
    return parsed(raw, f"op string, before struct<{row}>, after struct<{row}>, source struct<table:string,snapshot:string>, ts_ms long", value)


def operation(code: Column) -> Column:
    """insert, update or delete; an unknown code gives null."""
    name = F.lit(None).cast("string")
    for short, long in OPERATIONS.items():
        name = F.when(code == short, long).otherwise(name)
    return name


def after_images(changes: DataFrame) -> DataFrame:
    """The rows as they are after the change, with table, operation and ts_ms; deletes have none."""
    return changes.where("after is not null").select("after.*", F.col("source.table").alias("table"), operation(F.col("op")).alias("operation"), "ts_ms")


def slim(changes: DataFrame, envelope: tuple[str, ...] = ("source", "transaction")) -> DataFrame:
    """Without envelope columns; those that aren't there are passed over."""
    return changes.drop(*envelope)


def by_table(changes: DataFrame, tables: list[str]) -> dict[str, DataFrame]:
    """One frame per table, and `rest`: other tables and records that name none."""
    table = F.col("source.table")
    parts = {t: changes.where(table == t) for t in tables}
    return parts | {"rest": changes.where(~F.coalesce(table.isin(tables), F.lit(False)))}


def routed(changes: DataFrame, config: DataFrame, fallback: str | None = None) -> DataFrame:
    """Change records with sink_table, sink_columns and sink_row_key of their table and operation.

    config (source_table, op, sink_table, sink_columns, sink_row_key) has one
    row per table and operation name (insert, update, delete); a null op stands
    for all operations of the table without a row of their own. Without a row,
    records go to `fallback`, or away if it is null.
    """
    own = config.where("op is not null").select(F.col("source_table").alias("_t"), F.col("op").alias("_o"), F.struct("sink_table", "sink_columns", "sink_row_key").alias("_own"))
    any_ = config.where("op is null").select(F.col("source_table").alias("_u"), F.struct("sink_table", "sink_columns", "sink_row_key").alias("_any"))
    tagged = changes.withColumn("_table", F.col("source.table")).withColumn("_op", operation(F.col("op")))
    joined = tagged.join(own, (F.col("_table") == F.col("_t")) & (F.col("_op") == F.col("_o")), "left").join(any_, F.col("_table") == F.col("_u"), "left")
    to = F.coalesce("_own", "_any")
    found = joined.select(*changes.columns, F.coalesce(to["sink_table"], F.lit(fallback)).alias("sink_table"), to["sink_columns"].alias("sink_columns"), to["sink_row_key"].alias("sink_row_key"))
    return found.where("sink_table is not null")


def event_time(df: DataFrame, value: str, field: str, *, name: str = "event_time", delay: str = "5 seconds") -> tuple[DataFrame, DataFrame]:
    """df with the time that a field of its JSON text holds, watermarked on a stream; and the rows without a time.

    The time is epoch seconds (up to ten digits) or milliseconds.
    """
    number = F.get_json_object(value, f"$.{field}").try_cast("long")
    timed = df.withColumn(name, F.timestamp_millis(F.when(F.abs(number) < 10_000_000_000, number * 1000).otherwise(number)))
    good, bad = timed.where(F.col(name).isNotNull()), timed.where(F.col(name).isNull()).drop(name)
    return (good.withWatermark(name, delay) if df.isStreaming else good), bad


def source_tagged(df: DataFrame, event_type: str, device: Column, ts_ms: Column) -> DataFrame:
    """df with event_type, device and event_time, so that logs of several kinds can be united."""
    return df.withColumn("event_type", F.lit(event_type)).withColumn("device", device).withColumn("event_time", F.timestamp_millis(ts_ms.cast("long")))


def united(streams: list[DataFrame]) -> DataFrame:
    """Tagged streams of several kinds as one; columns that a kind lacks are null."""
    both = streams[0]
    for other in streams[1:]:
        both = both.unionByName(other, allowMissingColumns=True)
    return both


def shaped(changes: DataFrame, shapes: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """The new rows of each table with its own columns; shapes: table -> {column: field of the row}. Rows without a new image go."""
    rows = changes.where("after is not null")
    return {t: rows.where(F.col("source.table") == t).select(*[F.col(f"after.{field}").alias(name) for name, field in fields.items()], operation(F.col("op")).alias("operation"), "ts_ms") for t, fields in shapes.items()}


def appends(changes: DataFrame) -> DataFrame:
    """A changelog as rows to append: inserts and updates by their new row; deletes go."""
    return after_images(changes).where(F.col("operation").isin("insert", "update"))


def query(df: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None], *, every: str | None = None, mode: str = "append") -> DataStreamWriter:
    """A writer that ends up with every row once: checkpointed offsets and state, and a sink that repeats a batch harmlessly.

    Without `every` it takes what is there and ends; where state has a timeout,
    it only ends with spark.sql.streaming.noDataMicroBatches.enabled off. For
    large keyed state set
    spark.sql.streaming.stateStore.providerClass to the RocksDB provider.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger)
