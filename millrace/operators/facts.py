"""Logistics facts by stage: one builder each for first and for daily loads, process, transport and station facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.loads import OPEN, stage_filter


def order_details(cargo: DataFrame, orders: DataFrame, order_id: str, names: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cargo rows with their order, and for each code column in `names` its name.

    names: column -> (id, name). Every code is looked up by its own id.
    """
    joined = cargo.join(orders, order_id)
    for column, codes in (names or {}).items():
        known = codes.select(F.col("id").cast("string").alias("_code"), F.col("name").alias(f"{column}_name"))
        joined = joined.join(known, F.col(column).cast("string") == F.col("_code"), "left").drop("_code")
    return joined


def stage_first(details: DataFrame, status: str, stages: list[str], at: int, happened: Column) -> DataFrame:
    """First load of a stage's fact: rows at stage `at` or past it, in the partition `dt` of the day it happened.

    Rows with a status that isn't among the stages go.
    """
    return details.where(F.col(status).isin(stages) & stage_filter(status, stages, at)).withColumn("dt", F.to_date(happened))


def stage_daily(open_rows: DataFrame, new_rows: DataFrame, changed: DataFrame, key: str, status: str, stages: list[str], at: int, day: Column) -> DataFrame:
    """A day's fact: rows that reached stage `at` on this day.

    open_rows hold the status of the day before, new_rows were made today, and
    changed (key, status) has today's status. A row that jumps over the stage
    has reached it; one that was there before has not reached it again.
    """
    before = open_rows.where(~(F.col(status).isin(stages) & stage_filter(status, stages, at)))
    now = changed.select(key, F.col(status).alias("_now"))
    moved = before.join(now, key).withColumn(status, F.col("_now")).drop("_now")
    return stage_first(moved.unionByName(new_rows.select(*open_rows.columns)), status, stages, at, day)


def process_first(details: DataFrame, status: str, closed: list[str], started: Column, ended: Column) -> DataFrame:
    """First load of the accumulating process: closed rows end on their day, others stay open. `dt` is the end."""
    end = F.when(F.col(status).isin(closed), F.to_date(ended)).otherwise(F.lit(OPEN))
    return details.withColumn("start_date", F.to_date(started)).withColumn("end_date", end).withColumn("dt", F.col("end_date"))


def transport_finish(tasks: DataFrame, shifts: DataFrame, shift_id: str, start: str, end: str) -> DataFrame:
    """Finished tasks with their duration in seconds and the shift's planned time; start and end are epoch milliseconds."""
    done = tasks.where(F.col(end).isNotNull())
    long = lambda c: F.col(c).cast("long")
    timed = done.withColumn("finish_dur_sec", F.floor((long(end) - long(start)) / 1000)).withColumn("dt", F.to_date(F.timestamp_millis(long(end))))
    return timed.join(shifts.select(shift_id, F.col("estimated_time").alias("estimate_end_time")), shift_id, "left")


def station_fact(bounds: DataFrame, time: str, employee: str, keep: list[str]) -> DataFrame:
    """Inbound, sort or outbound fact: rows whose step is done, with its time and day; `time` is epoch milliseconds."""
    at = F.timestamp_millis(F.col(time).cast("long"))
    return bounds.where(F.col(time).isNotNull()).select(*keep, at.alias("step_time"), F.col(employee).alias("emp_id"), F.to_date(at).alias("dt"))
