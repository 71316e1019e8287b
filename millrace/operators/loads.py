"""Warehouse load patterns: partition writers, zipper tables, accumulating snapshots."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.operators.ranking import latest_per_key

#: Open rows of a zipper carry this end date, and lie in its partition.
OPEN = date(9999, 12, 31)


def write_partitions(df: DataFrame, path: str, by: str = "dt", fmt: str = "orc") -> None:
    """Overwrite the partitions that df holds and no others; ORC and Parquet are snappy-compressed."""
    writer = df.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "dynamic")
    if fmt in ("orc", "parquet"):
        writer = writer.option("compression", "snappy")
    elif fmt == "csv":
        writer = writer.option("sep", "\t")
    writer.partitionBy(by).save(path)


def write_day(df: DataFrame, path: str, day: date, by: str = "dt", fmt: str = "orc") -> None:
    """Overwrite one day's partition."""
    write_partitions(df.withColumn(by, F.lit(day.isoformat())), path, by, fmt)


def append(df: DataFrame, path: str, by: str = "dt", fmt: str = "orc") -> None:
    df.write.mode("append").format(fmt).partitionBy(by).save(path)


def read_day(spark: SparkSession, path: str, day: str, by: str = "dt", fmt: str = "orc") -> DataFrame:
    """One partition; the filter on the partition column prunes the others."""
    return spark.read.format(fmt).load(path).where(F.col(by).cast("string") == day)


def accumulate_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """Report rows so far and new ones, without repeats. Write it elsewhere, then swap: Spark can't overwrite what it reads."""
    return old.unionByName(new).distinct()


def zipper_first(snapshot: DataFrame, day: Column) -> DataFrame:
    """First load: every row is open."""
    return snapshot.withColumn("start_date", day).withColumn("end_date", F.lit(OPEN))


def zipper_daily(open_rows: DataFrame, changes: DataFrame, keys: list[str], order: list[Column], day: Column) -> DataFrame:
    """Open rows and the day's latest change per key to versions.

    The newest version stays open; an older one closes on the day before and
    lands in that day's partition. Keys without a change stay as they are; run
    twice for one day it gives the same rows.
    """
    latest = latest_per_key(changes, keys, order).withColumn("start_date", day).withColumn("end_date", F.lit(OPEN))
    united = open_rows.where(F.col("start_date") < day).unionByName(latest.select(*open_rows.columns)).distinct()
    newest = Window.partitionBy(*keys).orderBy(F.desc("start_date"))
    ranked = united.withColumn("_nth", F.row_number().over(newest))
    return ranked.withColumn("end_date", F.when(F.col("_nth") == 1, F.col("end_date")).otherwise(F.date_sub(day, 1))).drop("_nth")


def versions_of_runs(changes: DataFrame, keys: list[str], state: list[str], day: str, order: list[str]) -> DataFrame:
    """(keys, state, start_date, end_date): the versions that changes of many days make, in one pass.

    A day's state is that of its last change by `order`. Days of equal state in
    a row are one version; it ends on the day before the next one begins, and
    the last one is open. Changes may come in any order and late: a change of an
    earlier day falls between the versions that it belongs to, and may split or
    join them. Changes without a day go; null states are states. A late change
    needs the days' own states, which versions alone don't hold.
    """
    last = changes.where(F.col(day).isNotNull()).groupBy(*keys, F.col(day).alias("start_date")).agg(F.max(F.struct(*order, *state)).alias("_last"))
    daily = last.select(*keys, "start_date", *[F.col(f"_last.{c}").alias(c) for c in state])
    own = Window.partitionBy(*keys).orderBy("start_date")
    here = F.struct(*state)
    begun = daily.withColumn("_before", F.lag(here).over(own)).where(F.col("_before").isNull() | ~here.eqNullSafe(F.col("_before"))).drop("_before")
    return begun.withColumn("end_date", F.coalesce(F.date_sub(F.lead("start_date").over(own), 1), F.lit(OPEN))).select(*keys, *state, "start_date", "end_date")


def accumulating(process: DataFrame, milestones: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per process with the day of each milestone; milestones have (key, dt).

    A milestone met twice counts by its first day.
    """
    for name, rows in milestones.items():
        first = rows.groupBy(key).agg(F.min("dt").alias(name))
        process = process.join(first, key, "left")
    return process


def close_by_status(open_rows: DataFrame, changes: DataFrame, key: str, closed: list[str], day: Column) -> DataFrame:
    """Accumulating fact by status: rows whose new status is final get `day` as end date, others stay open."""
    merged = open_rows.join(changes.select(key, F.col("status").alias("_new")), key, "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    return merged.withColumn("end_date", F.when(F.col("status").isin(closed), day).otherwise(F.lit(OPEN)))


def stage_filter(status: str, stages: list[str], at: int) -> Column:
    """Rows at stage `at` or past it, by excluding earlier codes; the stage list is data."""
    return ~F.col(status).isin(stages[:at])
