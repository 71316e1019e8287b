"""States of days that later days build on: sums and sets of a day, stored once, from which any interval and every to-date state follows.

A day's rows have additive measures and, for each thing that is counted once
over several days, a bitmap of its ids. Ids are dealt into buckets of 32,768, so
a row is a key, a day and a bucket, and a bitmap takes 4 KB whatever the number of
ids. Bitmaps of days are united by OR; their bits are exact, not a sketch.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.loads import write_partitions


def day_rows(df: DataFrame, keys: list[str], day: str, sums: dict[str, Column], member: str) -> DataFrame:
    """(keys, bucket, sums, members, dt): measures and the set of members (ids of at least 0) per key and day.

    Null members are in no set; their rows count in the bucket -1.
    """
    bucket = F.when(F.col(member).isNotNull(), F.bitmap_bucket_number(member)).otherwise(F.lit(-1).cast("long"))
    bits = F.bitmap_construct_agg(F.when(F.col(member).isNotNull(), F.bitmap_bit_position(member)))
    named = [c.alias(name) for name, c in sums.items()]
    return df.groupBy(*keys, bucket.alias("bucket"), F.col(day).alias("dt")).agg(*named, bits.alias("members")).select(*keys, "bucket", *sums, "members", "dt")


def store_days(rows: DataFrame, path: str) -> None:
    """Write day rows; days that are there already are overwritten, others stay."""
    write_partitions(rows, path, "dt", "parquet")


def stored_days(spark: SparkSession, path: str, last: date, days: int) -> DataFrame:
    """The day rows of the `days` days that end with last; other days' folders aren't read."""
    return spark.read.parquet(path).where(F.col("dt").between(last - timedelta(days - 1), last))


def interval_states(days: DataFrame, keys: list[str], sums: list[str], last: date, intervals: tuple[int, ...], members: str) -> DataFrame:
    """Sums and distinct members per key and interval that ends with last, from day rows alone.

    Sets are united per bucket first, so no task holds more than one bucket of a
    key; a bucket's bits are counted there and the counts are added.
    """
    tagged = days.withColumn("recent_days", F.explode(F.array(*map(F.lit, intervals)))).where(F.col("dt") > F.date_sub(F.lit(last), F.col("recent_days")))
    per = tagged.groupBy("recent_days", *keys, "bucket").agg(*[F.sum(s).alias(s) for s in sums], F.bitmap_count(F.bitmap_or_agg("members")).alias("_n"))
    return per.groupBy("recent_days", *keys).agg(*[F.sum(s).alias(s) for s in sums], F.sum("_n").alias(members))


def roll_forward(state: DataFrame, days: DataFrame, keys: list[str], merges: dict[str, str]) -> DataFrame:
    """The state to date after the given later days: merges names the measures and how they go together (sum, min or max).

    It reads the older state and the later days' rows, never the facts before.
    """
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    both = state.select(*keys, *merges).unionByName(days.select(*keys, *merges))
    return both.groupBy(*keys).agg(*[how[kind](c).alias(c) for c, kind in merges.items()])
