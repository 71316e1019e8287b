"""Date intervals, full outer merges and cumulative merges for metric queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a task of dealt(), about.
PART_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by a hash of keys into tasks of about PART_ROWS rows; rows is how many there are, about.

    For groups that are nearly as many as the rows: grouped by these keys and
    more, each task ends its own, without partial groups before a shuffle, and
    a task's memory doesn't grow with the table.
    """
    return df.repartition(max(1, -(-rows // PART_ROWS)), *keys)


def with_dimension(df: DataFrame, rows: int, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """df, of about so many rows, with dim's row of its key, nulls where there is none; dim_key goes.

    A dimension of up to PART_ROWS rows may be broadcast, as all tasks hold it
    whole. A larger one, which packs well in its files and so looks small to the
    planner, is dealt with df by key.
    """
    if dim.count() > PART_ROWS:
        df, dim = dealt(df, rows, key), dealt(dim, rows, dim_key).hint("merge")
    return df.join(dim, df[key] == dim[dim_key], "left").drop(dim[dim_key])


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def on_day(day: str | Column, today: Column) -> Column:
    return _col(day) == today


def within_days(day: str | Column, today: Column, days: int | Column) -> Column:
    """day lies in the `days` days that end with today."""
    n = F.lit(days) if isinstance(days, int) else days
    return (_col(day) <= today) & (_col(day) > F.date_sub(today, n))


def interval_rows(df: DataFrame, day: str, today: Column, intervals: Iterable[int]) -> DataFrame:
    """A row per interval that holds the row's day, tagged `recent_days`."""
    tagged = df.withColumn("recent_days", F.explode(F.array(*[F.lit(n) for n in intervals])))
    return tagged.where(within_days(day, today, F.col("recent_days")))


def full_outer(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Full outer join with coalesced keys; columns of `defaults` are filled where a side is missing."""
    joined = left.join(right, keys, "full_outer")
    return joined.fillna(defaults) if defaults else joined


def merge_sides(sides: list[DataFrame], keys: list[str]) -> DataFrame:
    """Three or more summaries of the same keys in one row per key, absent sides as nulls.

    A union and one aggregate: the key is coalesced over all sides, whichever
    of them have it, and a single shuffle serves them all. A measure belongs to
    one side, and a side has one row per key.
    """
    united = sides[0]
    for side in sides[1:]:
        united = united.unionByName(side, allowMissingColumns=True)
    measures = [c for c in united.columns if c not in keys]
    return united.groupBy(*keys).agg(*[F.max(c).alias(c) for c in measures])


def cumulative(history: DataFrame, day: DataFrame, keys: list[str]) -> DataFrame:
    """To-date sums: yesterday's to-date rows and today's rows, added by key."""
    measures = [c for c in history.columns if c not in keys]
    return history.unionByName(day).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])


def ratio(top: Column, bottom: Column, digits: int = 4) -> Column:
    """top / bottom rounded, 0 where the base is 0 or missing."""
    return F.round(F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0)), digits)
