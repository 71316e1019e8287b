"""Window operators: ranks, top-n, latest row per key, shares, gaps, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def top_ranked(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rk") -> DataFrame:
    """Rows of rank n or better within keys; ties are kept."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.rank().over(window)).where(F.col(name) <= n)


def global_rank(df: DataFrame, order: list[Column], name: str = "rk") -> DataFrame:
    """Rank over all rows. One task sorts them, so df is an aggregate of few rows."""
    return df.withColumn(name, F.rank().over(Window.orderBy(*order)))


def range_starts(df: DataFrame, value: str, ranges: int) -> list:
    """Values that cut df into about `ranges` ranges of as many rows, highest first."""
    cuts = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    return sorted(set(cuts or []), reverse=True)


def rank_by_ranges(df: DataFrame, value: str, keys: list[str], starts: list, name: str) -> DataFrame:
    """rank() by value, highest first, within keys (over all rows without keys), a range of values at a time.

    A row's rank is that within its range plus the rows of its key in the
    ranges before, so no task sorts more than a key's rows of one range; equal
    values share a range.
    """
    above = F.size(F.filter(F.array(*map(F.lit, starts)), lambda x: x > F.col(value))) if starts else F.lit(0)
    ranged = df.withColumn("_range", F.when(F.col(value).isNull(), len(starts) + 1).otherwise(above))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(own), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = F.rank().over(Window.partitionBy(*keys, "_range").orderBy(F.desc(value)))
    ranked = ranged.withColumn("_within", within).join(F.broadcast(before) if not keys else before, same)
    return ranked.select(*df.columns, (F.col("_within") + F.col("_before")).cast("int").alias(name))


def ranks_at_once(df: DataFrame, ids: list[str], measures: dict[str, str], *, within: list[str] | None = None, ranges: int = 64) -> DataFrame:
    """df with rank() by each measure (measure: name of its rank), highest first and nulls last, over all rows or within keys.

    Measures become rows, so that one pass cuts each into about `ranges` ranges
    of as many rows, one shuffle ranks all of them by ranges, and one more
    brings a row's ranks together. No task sorts more than one range of one
    measure, equal values apart. ids identify a row. df is read three times, so
    it should be a stored table.
    """
    keys = within or []
    tall = df.select(*ids, *keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("decimal(38,6)").alias("value")) for m in measures])).alias("_m")).select(*ids, *keys, "_m.measure", "_m.value")
    # One row of `ranges` numbers for each measure.
    cuts = tall.groupBy("measure").agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts"))
    tall = tall.join(F.broadcast(cuts), "measure", "left")
    above = F.size(F.filter(F.array_distinct(F.coalesce("cuts", F.array().cast("array<decimal(38,6)>"))), lambda x: x > F.col("value")))
    ranged = tall.withColumn("_range", F.when(F.col("value").isNull(), F.lit(ranges)).otherwise(above)).drop("cuts")
    counts = ranged.groupBy(*keys, "measure", "_range").agg(F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy(*keys, "measure").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "measure", "_range"])], F.coalesce(F.sum("_rows").over(own), F.lit(0)).alias("_before"))
    ranked = ranged.withColumn("_rank", F.rank().over(Window.partitionBy(*keys, "measure", "_range").orderBy(F.desc_nulls_last("value"))))
    same = F.lit(True)
    for i, k in enumerate([*keys, "measure", "_range"]):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # Without keys there are a few rows for each measure.
    whole = ranked.join(before if keys else F.broadcast(before), same).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("int"))
    wide = whole.groupBy(*[F.col(k).alias(f"_id{i}") for i, k in enumerate(ids)]).agg(*[F.max(F.when(F.col("measure") == m, F.col("_rank"))).alias(name) for m, name in measures.items()])
    met = F.lit(True)
    for i, k in enumerate(ids):
        met &= F.col(k).eqNullSafe(F.col(f"_id{i}"))
    return df.join(wide, met).drop(*[f"_id{i}" for i in range(len(ids))])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(own)).where("_nth = 1").drop("_nth")


def share(value: str, keys: list[str], name: str, digits: int = 4) -> Column:
    """value over its sum within keys, 0 where that is 0."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return F.round(F.coalesce(F.try_divide(F.col(value).cast("double"), total.cast("double")), F.lit(0.0)), digits).alias(name)


def gap_seconds(ts: str, keys: list[str], order: list[str], most: int = 86_400) -> Column:
    """Seconds since the key's previous row, within [0, most]; null for the first."""
    own = Window.partitionBy(*keys).orderBy(*order)
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(own)
    return F.when(gap.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(most), gap)))


def running_sum(value: str | Column, keys: list[str], order: list[str]) -> Column:
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(own)
