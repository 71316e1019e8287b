"""Building dimensions: hierarchies, attribute sets, calendars, rule texts, category trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def not_deleted(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """Rows whose soft-delete flag is '0'; a null flag counts as deleted."""
    return df.where(F.col(flag) == "0")


def chain(df: DataFrame, levels: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """df with the levels above it, by left joins of fixed depth.

    A level is (rows, their key, df's column that names it); a level's columns
    may name the next.
    """
    for rows, key, column in levels:
        up = rows.withColumnRenamed(key, f"_{key}")
        df = df.join(up, F.col(column) == F.col(f"_{key}"), "left").drop(f"_{key}")
    return df


def attribute_sets(rows: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """(key, name): each key's distinct attribute structs, sorted.

    Attributes of a key are few, as those of a product; pass no key that may
    hold an unbounded number.
    """
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(*fields))).alias(name))


def labelled(code: Column, labels: dict[str, str], other: str | None = None) -> Column:
    """A code's label; unknown codes give `other`."""
    out = F.lit(other).cast("string")
    for k, label in labels.items():
        out = F.when(code == k, label).otherwise(out)
    return out


def rule_text(code: Column, rules: dict[str, tuple[str | Column, ...]]) -> Column:
    """A benefit's text by the code of its rule: the rule's parts joined, columns by their value; unknown codes give null."""
    out = F.lit(None).cast("string")
    for k, parts in rules.items():
        out = F.when(code == k, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])).otherwise(out)
    return out


def pattern_kind(text: Column, kinds: dict[str, str], other: str) -> Column:
    """The kind of the first pattern (a plain piece of text) that the text contains, in the order of `kinds`."""
    out = F.lit(other)
    for piece, kind in reversed(kinds.items()):
        out = F.when(F.contains(text, F.lit(piece)), kind).otherwise(out)
    return out


def calendar(spark: SparkSession, first: str, days: int) -> DataFrame:
    """calendar_of() of a row per day from first (yyyy-MM-dd) on."""
    start = F.to_date(F.lit(first))
    return calendar_of(spark.range(1).select(F.explode(F.sequence(start, F.date_add(start, days - 1))).alias("dt")))


def calendar_of(rows: DataFrame) -> DataFrame:
    """Days (dt) with their calendar parts; weeks are ISO weeks, Monday is day 1."""
    weekday = F.weekday("dt") + 1
    return rows.select(
        "dt",
        F.year("dt").alias("year"),
        F.quarter("dt").alias("quarter"),
        F.month("dt").alias("month"),
        F.dayofmonth("dt").alias("day"),
        F.extract(F.lit("YEAROFWEEK"), F.col("dt")).cast("int").alias("iso_year"),
        F.weekofyear("dt").alias("week"),
        weekday.alias("weekday"),
        (weekday >= 6).cast("int").alias("is_weekend"),
    )


def levels_of(df: DataFrame, columns: list[str], count: str) -> DataFrame:
    """(level, name, parent, count) of the hierarchy that columns make, outermost first: a row per value of each level under its parents.

    A name is its values joined by ' / '; rows with a null on the way end at the
    level before it.
    """
    tree = None
    for k in range(1, len(columns) + 1):
        name, parent = F.concat_ws(" / ", *columns[:k]), F.concat_ws(" / ", *columns[: k - 1]) if k > 1 else F.lit(None).cast("string")
        rows = df.where(" and ".join(f"`{c}` is not null" for c in columns[:k]))
        level = rows.groupBy(F.lit(k).alias("level"), name.alias("name"), parent.alias("parent")).agg(F.count(F.lit(1)).alias(count))
        tree = level if tree is None else tree.unionByName(level)
    return tree
