"""Lookups of dimensions: by size-checked broadcast, with prefixed columns, fallback keys and templates."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of their columns as text, up to which a side is broadcast.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 256 << 20


def is_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES) -> bool:
    """Is df counted to have so many rows and bytes at most?"""
    width = F.lit(0).cast("long")
    for c in df.columns:
        width = width + 8 + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return seen["rows"] <= rows and seen["size"] <= size


def small_broadcast(df: DataFrame, rows: int = MAX_BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is counted to have so many rows and bytes at most; else as it is, and the join shuffles."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def lookup(df: DataFrame, dim: DataFrame, key: Column, dim_key: str, *, prefix: str = "dim_", keep: bool = True) -> DataFrame:
    """df (a table or a stream) with the dimension's columns, their names prefixed.

    A key that is null or not in the dimension passes with nulls, or goes
    without keep. Dimension keys are unique. A stream meets the dimension as it
    is when a micro-batch starts.
    """
    renamed = dim.select(*[F.col(c).alias(f"{prefix}{c}") for c in dim.columns])
    return df.join(renamed, key == renamed[f"{prefix}{dim_key}"], "left" if keep else "inner")


def lookup_first(df: DataFrame, dim: DataFrame, keys: list[Column], dim_key: str, columns: list[str]) -> DataFrame:
    """lookup() by the first of several keys that isn't null; the dimension's columns overwrite those of df where it has a row."""
    found = lookup(df.withColumn("_key", F.coalesce(*keys)), dim.select(dim_key, *[c for c in columns if c != dim_key]), F.col("_key"), dim_key, prefix="_dim_")
    own = [c for c in df.columns if c not in columns]
    value = lambda c: F.coalesce(F.col(f"_dim_{c}"), F.col(c)) if c in df.columns else F.col(f"_dim_{c}")
    return found.select(*own, *[value(c).alias(c) for c in columns])


def lookup_batches(read_dim: Callable[[], DataFrame], key: str, dim_key: str, put: Callable[[DataFrame, int], None], *, prefix: str = "dim_") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every batch reads the dimension anew, looks it up and passes its rows on to put."""
    return lambda batch, n: put(lookup(batch, read_dim(), F.col(key), dim_key, prefix=prefix), n)


def cached(read_dim: Callable[[], DataFrame], lifetime: float, store: Callable[[DataFrame], DataFrame], *, clock: Callable[[], float] = time.monotonic) -> Callable[[], DataFrame]:
    """read_dim with a memory: what it has read is kept as a stored table and read anew only after `lifetime` seconds.

    For lookup_batches(): batches within a lifetime meet the same rows of the
    dimension, even when an executor is lost, and spare its source. store
    writes a frame to a table and reads it back.
    """
    held: dict = {}

    def read() -> DataFrame:
        now = clock()
        if not held or now - held["at"] >= lifetime:
            held.update(at=now, rows=store(read_dim()))
        return held["rows"]

    return read


def interval_join(left: DataFrame, right: DataFrame, key: str, ts: str, *, before: str, after: str, prefix: str = "info_", delay: str = "1 hour") -> DataFrame:
    """Rows of left with each row of right of the same key whose time lies from `before` ahead of to `after` behind its own.

    Columns of right are prefixed. Both sides of a stream are watermarked, so
    its state is bounded by the interval and the delay.
    """
    if left.isStreaming:
        left, right = left.withWatermark(ts, delay), right.withWatermark(ts, delay)
    other = right.select(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns])
    near = (other[f"{prefix}{ts}"] >= left[ts] - F.expr(f"interval {before}")) & (other[f"{prefix}{ts}"] <= left[ts] + F.expr(f"interval {after}"))
    return left.join(other, (left[key] == other[f"{prefix}{key}"]) & near)


def insert_missing(have: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """have and those of rows whose keys it lacks, one row per key."""
    fresh = rows.dropDuplicates(keys).join(have.select(*keys), keys, "left_anti")
    return have.unionByName(fresh.select(*have.columns))
