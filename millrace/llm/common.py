"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which all executors share.

    Where that setting is missing (tests, local mode) one temporary folder per
    application stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        base = _own_dirs.setdefault(app, "") or tempfile.mkdtemp(prefix="millrace-")
        _own_dirs[app] = base
    return f"{base.rstrip('/')}/millrace/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def explode_shingles(df: DataFrame, word: str, keep: list[str], n: int = 5) -> DataFrame:
    """A row per run of n words: `keep`, `n_runs` (with repeats) and `run`, a struct of its words.

    Texts of 1 to n-1 words are one run (its last fields null); empty ones give
    none. Zipping shifted copies of the word array keeps hashing and joining of
    the words in generated code. The outer form of explode stops Spark from
    copying the whole expression into a filter.
    """
    runs = F.when(F.size(word) >= n, F.size(word) - (n - 1)).otherwise(F.least(F.size(word), F.lit(1)))
    shifted = [(F.slice(word, k + 1, F.size(word)) if k else F.col(word)).alias(f"w{k}") for k in range(n)]
    exploded = df.select(*keep, runs.alias("n_runs"), F.posexplode_outer(F.arrays_zip(*shifted)).alias("run_at", "run"))
    return exploded.where(F.col("run_at") < F.col("n_runs")).drop("run_at")


def run_hash(n: int = 5) -> Column:
    return F.xxhash64(*[F.col(f"run.w{k}") for k in range(n)])


def run_text(n: int = 5) -> Column:
    return F.concat_ws(" ", *[F.col(f"run.w{k}") for k in range(n)])


def sampled(ids: DataFrame, doc_id: str, most: int) -> DataFrame:
    """Rows of about `most` ids at most, those whose hash lies in the share that this leaves; one pass, no sort."""
    n = ids.count()
    if n <= most:
        return ids
    return ids.where(F.shiftrightunsigned(F.xxhash64(doc_id), 11) / 2.0**53 < most / n)
