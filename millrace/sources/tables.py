"""Reading the test tables with the types that the metric queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ordered events of a day are attributed to calendar dates in this zone.
ZONE = "UTC"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str):
    """Amounts are summed as decimals, so that totals don't depend on order."""
    return F.col(column).cast("decimal(18,2)")
