"""Folders for intermediate tables and for the state of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; where that isn't set (tests) a folder of this machine stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="millrace-streams-")
        base = _own[app]
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in such a folder."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
