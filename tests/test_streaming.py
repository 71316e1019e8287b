"""Streams from files, against their static twins."""

import json

from pyspark.sql import functions as F

from millrace.plans.runs import stream_session
from millrace.streaming.events import latest_sink, newest_only, parsed, split_log, windowed
from millrace.streaming.state import ROCKS


def test_dirty_rows_are_split_off(spark):
    good, bad = parsed(spark.createDataFrame([('{"a": 1}',), ("{oops",), (None,)], "value string"), "a int")
    assert [r.a for r in good.collect()] == [1]
    assert {r.value for r in bad.collect()} == {"{oops", None}


def test_log_is_split(spark):
    rows = [{"common": "c", "page": "p", "displays": ["d", "e"], "actions": ["x"], "ts": 1}, {"common": "c", "start": "s", "ts": 2}, {"common": "c", "page": "q", "err": "bad", "ts": 3}]
    good, _ = parsed(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"), "common string, page string, displays array<string>, actions array<string>, start string, err string, ts long")
    assert {k: v.count() for k, v in split_log(good).items()} == {"err": 1, "start": 1, "displays": 2, "actions": 1, "page": 2}


def _stream(spark, tmp_path, rows, schema):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_newest_only_streams(spark, tmp_path):
    spark = stream_session(spark, timers=True, **ROCKS)
    stream = _stream(spark, tmp_path, [[(1, 5, 0), (1, 4, 1), (2, 1, 2)], [(1, 5, 3), (1, 6, 4), (2, None, 5)]], "k long, v long, n long")
    run = newest_only(stream, "k", "v", "n").writeStream.outputMode("append").foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(str(tmp_path / f"out/b={i}"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(60) and run.exception() is None
    got = {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 5), (2, 1), (1, 6)}


def test_windows_stream_into_the_latest_sink(spark, tmp_path):
    stream = _stream(spark, tmp_path, [[(1, "a")], [(61, "a"), (2, "a")]], "s long, k string").withColumn("ts", F.timestamp_seconds("s"))
    counts = windowed(stream, "ts", "1 minute", ["k"], [F.count(F.lit(1)).alias("n")], delay="5 minutes")
    run = counts.writeStream.outputMode("update").foreachBatch(latest_sink(str(tmp_path / "out"), ["k", "window_start"], ["n"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(60) and run.exception() is None
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("k", "window_start").agg(F.max("n").alias("n")).collect()) == [1, 2]
