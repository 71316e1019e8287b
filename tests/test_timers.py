"""State that time alone changes: silence ends a snapshot, a lifetime forgets a device."""

import time

import pytest

from millrace.plans.runs import stream_session
from millrace.streaming import changes as ch
from millrace.streaming import state

ROW = "id long, v string"


@pytest.fixture
def timers(spark):
    return stream_session(spark, **state.ROCKS)


def _run(df, tmp_path, done, seconds=60):
    """The rows that the stream has put out when `done` of them holds, or after so many seconds."""
    rows = []
    run = ch.query(df, str(tmp_path / "state"), lambda batch, _: rows.extend(batch.collect()), every="1 second").start()
    try:
        end = time.time() + seconds
        while not done(rows) and time.time() < end and run.exception() is None:
            time.sleep(0.5)
        assert run.exception() is None
    finally:
        run.stop()
    return rows


def test_silence_ends_a_snapshot(tmp_path, timers):
    spark = timers
    rows = [("k", "r", (("t", "true"))), ("k", "r", (("t", "true")))]
    schema = "key string, op string, source struct<table:string,snapshot:string>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = _run(state.snapshot_phases(stream, "key", silence_ms=2000), tmp_path, lambda got: any(r.phase == "completed" for r in got))
    assert sorted((r.key, r.phase) for r in out) == [("k", "completed"), ("k", "snapshot"), ("k", "snapshot")]


def test_a_lifetime_forgets_a_device(tmp_path, timers):
    spark = timers
    schema = "device string, day date"
    write = lambda day: spark.sql(f"select 'd' as device, date '{day}' as day").write.mode("append").parquet(str(tmp_path / "in"))
    write("2025-01-01")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {"at": None}

    def done(rows):
        if rows and seen["at"] is None:
            seen["at"] = time.time()
        if seen["at"] and time.time() - seen["at"] > 6 and seen["at"] > 0:
            write("2025-02-02")  # long after the lifetime
            seen["at"] = -1
        return len(rows) == 2

    out = _run(state.first_visits(stream, "device", "day", lifetime_ms=2000), tmp_path, done)
    assert [(str(r.day), r.is_new) for r in out] == [("2025-01-01", 1), ("2025-02-02", 1)]
