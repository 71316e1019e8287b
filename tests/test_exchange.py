"""Database scans and sinks, the change source over failures and restarts, keyed buckets."""

import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.plans.runs import stream_session
from millrace.sources.changelog import table_changes
from millrace.sources.database import Database, batches_into, changed_since, create, scan
from millrace.sources.topics import keyed_table, read_keyed
from millrace.streaming.changes import query

BIG = 2**60


@pytest.fixture
def db():
    return Database(f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", {})


def test_scan_is_split_and_pushed_down(spark, db):
    rows = spark.createDataFrame([(BIG + i, f"n{i}", datetime(2025, 1, 1 + i % 28)) for i in range(100)] + [(None, "none", None)], "id long, name string, at timestamp")
    create(rows.withColumn("batch_no", F.lit(0).cast("long")), db, "t", "name VARCHAR(9)")
    put = batches_into(db, "t", connections=1)
    put(rows, 7)
    put(rows.limit(0), 8)
    back = scan(spark, db, "t", split="id", parts=4)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 101
    assert {r.id for r in back.collect()} == {None, *(BIG + i for i in range(100))} and {r.batch_no for r in back.collect()} == {7}
    some = changed_since(back, "at", "2025-01-10 00:00:00", after="2025-01-08 00:00:00").select("id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "*LessThanOrEqual(at" in plan and "*GreaterThan(at" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert sorted(r.id - BIG for r in some.collect()) == sorted(i for i in range(100) if 9 <= 1 + i % 28 <= 10)
    assert scan(spark, db, "t").count() == 101


def test_a_repeated_batch_is_there_once(spark, db):
    rows = spark.createDataFrame([(i,) for i in range(10)], "id long")
    create(rows.withColumn("batch_no", F.lit(0).cast("long")), db, "b")
    put = batches_into(db, "b", connections=2)
    for n in (0, 1, 0, 0):
        put(rows.repartition(5), n)
    got = scan(spark, db, "b")
    assert got.count() == 20 and {(r.batch_no, r["n"]) for r in got.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 10), (1, 10)}


def _log(spark, path, seq, rows, done=True):
    at = f"{path}/log/seq={seq}"
    spark.createDataFrame(rows, "op string, row string").write.parquet(at)
    if not done:
        import os

        os.remove(f"{at}/_SUCCESS")


def test_changes_are_handed_over_once(spark, tmp_path):
    own, path = stream_session(spark), str(tmp_path / "table")
    own.createDataFrame([(BIG + i, "é") for i in range(20)], "id long, v string").repartition(3).write.parquet(f"{path}/snapshot")
    own.range(1).write.parquet(f"{path}/position/value=2")
    for seq in (1, 2, 3):
        _log(own, path, seq, [("u", f'{{"id": {seq}}}')])
    got, broken = {}, [True]

    def put(batch, n):
        rows = sorted((r.phase, r.op, r.seq, r.row) for r in batch.collect())
        if n == 1 and broken:
            broken.clear()
            raise RuntimeError("the sink fails in the middle")
        got[n] = rows

    def run():
        q = query(table_changes(own, path), str(tmp_path / "state"), put).start()
        try:
            assert q.awaitTermination(120)
        except Exception:
            return "failed"

    run()
    assert [r[0] for r in got[0]].count("snapshot") == 20 and [r[2] for r in got[0] if r[0] == "log"] == [3]
    assert {r[3] for r in got[0] if r[0] == "snapshot"} == {f'{{"id": {BIG + i}, "v": "\\u00e9"}}' for i in range(20)}
    # The log grows; 5 is there, but 4 is not complete yet, so neither is read.
    _log(own, path, 5, [("d", None)])
    run()
    assert list(got) == [0]
    _log(own, path, 4, [("c", '{"id": 4}'), ("u", '{"id": 5}')])
    assert run() == "failed" and list(got) == [0]
    run()
    assert got[1] == [("log", "c", 4, '{"id": 4}'), ("log", "d", 5, None), ("log", "u", 4, '{"id": 5}')]
    run()
    assert sorted(got) == [0, 1]


def test_an_empty_table_has_no_changes(spark, tmp_path):
    own = stream_session(spark)
    got = []
    q = query(table_changes(own, str(tmp_path / "none")), str(tmp_path / "state"), lambda b, n: got.extend(b.collect())).start()
    assert q.awaitTermination(120) and got == []


def test_keyed_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string, n int"
    put = keyed_table(path, ["k"], ["n"], buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert read_keyed(spark, path, schema).count() == 0
    # The first batch that the table sees needn't be number 0.
    put(frame([(BIG + i, "a", 1) for i in range(40)] + [(None, "x", 1)]), 5)
    put(frame([(BIG + 3, "b", 2), (BIG + 4, "old", 0)]), 6)
    put(frame([(BIG + 3, "b", 2), (BIG + 4, "old", 0)]), 6)
    got = {r.k - BIG: r.v for r in read_keyed(spark, path, schema).collect()}
    assert got == {i: "b" if i == 3 else "a" for i in range(40)}
    import os

    # Only the buckets of the two keys were written again.
    assert 1 <= sum(p.startswith("_bucket=") for p in os.listdir(f"{path}/version=6")) <= 2
    put(frame([]), 7)
    assert read_keyed(spark, path, schema).count() == 40
