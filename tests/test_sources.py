"""Readers, topics, change records and relation types on small fixtures."""

import json
from datetime import date

from pyspark.sql import functions as F

from millrace.operators import facts
from millrace.operators.text import main_relation, relation_types
from millrace.sources import files, topics
from millrace.streaming import changes as ch
from millrace.plans.runs import stream_session
from millrace.streaming import metrics, state


def _file(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_csv_readers(spark, tmp_path):
    path = _file(tmp_path, "a.csv", 'id,full name\n1,"a\nb"\n2,c\n')
    assert files.csv_table(spark, _file(tmp_path, "n.csv", "id,v\n1,2.5\n")).dtypes == [("id", "int"), ("v", "double")]
    assert {r.name for r in files.renamed_csv(spark, path, {"full name": "name"}).collect()} == {"a b", "c"}
    both = files.platform_files(spark, {"x": path, "y": path})
    assert both.count() == 4 and {r["full name"] for r in both.collect()} == {"ab", "c"}
    regions = files.region_codes(spark, _file(tmp_path, "r.txt", "11 P,C,A\n12 P\n")).collect()
    assert [(r.province, r.city, r.area) for r in regions] == [("P", "C", "A"), ("P", None, None)]


def test_json_lines_and_words(spark, tmp_path):
    rows, bad = files.json_lines(spark, _file(tmp_path, "j.txt", '{"a": 1, "b": {"c": 2}}\n\n  \n{oops\n'), "a int, b string")
    assert [(r.a, json.loads(r.b)) for r in rows.collect()] == [(1, {"c": 2})] and bad.count() == 1
    assert sorted(r.word for r in files.word_list(spark, _file(tmp_path, "w.txt", " x \n\nx\r\ny\n")).collect()) == ["x", "y"]


def test_types_and_days(spark):
    assert [files.warehouse_type(t) for t in ("bigint", "INT(11)", "varchar(20)", "decimal(10,2)", "bigint(20) unsigned", "geometry")] == ["bigint", "int", "string", "decimal(10,2)", "decimal(20,0)", "string"]
    df = spark.createDataFrame([("1", "2025-07-01 23:59:59"), ("2", "2025-07-02 00:00:00")], "id string, create_time string")
    df = files.typed(df, {"id": "bigint", "create_time": "datetime"})
    assert df.dtypes == [("id", "bigint"), ("create_time", "timestamp")]
    assert [(r.id, r.ds) for r in files.changed_on(df, "create_time", date(2025, 7, 2)).collect()] == [(2, "20250702")]
    assert files.full_day(df, date(2025, 7, 3)).select("ds").distinct().collect()[0].ds == "20250703"
    assert files.renamed_with(files.camel_columns(df), "createTime", "made", "why", F.lit("x")).columns == ["id", "made", "why"]


def test_topics(spark, tmp_path):
    raw = spark.createDataFrame([('{"k": 1, "n": 1, "to": "t"}',), ("oops",), (None,), ('{"k": 1, "n": 2, "to": null}',)], "value string")
    assert topics.texts(raw).where("value = ''").count() == 1 and topics.texts(raw, null_safe=False).count() == 3
    rows = topics.typed_topic(raw, "k int, n int, to string")
    assert rows.count() == 2
    assert {r.topic for r in topics.routed_messages(rows, F.col("to"), "rest").collect()} == {"t", "rest"}
    got = []
    topics.upsert(lambda d, i: got.extend(topics.messages(d, ["k", "n"]).collect()), ["k"], ["n"])(rows, 0)
    assert [r.key for r in got] == ["1_2"] and json.loads(got[0].value)["n"] == 2
    topics.to_days(str(tmp_path / "d"), "ts")(rows.withColumn("ts", F.lit("2025-07-01").cast("timestamp")), 3)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    assert topics.preview(rows.withColumn("topic", F.lit("a")), order=["n"]).count() == 1


ROW = "id long, v string"


def _changes(spark, rows):
    texts = [(json.dumps({"op": op, "before": None, "after": after, "source": {"table": t, "snapshot": snap}, "ts_ms": 1}),) for op, after, t, snap in rows]
    return spark.createDataFrame(texts, "value string")


def test_change_records(spark):
    raw = _changes(spark, [("r", {"id": 1, "v": "a"}, "x", "true"), ("u", {"id": 1, "v": "b"}, "x", "false"), ("d", None, "x", "false"), ("c", {"id": 2, "v": "c"}, "z", "false")])
    good, bad = ch.change_records(raw.union(spark.createDataFrame([("{",)], "value string")), ROW)
    assert bad.count() == 1
    assert sorted((r.id, r.operation) for r in ch.appends(good).collect()) == [(1, "insert"), (1, "update"), (2, "insert")]
    assert {k: v.count() for k, v in ch.by_table(good, ["x", "y"]).items()} == {"x": 3, "y": 0, "rest": 1}
    config = spark.createDataFrame([("x", "delete", "gone", "id", "id"), ("x", None, "dim_x", "id,v", "id")], "source_table string, op string, sink_table string, sink_columns string, sink_row_key string")
    assert sorted(r.sink_table for r in ch.routed(good, config, "other").collect()) == ["dim_x", "dim_x", "gone", "other"]
    assert ch.routed(good, config).count() == 3
    assert "source" not in ch.slim(good).columns
    timed, late = ch.event_time(spark.createDataFrame([('{"t": 1700000000}',), ('{"t": 1700000000000}',), ('{"t": "x"}',)], "value string"), "value", "t")
    assert timed.select("event_time").distinct().count() == 1 and late.count() == 1


def _stream(spark, tmp_path, batches):
    for k, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(df, tmp_path, mode="append"):
    got = []
    run = ch.query(df, str(tmp_path / "cp"), lambda d, i: got.extend(d.collect()), mode=mode).start()
    assert run.awaitTermination(90) and run.exception() is None
    return got


def test_snapshot_phase(spark, tmp_path):
    spark = stream_session(spark, timers=True, **state.ROCKS)
    first, _ = ch.change_records(_changes(spark, [("r", {"id": 1, "v": "a"}, "x", "true"), ("r", {"id": 2, "v": "b"}, "x", "true")]), ROW)
    then, _ = ch.change_records(_changes(spark, [("u", {"id": 2, "v": "c"}, "x", "false")]), ROW)
    stream = _stream(spark, tmp_path, [d.withColumn("db", F.lit("d")) for d in (first, then, then)])
    assert sorted(r.phase for r in _run(state.snapshot_phases(stream, "db", silence_ms=600_000), tmp_path)) == ["completed", "snapshot", "snapshot"]


def test_first_visit_streams(spark, tmp_path):
    spark = stream_session(spark, timers=True, **state.ROCKS)
    days = [[("a", date(2025, 7, 1)), ("a", date(2025, 7, 2))], [("a", date(2025, 7, 3)), ("b", date(2025, 7, 3)), ("c", None)]]
    stream = _stream(spark, tmp_path, [spark.createDataFrame(d, "device string, dt date") for d in days])
    got = _run(state.first_visits(stream, "device", "dt"), tmp_path)
    assert sorted((r.device, r.dt.day if r.dt else 0, r.is_new) for r in got) == [("a", 1, 1), ("a", 2, 0), ("a", 3, 0), ("b", 3, 1), ("c", 0, 0)]


def test_trade_windows_stream_as_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, "order", 1, 5.0), (2, 7, "order", 1, 5.0), (3, 7, "payment", 1, 4.0), (4, 8, "refund", 2, 1.0), (15, 7, "order", 2, 2.0)], "s long, sku long, event_type string, user_id long, amount double").withColumn("ts", F.timestamp_seconds("s"))
    table = {tuple(r) for r in metrics.trade_stats(rows, "ts", ["sku"]).collect()}
    assert {(r[3], r[4], r[6]) for r in table} == {(2, 1, 1), (1, 1, 0)}
    # In append mode windows come out once a later row has closed them; its own stays open.
    spark = stream_session(spark)
    closing = spark.createDataFrame([(999, 7, "order", 1, 0.0)], rows.drop("ts").schema).withColumn("ts", F.timestamp_seconds("s"))
    assert {tuple(r) for r in _run(metrics.trade_stats(_stream(spark, tmp_path, [rows, closing]), "ts", ["sku"]), tmp_path)} == table


def test_stage_daily_counts_a_stage_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, status string")
    new = spark.createDataFrame([(4, "a")], "id int, status string")
    now = spark.createDataFrame([(1, "c"), (2, "c")], "id int, status string")
    reached = lambda at: sorted(r.id for r in facts.stage_daily(old, new, now, "id", "status", ["a", "b", "c"], at, F.lit(date(2025, 7, 1))).collect())
    assert [reached(0), reached(1), reached(2)] == [[4], [1], [1, 2]]


def test_relation_types(spark):
    pairs = spark.createDataFrame([("Ann", "Bob", "Bob met his friend Ann"), ("Ann", "Bob", "Ann, friend and foe of Bob"), ("Ann", "Cid", "foe Ann Cid"), ("Ann", "Bob", None)], "a string, b string, sentence string")
    found = relation_types(pairs, {"love": ["friend"], "war": ["foe", "enemy"]})
    assert sorted((r.a, r.b, r.relation, r.n) for r in found.collect()) == [("Ann", "Bob", "love", 2), ("Ann", "Bob", "war", 1)]
    assert [tuple(r) for r in main_relation(found, ["love", "war"]).collect()] == [("Ann", "Bob", "love")]
