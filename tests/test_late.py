"""Late rows, closing windows, lifetimes, timers and restarts of streams."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.plans import late
from millrace.plans import runs as plan_runs
from millrace.plans.late import replayed
from millrace.plans.runs import stream_session
from millrace.streaming import closed, joins, metrics, state
from millrace.streaming.changes import query

BIG = 2**60
T0 = datetime(2025, 3, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def runs(session, tmp_path, batches, schema, build, put):
    """One run per batch from the same checkpoint; the state operators' progress after each."""
    out = []
    for rows in batches:
        session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = session.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run = query(build(stream), str(tmp_path / "state"), put).start()
        assert run.awaitTermination(120)
        out.append([(s.operatorName, s.numRowsTotal) for s in run.lastProgress.stateOperators])
    return out


EVENT = "ts timestamp, user_id long, kind string, amount double"


def test_windows_close_once_and_state_shrinks(spark, tmp_path):
    own, got = stream_session(spark), []
    batches = [
        [(at(m), BIG + m % 3, "a", 1.0) for m in range(60)],
        # The first ten minutes are closed by now; 58 is late by the clock, but its window is open.
        [(at(5), BIG + 9, "a", 100.0), (at(58), None, "a", 2.0), (at(100), BIG, "a", 4.0)],
        [(at(500), BIG, "a", 8.0)],
    ]
    build = lambda s: closed.user_windows(s, "ts", "10 minutes", ["kind"], {"all": F.lit(True), "none": F.col("kind") == "b"}, user="user_id", amount="amount", delay="5 minutes")
    sizes = runs(own, tmp_path, batches, EVENT, build, lambda b, _: got.extend(b.collect()))
    rows = {(r.window_start - T0).seconds // 60: (r.all_ct, r.all_user_ct, r.all_amount, r.none_ct, r.none_user_ct, r.none_amount) for r in got}
    want = {m: (10, 3, 10.0, 0, 0, None) for m in range(0, 50, 10)} | {50: (11, 3, 12.0, 0, 0, None), 100: (1, 1, 4.0, 0, 0, None)}
    assert rows == want and len(got) == len(want)
    # At the end only the last row's window is held, by both aggregations one row at most.
    assert sum(n for _, n in sizes[-1]) <= 2 < sum(n for _, n in sizes[0])


def test_windows_of_tables_have_no_lateness(spark):
    rows = spark.createDataFrame([(at(0), 1, "a", 1.0), (at(500), None, "a", 2.0), (at(1), 1, "a", None)], EVENT)
    got = closed.user_windows(rows, "ts", "10 minutes", [], {"all": F.lit(True)}, user="user_id").collect()
    assert sorted((r.all_ct, r.all_user_ct) for r in got) == [(1, 0), (2, 1)]
    assert closed.user_windows(rows.limit(0), "ts", "10 minutes", [], {"all": F.lit(True)}, user="user_id").count() == 0


def test_metrics_of_streams_are_those_of_tables(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_type string, amount double, item long"
    kinds = ("order", "payment", "refund", "consult", "display", "click")
    rows = [(at(m), BIG + m % 7 if m % 5 else None, kinds[m % 6], float(m), m % 4) for m in range(120)]
    table, own = spark.createDataFrame(rows, schema), stream_session(spark)
    last = own.createDataFrame([(at(9000), 1, k, 0.0, 1) for k in kinds], schema)
    makers = {
        "trade": lambda d: metrics.trade_stats(d, "ts", ["item"], width="20 minutes"),
        "kind": lambda d: metrics.kind_stats(d, "ts", ["item"], "payment", width="20 minutes"),
        "views": lambda d: metrics.views_and_users(d, "ts", [], width="20 minutes"),
        "shown": lambda d: metrics.displays(d, "ts", [], width="20 minutes"),
        "revenue": lambda d: metrics.revenue(d, "ts", width="20 minutes"),
        "days": lambda d: metrics.product_days(d, "ts", "item"),
    }
    for name, make in makers.items():
        source = own.createDataFrame(rows, schema).withColumn("batch", F.lit(0)).unionByName(last.withColumn("batch", F.lit(1)))
        got = replayed(source, lambda _, s, make=make: make(s))
        want = make(table)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), name


def test_late_rows_have_an_output_of_their_own(spark, tmp_path):
    own, parts = stream_session(spark), {"late": {}, "on_time": {}}
    to = lambda name: lambda b, n: parts[name].update({n: [((r.ts - T0).seconds // 60 if r.ts else None) for r in b.collect()]})
    split = closed.late_split("ts", "10 minutes", "5 minutes", str(tmp_path / "marks"), to("on_time"), to("late"))
    batches = [[(at(m), 1, "a", 1.0) for m in (1, 40)], [(at(2), 1, "a", 1.0), (at(33), 1, "a", 1.0), (None, 1, "a", 1.0)]]
    runs(own, tmp_path, batches, EVENT, lambda s: s, split)
    assert sorted(parts["on_time"][0]) == [1, 40] and parts["late"][0] == []
    assert parts["on_time"][1] == [33] and sorted(parts["late"][1], key=str) == [2, None]
    # A batch that is run again is split as before, even though its own times are known by now.
    again = own.createDataFrame(batches[0], EVENT)
    split(again, 0)
    assert sorted(parts["on_time"][0]) == [1, 40] and parts["late"][0] == []


def test_state_goes_on_after_a_restart(spark, tmp_path):
    own = stream_session(spark, timers=True, **state.ROCKS)
    rows = [(BIG + i % 5, (T0 + timedelta(days=(i * 7) % 11)).date(), i if i % 4 else None, i) for i in range(80)]
    schema = "user long, day date, version long, arrival long"
    makers = {"first": lambda s: state.first_visits(s, "user", "day"), "newest": lambda s: state.newest_versions(s, "user", "version", ["arrival"])}
    for name, make in makers.items():
        frame = own.createDataFrame(rows, schema)
        whole = replayed(frame.withColumn("batch", F.lit(0)), lambda _, s, make=make: make(s)).collect()
        parts = replayed(frame.withColumn("batch", F.floor(F.col("arrival") / 20)), lambda _, s, make=make: make(s)).collect()
        seen, want = {}, []
        for u, d, v, a in rows:
            if name == "newest":
                if v is not None and v > seen.get(u, -1):
                    seen[u] = v
                    want.append((u, v))
        if name == "newest":
            assert sorted((r.user, r.version) for r in parts) == sorted((r.user, r.version) for r in whole) == sorted(want)
        else:
            assert {r.user for r in parts} == {BIG + i for i in range(5)} and len(parts) == len(whole) == 80
            for batch, got in ((80, whole), (20, parts)):
                for r in got:
                    upto = (r.arrival // batch + 1) * batch
                    assert r.is_new == int(r.day == min(d for u, d, _, a in rows if u == r.user and a < upto))


def clocked(df, tmp_path, done, seconds=90):
    rows = []
    run = query(df, str(tmp_path / "clock"), lambda b, _: rows.extend(b.collect()), every="1 second").start()
    try:
        end = time.time() + seconds
        while not done(rows) and time.time() < end and run.exception() is None:
            time.sleep(0.5)
        assert run.exception() is None
    finally:
        run.stop()
    return rows


def test_timers_close_windows_of_arrival(spark, tmp_path):
    own = stream_session(spark, **state.ROCKS)
    rows = [("k", 1.0), ("k", 5.0), ("m", None)]
    own.createDataFrame(rows, "key string, value double").write.parquet(str(tmp_path / "in"))
    stream = own.readStream.schema("key string, value double").parquet(str(tmp_path / "in"))
    out = clocked(state.arrival_windows(stream, ["key"], "value", width_ms=3000), tmp_path, lambda got: sum(r.n for r in got) == 3)
    # No more rows come, and yet the windows close.
    assert sorted((r.key, r.n, r.total, r.least, r.most) for r in out) == [("k", 2, 6.0, 1.0, 5.0), ("m", 1, 0.0, None, None)]
    assert all(r.window_end_ms - r.window_start_ms == 3000 and r.window_start_ms % 3000 == 0 and r.window_end_ms <= time.time() * 1000 for r in out)


def test_silence_and_live_rows_end_a_snapshot(spark, tmp_path):
    own = stream_session(spark, **state.ROCKS)
    schema = "key string, op string, source struct<table:string,snapshot:string>, n long"
    rows = [("quiet", "r", ("t", "true"), BIG), ("quiet", "r", ("t", "true"), None), ("live", "r", ("t", "true"), 1), ("live", "u", ("t", "false"), 2)]
    own.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = clocked(state.snapshot_phases(stream, "key", silence_ms=2000), tmp_path, lambda got: sum(r.phase == "completed" for r in got) == 2)
    assert sorted((r.key, r.phase, str(r.n)) for r in out) == sorted([("quiet", "snapshot", str(BIG)), ("quiet", "snapshot", "None"), ("live", "snapshot", "1"), ("quiet", "completed", "None"), ("live", "completed", "None")])


def test_a_lifetime_removes_state(spark, tmp_path):
    own = stream_session(spark, timers=True, **state.ROCKS)
    got = []
    build = lambda s: state.newest_versions(s, "user", "version", ["version"], lifetime_ms=1500)
    for batch in ([(1, 10)], [(1, 5)]):
        runs(own, tmp_path, [batch], "user long, version long", build, lambda b, _: got.extend(r.version for r in b.collect()))
        time.sleep(2)
    # The second is older, but the first is forgotten.
    assert got == [10, 5]


def test_rough_repeats_keep_their_bounds(spark, tmp_path):
    own = stream_session(spark, timers=True, **state.ROCKS)
    n, error = 6000, 0.02
    rows = [(i % n, i) for i in range(2 * n)]
    frame = own.createDataFrame(rows, "item long, seq long").withColumn("slot", F.col("item") % 2).withColumn("batch", F.floor(F.col("seq") / 3000))
    out = replayed(frame, lambda _, s: state.drop_repeats_roughly(s, ["item"], "slot", items=n // 2, error=error))
    passed = [r.item for r in out.collect()]
    # No repeat passes, and new items are lost within the stated rate.
    assert len(passed) == len(set(passed)) and n * (1 - 2 * error) <= len(passed) <= n
    bits, hashes = state.bloom_size(n, error / 2)
    assert bits / 8 < 1.3 * n and 5 <= hashes <= 8


def test_pairs_that_the_filter_takes_for_known_are_checked(spark, tmp_path, monkeypatch):
    # A filter that is wrong for many of the new pairs.
    monkeypatch.setattr(late, "SLOT_ERROR", 0.6, raising=False)
    monkeypatch.setattr(late, "SLOT_ITEMS", 20, raising=False)
    rough = state.drop_repeats_roughly
    monkeypatch.setattr(late, "drop_repeats_roughly", lambda df, keys, slot, **how: rough(df, keys, slot, **{**how, "items": 20, "error": 0.6}))
    rows = [(i, T0, i % 700 if i % 50 else None, "view", 1.0, f'{{"k": {i % 3}}}' if i % 7 else None) for i in range(1500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = [(r.user_id, r.item) for r in late.stream_rough_repeats(spark, str(tmp_path)).collect()]
    want = {(u, i % 3 if p else None) for i, _, u, _, _, p in rows}
    assert len(got) == len(set(got)) and set(got) == want


def test_arrivals_come_in_as_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plan_runs, "FILE_ROWS", 9, raising=False)
    # The table's files hold ranges of ids, so batches meet different numbers of them.
    for low in range(0, 300, 60):
        spark.range(low, low + 60, 1, 1).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.lit(T0).alias("ts")).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    own, got = stream_session(spark), {}
    stream = plan_runs.arrivals(own, str(tmp_path), closing=True)
    assert query(stream, str(tmp_path / "state"), lambda b, n: got.update({n: [r.event_id for r in b.collect()]})).start().awaitTermination(120)
    batches = [sorted(ids) for ids in got.values() if ids]
    assert len(batches) == plan_runs.BATCHES + 1 and batches[-1] == [None]
    assert [i for ids in batches[:-1] for i in ids] == list(range(300))


def test_old_generations_go(spark):
    own = stream_session(spark, timers=True, **state.ROCKS)
    rows = [(i, i) for i in range(300)] + [(0, 300), (299, 301)]
    frame = own.createDataFrame(rows, "item long, seq long").withColumn("slot", F.lit(0)).withColumn("batch", F.lit(0))
    out = [r.seq for r in replayed(frame, lambda _, s: state.drop_repeats_roughly(s, ["item"], "slot", items=50, error=1e-9)).collect()]
    # 0 is forgotten after two generations of 50, 299 isn't.
    assert len(out) == 301 and 300 in out and 301 not in out


def test_configuration_of_tables(spark):
    rows = spark.createDataFrame([(1, "k", at(5)), (2, "k", at(10)), (3, "m", at(10)), (4, None, at(10)), (5, "k", None)], "id long, key string, ts timestamp")
    config = spark.createDataFrame([("k", at(5), 1, "old"), ("k", at(5), 2, "new"), ("k", at(10), 1, None), ("x", at(0), 1, "other")], "key string, valid_from timestamp, version long, sink string")
    got = joins.as_configured(rows, config, key="key", ts="ts", valid_from="valid_from", version="version", value="sink", fallback="rest").collect()
    assert {r.id: r.sink for r in got} == {1: "new", 2: None, 3: "rest", 4: "rest", 5: "rest"}


def test_wide_join_of_tables(spark):
    left = spark.createDataFrame([(1, at(0)), (2, at(0)), (None, at(0))], "id long, ts timestamp")
    a = spark.createDataFrame([(1, at(5), "x"), (1, at(50), "late"), (None, at(1), "null")], "a_id long, a_ts timestamp, a string")
    b = spark.createDataFrame([(2, at(-1), "before"), (1, at(0), "y")], "b_id long, b_ts timestamp, b string")
    got = joins.wide_join(left, "ts", [(a, [("id", "a_id")], "a_ts"), (b, [("id", "b_id")], "b_ts")], within="10 minutes", delay="1 minute").collect()
    assert sorted((str(r.id), r.a, r.b) for r in got) == [("1", "x", "y"), ("2", None, None), ("None", None, None)]


@pytest.mark.parametrize("items, error", [(1, 0.5), (20_000, 0.01)])
def test_bloom_size(items, error):
    bits, hashes = state.bloom_size(items, error)
    assert bits % 8 == 0 and hashes >= 1 and (1 - (1 - 1 / bits) ** (hashes * items)) ** hashes <= 1.2 * error
