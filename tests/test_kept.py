"""State that lies in tables between the batches of a stream."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from millrace.queries import QUERIES
from millrace.streaming import joins, kept
from tests.test_queries import SF

BIG = 2**60
T0 = datetime(2025, 3, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_a_configuration_is_met_without_python_rows(spark, monkeypatch):
    monkeypatch.setattr(PandasGroupedOpsMixin, "transformWithState", None)
    assert QUERIES["stream_config_routes"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").where("event_type <> 'error' and props is not null").count()


@pytest.mark.parametrize("name", ["stream_visits_restarted", "stream_first_visits"])
def test_first_visits_are_met_without_python_rows(spark, monkeypatch, name):
    monkeypatch.setattr(PandasGroupedOpsMixin, "transformWithState", None)
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_rows_wait_for_their_configuration(spark, tmp_path):
    state, out = str(tmp_path / "kept"), {}
    step = joins.configured_into(lambda rows, n: out.update({n: sorted((r.id, r.sink) for r in rows.collect())}), state, value="sink", fallback="rest", delay="10 minutes")

    def run(n, rows, config=()):
        rows = spark.createDataFrame(rows, "id long, key string, ts timestamp")
        config = spark.createDataFrame(list(config), "key string, valid_from timestamp, version long, to string")
        step(joins.configured_rows(rows, config, key="key", ts="ts", valid_from="valid_from", version="version", value="to"), n)
        return out[n]

    assert run(0, [(BIG, "k", at(1)), (2, "k", at(5)), (3, None, at(1)), (4, "k", None)], [("k", at(0), 1, "a")]) == []
    # A later batch brings the version that was valid at 5; of equal times the greater one counts, null is the least.
    later = ([(5, "m", at(3)), (6, "k", at(30))], [("k", at(4), 2, "c"), ("k", at(4), None, "z"), ("k", at(4), 1, "b"), ("m", at(15), 1, None)])
    for _ in range(3):  # run again after a failure, with the same result
        assert run(1, *later) == [(2, "c"), (5, "rest"), (BIG, "a")]
    # At 20 the watermark: 7 comes too late, 8 doesn't. One version for each key and what is above it are kept.
    assert run(2, [(7, "k", at(20)), (8, "k", at(21)), (9, "m", at(50))], [("k", at(19), 9, "late")]) == [(6, "c"), (8, "c")]
    assert spark.read.parquet(f"{state}/rows/turn=0").count() == 3
    assert run(3, [(10, "x", at(90))]) == [(9, None)]
    assert run(4, []) == []


def test_first_days_of_devices(spark, tmp_path):
    state, out = str(tmp_path / "kept"), {}
    put = lambda rows, n: out.update({n: sorted((r.id, r.is_new) for r in rows.collect())})
    step = kept.first_visits_into(put, state, "device", "day", lifetime_ms=None)
    days = lambda *rows: spark.createDataFrame(list(rows), "id long, device long, day date")
    step(days((1, BIG, date(2025, 1, 2)), (2, BIG, date(2025, 1, 3)), (3, BIG, None), (4, 7, None), (5, None, date(2025, 1, 5))), 0)
    assert out[0] == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]
    for _ in range(3):
        step(days((6, BIG, date(2025, 1, 1)), (7, BIG, date(2025, 1, 2)), (8, 7, date(2025, 1, 9)), (9, None, date(2025, 1, 6)), (9, None, date(2025, 1, 5))), 1)
        assert out[1] == [(6, 1), (7, 0), (8, 1), (9, 0), (9, 1)]
    # BIG + 1 is another device, though not as a double.
    step(days((10, BIG, date(2025, 1, 2)), (11, BIG + 1, date(2025, 1, 2))), 2)
    assert out[2] == [(10, 0), (11, 1)]


def test_a_device_is_forgotten_after_its_lifetime(spark, tmp_path):
    out = {}
    put = lambda rows, n: out.update({n: [r.is_new for r in rows.collect()]})
    for n, lifetime in enumerate((60_000, 0)):
        step = kept.first_visits_into(put, str(tmp_path / str(n)), "device", "day", lifetime_ms=lifetime)
        for batch, day in enumerate((date(2025, 1, 1), date(2025, 2, 2))):
            step(spark.range(1).select(F.col("id").alias("device"), F.lit(day).alias("day")), batch)
        assert out == {0: [1], 1: [n]}
