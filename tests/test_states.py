"""Day states, versions over many days, several ranks at once."""

import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators.daystates import day_rows, interval_states, roll_forward, store_days, stored_days
from millrace.operators.loads import OPEN, versions_of_runs
from millrace.operators.ranking import ranks_at_once

D = date(2025, 3, 31)


def back(n):
    return D - timedelta(n)


FACTS = "brand string, user long, amount long, dt date"
ROWS = [("x", 1, 10, back(0)), ("x", 1, 5, back(3)), ("x", 40_000, 1, back(3)), ("x", None, 2, back(3)), ("x", 2, 7, back(29)), ("x", 3, 100, back(30)), ("y", 1, 4, back(10)), (None, 9, 8, back(1))]


def test_intervals_come_from_day_rows_alone(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.createDataFrame(ROWS, FACTS)
    store_days(day_rows(rows, ["brand"], "dt", {"amount": F.sum("amount"), "n": F.count(F.lit(1))}, "user"), path)
    # A day that is stored again takes the place of itself.
    store_days(day_rows(rows.where(F.col("dt") == F.lit(back(3))), ["brand"], "dt", {"amount": F.sum("amount"), "n": F.count(F.lit(1))}, "user"), path)
    days = stored_days(spark, path, D, 30)
    got = interval_states(days, ["brand"], ["amount", "n"], D, (1, 7, 30), "users")
    assert {(r.recent_days, r.brand): (r.amount, r.n, r.users) for r in got.collect()} == {(1, "x"): (10, 1, 1), (7, "x"): (18, 4, 2), (30, "x"): (25, 5, 3), (30, "y"): (4, 1, 1), (7, None): (8, 1, 1), (30, None): (8, 1, 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(dt|PartitionFilters: \[\(?dt|PartitionFilters: \[[^\]]*dt#", plan) and "LogicalRDD" not in plan, plan
    assert interval_states(days.limit(0), ["brand"], ["amount"], D, (1,), "users").count() == 0


def test_rolling_forward_is_the_sum_of_all_days(spark):
    merges = {"first": "min", "last": "max", "total": "sum"}
    days = spark.createDataFrame([(1, back(5), 10), (1, back(2), 4), (2, back(1), 6), (None, back(1), 1)], "user long, dt date, total long").withColumns({"first": F.col("dt"), "last": F.col("dt")})
    whole = roll_forward(days.limit(0), days, ["user"], merges)
    state = days.limit(0).select("user", *merges)
    for upto in (5, 4, 2, 1):
        state = roll_forward(state, days.where(F.col("dt") == F.lit(back(upto))), ["user"], merges)
    assert sorted(map(str, state.collect())) == sorted(map(str, whole.collect())) and whole.count() == 3


@pytest.mark.parametrize("shuffled", [False, True])
def test_versions_are_runs_of_equal_states(spark, shuffled):
    rows = [(1, "a", back(9), 1), (1, "b", back(9), 2), (1, "b", back(8), 3), (1, "a", back(5), 4), (1, "b", back(3), 5), (1, None, back(1), 6), (2, None, back(4), 7), (2, None, back(2), 8), (3, "z", None, 9)]
    df = spark.createDataFrame(rows[::-1] if shuffled else rows, "id long, status string, dt date, n long").repartition(3)
    got = sorted((r.id, r.start_date, r.status, r.end_date) for r in versions_of_runs(df, ["id"], ["status"], "dt", ["n"]).collect())
    assert got == [(1, back(9), "b", back(6)), (1, back(5), "a", back(4)), (1, back(3), "b", back(2)), (1, back(1), None, OPEN), (2, back(4), None, OPEN)]


def test_a_late_change_splits_a_version(spark):
    rows = [(1, "a", back(9), 1), (1, "a", back(2), 2)]
    versions = lambda r: sorted((x.start_date, x.status, x.end_date) for x in versions_of_runs(spark.createDataFrame(r, "id long, status string, dt date, n long"), ["id"], ["status"], "dt", ["n"]).collect())
    assert versions(rows) == [(back(9), "a", OPEN)]
    assert versions([*rows, (1, "b", back(5), 3)]) == [(back(9), "a", back(6)), (back(5), "b", back(3)), (back(2), "a", OPEN)]


@pytest.mark.parametrize("ranges", [2, 64])
@pytest.mark.parametrize("within", [None, ["g"]])
def test_ranks_at_once(spark, ranges, within):
    rows = [(i if i else None, ["p", "q", None][i % 3], (i * 37) % 11 if i % 9 else None, float((i * 17) % 5), 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, a int, b double, same int").repartition(4)
    got = {r.id: (r.ra, r.rb, r.rs) for r in ranks_at_once(df, ["id"], {"a": "ra", "b": "rb", "same": "rs"}, within=within, ranges=ranges).collect()}
    low = lambda v: float("-inf") if v is None else v
    for i, g, *values in rows:
        peers = [r for r in rows if not within or r[1] == g]
        assert got[i] == tuple(1 + sum(low(p[2 + k]) > low(v) for p in peers) for k, v in enumerate(values))
    assert ranks_at_once(df.limit(0), ["id"], {"a": "ra"}).count() == 0
