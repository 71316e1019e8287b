"""Queries whose groups are nearly as many as their rows: tasks follow the rows, and no row is copied for a distinct count."""

import duckdb
import pytest

from millrace.operators import aggregates
from millrace.queries import ORACLE_SQL, QUERIES
from tests.test_queries import SF, shown

GROUPED = ("dispatch_1d", "organ_received_1d", "item_order_fact", "organ_order_1d", "user_coupon_use_1d", "user_sku_order_1d", "organ_delivered_1d")
DISTINCT = ("item_overview", "product_ranks", "new_old_buyers")


@pytest.fixture
def own(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "PART_ROWS", 500, raising=False)
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


@pytest.mark.parametrize("name", GROUPED + DISTINCT)
def test_tasks_follow_the_rows(own, name):
    df = QUERIES[name](own, SF)
    lines = own.read.parquet(f"{SF}/lineitem.parquet").count()
    con = duckdb.connect()
    for table in ("region", "nation", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(tuple(map(shown, r)) for r in df.select(names).collect()) == sorted(tuple(map(shown, r)) for r in want.fetchall())
    if name in GROUPED:
        assert df.rdd.getNumPartitions() >= lines // 500
    else:
        assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_dimension_is_dealt_too(own, monkeypatch):
    monkeypatch.setattr(aggregates, "PART_ROWS", 100)
    assert own.read.parquet(f"{SF}/part.parquet").count() > 100
    plan = QUERIES["user_sku_order_1d"](own, SF)._jdf.queryExecution().executedPlan().toString()
    # The only left join is that with the dimension.
    assert "LeftOuter" in plan and "LeftOuter, BuildRight" not in plan
