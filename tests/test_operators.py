import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import aggregates, loads, text
from millrace.operators.lookups import cached, small_broadcast
from millrace.operators.text import names_inside
from millrace.plans.trade import new_and_returning


def test_new_and_returning_golden(spark):
    visits = {1: [1, 2, 4], 2: [1, 3], 3: [2, 3, 4], 4: [3], 5: [4]}
    days = spark.createDataFrame([(u, date(2025, 8, d)) for u, ds in visits.items() for d in ds], "user_id int, dt date")
    rows = {r.login_date.day: (r.new_user, r.old_user) for r in new_and_returning(days, "user_id", "dt").collect()}
    assert rows == {1: (2, 0), 2: (1, 1), 3: (1, 2), 4: (1, 2)}


def test_ratio_is_zero_on_a_zero_base(spark):
    df = spark.createDataFrame([(80, 150), (5, 0), (None, 3)], "a int, b int")
    assert [r[0] for r in df.select(aggregates.ratio(F.col("a"), F.col("b"))).collect()] == [0.5333, 0.0, 0.0]


def test_merge_sides_keeps_keys_of_every_side(spark):
    side = lambda rows, name: spark.createDataFrame(rows, f"k string, {name} int")
    merged = aggregates.merge_sides([side([("a", 1)], "x"), side([("b", 2)], "y"), side([("b", 3), ("c", 4)], "z")], ["k"])
    assert {r.k: (r.x, r.y, r.z) for r in merged.collect()} == {"a": (1, None, None), "b": (None, 2, 3), "c": (None, None, 4)}


def test_zipper_has_one_open_row_per_id_and_is_repeatable(spark):
    d1, d2 = F.lit(date(2025, 7, 1)), F.lit(date(2025, 7, 2))
    first = loads.zipper_first(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), d1)
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, at int")
    after = loads.zipper_daily(first, changes, ["id"], [F.desc("at")], d2)
    rows = sorted((r.id, r.v, r.end_date) for r in after.collect())
    assert rows == [(1, "a", loads.OPEN), (2, "b", date(2025, 7, 1)), (2, "d", loads.OPEN), (3, "e", loads.OPEN)]
    again = loads.zipper_daily(after.where(F.col("end_date") == F.lit(loads.OPEN)), changes, ["id"], [F.desc("at")], d2)
    assert sorted((r.id, r.v) for r in again.collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_partition_writer_replaces_its_own_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    loads.write_partitions(spark.createDataFrame([(1, "d1"), (2, "d2")], "v int, dt string"), path)
    loads.write_day(spark.createDataFrame([(3,)], "v int"), path, date(2025, 7, 1))
    loads.write_partitions(spark.createDataFrame([(9, "d2")], "v int, dt string"), path)
    assert sorted((r.v, str(r.dt)) for r in spark.read.orc(path).collect()) == [(1, "d1"), (3, "2025-07-01"), (9, "d2")]


def test_column_functions(spark):
    df = spark.createDataFrame([("13812345678", "a.b@c.com", "0xff", "12x")], "p string, e string, h string, n string")
    value, bad = C.safe_number(F.col("n"))
    row = df.select(C.mask_phone(F.col("p")), C.mask_email(F.col("e")), C.hex_number(F.col("h")), value, bad, C.hash_bucket(F.col("p"), 10), C.week_key(F.lit(date(2024, 12, 30)))).first()
    assert row[0] == "138********" and row[1] == "*@c.com" and int(row[2]) == 255
    assert row[3] is None and row[4] is True and len(row[5]) == 4 and row[6] == 202501
    assert C.camel("order_detail_id") == "orderDetailId"


def test_names_inside_by_their_rarest_piece(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé日\n") for _ in range(n))
    texts = [(i, word(rng.randrange(60))) for i in range(80)] + [(100, None), (101, ""), (102, "ab" * 50_000 + "xyzzy")]
    names = [word(rng.randrange(1, 9)) for _ in range(60)] + ["xyzzy", "nowhere at all", "", "ab" * 30, "a"]
    got = names_inside(spark.createDataFrame(texts, "id long, body string"), ["id"], "body", spark.createDataFrame([(n,) for n in names], "name string"))
    want = {(i, n) for i, t in texts if t for n in names if n and n in t}
    rows = [(r.id, r.name) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    none = spark.createDataFrame([], "name string")
    assert names_inside(spark.createDataFrame(texts, "id long, body string"), ["id"], "body", none).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_texts_and_their_pieces_are_not_broadcast(spark, tmp_path, monkeypatch, few):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    # A small file of long texts, as compression makes them.
    own.createDataFrame([(i, f"ab{i % 7}cdefg " * 500) for i in range(50)], "id long, body string").write.parquet(str(tmp_path / "texts"))
    names = own.createDataFrame([("b3cdefg",), ("nowhere",), ("b",)], "name string")
    if not few:
        monkeypatch.setattr(text, "is_small", lambda df: False, raising=False)
        monkeypatch.setattr(text, "small_broadcast", lambda df: df)
    found = names_inside(own.read.parquet(str(tmp_path / "texts")), ["id"], "body", names)

    def broadcasts(node):
        children = node.children()
        below = [b for i in range(children.size()) for b in broadcasts(children.apply(i))]
        return below + ([node.output().toString()] if node.nodeName() == "BroadcastExchange" else [])

    sides = broadcasts(found._jdf.queryExecution().executedPlan())
    assert sides or not few
    assert not [s for s in sides if "id#" in s]
    assert found.count() == 7 + 50


def test_a_cached_dimension_is_read_anew_after_its_lifetime(spark):
    moment, reads = [0.0], []

    def read():
        reads.append(moment[0])
        return spark.range(1)

    dim = cached(read, 10.0, lambda df: df, clock=lambda: moment[0])
    for moment[0] in (0.0, 5.0, 9.9, 10.0, 19.9, 40.0):
        dim()
    assert reads == [0.0, 10.0, 40.0]


def test_only_few_and_narrow_rows_are_broadcast(spark):
    df = spark.createDataFrame([(i, "x" * 100, [1, None], None) for i in range(10)], "id long, `a b` string, c array<int>, d string")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small_broadcast(df)) and hinted(small_broadcast(df.limit(0)))
    assert not hinted(small_broadcast(df, rows=9)) and not hinted(small_broadcast(df, size=900))
