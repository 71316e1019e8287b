"""Dashboard queries against SQL without the cuts that their oracle SQL has."""

import duckdb

from millrace.operators.ranking import rank_by_ranges
from millrace.plans import dashboards

SF = "/root/testdata/sf0.001"


def test_product_rank_holds_all_products(spark):
    con = duckdb.connect()
    sold = f"""select l_partkey, p_brand, sum(cast(l_extendedprice as decimal(18,2))) as amount
      from read_parquet('{SF}/lineitem.parquet') join read_parquet('{SF}/part.parquet') on l_partkey = p_partkey group by 1, 2"""
    want = con.execute(f"select l_partkey, rank() over (partition by p_brand order by amount desc), rank() over (order by amount desc) from ({sold})").fetchall()
    got = dashboards.product_rank(spark, SF).select("l_partkey", "brand_rank", "overall_rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_rank_by_ranges_with_ties_nulls_and_no_cuts(spark):
    values = [5, 5, 3, 3, 3, 9, None, 1, None, 7]
    df = spark.createDataFrame([("a" if i % 2 else None, v) for i, v in enumerate(values)], "k string, v int")
    want = sorted(1 + sum((w if w is not None else -1) > (v if v is not None else -1) for w in values) for v in values)
    for starts in ([], [5, 3], [8, 5, 4, 2]):
        assert sorted(r.rk for r in rank_by_ranges(df, "v", [], starts, "rk").collect()) == want
        assert sorted(r.rk for r in rank_by_ranges(df, "v", ["k"], starts, "rk").collect() if r.k == "a") == [1, 2, 3, 4, 5]


def test_category_distinct_puts_only_items_without_a_part_into_unknown(spark, tmp_path):
    events = [(i, u, k, f"2024-01-01 00:00:0{i}", 1.0, f'{{"k": {item}}}') for i, (u, k, item) in enumerate([(1, "view", 1), (2, "purchase", 1), (2, "view", 2), (3, "purchase", 9)])]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts string, value double, props string").selectExpr("* except (ts)", "cast(ts as timestamp) as ts").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "odd"), (2, "even")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = dashboards.category_distinct(spark, str(tmp_path)).select("category", "users", "buyers", "items").collect()
    assert sorted(map(tuple, got)) == [("even", 1, 0, 1), ("odd", 2, 1, 1), ("unknown", 1, 1, 1)]
