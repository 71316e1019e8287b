"""Loads: the given tables written in the layouts of the sources and of the warehouse, and read back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.loads import append, read_day, write_partitions
from millrace.operators.text import check_last_word, names_inside
from millrace.sources.files import append_rows, camel_columns, changed_on, csv_counted, full_day, head_rows, json_lines, platform_files, region_codes, renamed_csv, renamed_with, stamped, temporary, typed, word_list
from millrace.sources.scratch import scratch_folder
from millrace.sources.tables import load, money
from millrace.sources.topics import keyed_table, preview, read_keyed, routed_messages

FORMATS = ("orc", "parquet", "csv")


def _per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and amount per status and month, partition column dt last."""
    orders = load(spark, sf_dir, "orders")
    return orders.groupBy("o_orderstatus", F.date_format("o_orderdate", "yyyyMM").alias("dt")).agg(F.count(F.lit(1)).alias("orders"), F.sum(money("o_totalprice")).cast("double").alias("amount")).select("o_orderstatus", "orders", "amount", "dt")


def layout_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report partitioned by month as ORC, Parquet and tab text: all months read back from each."""
    per, out = _per_day(spark, sf_dir), None
    for fmt in FORMATS:
        path = scratch_folder(spark)
        write_partitions(per, path, "dt", fmt)
        reader = spark.read.option("sep", "\t").schema("o_orderstatus string, orders long, amount double, dt string") if fmt == "csv" else spark.read
        back = reader.format(fmt).load(path)
        rows = back.groupBy("o_orderstatus", F.col("dt").cast("string").alias("dt")).agg(F.sum("orders").alias("orders")).withColumn("layout", F.lit(fmt))
        out = rows if out is None else out.unionByName(rows)
    return out


def partition_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months written, then one overwritten with doubled counts and one appended to: all are read back, and the others stay."""
    per, path = _per_day(spark, sf_dir).drop("amount"), scratch_folder(spark)
    write_partitions(per, path, "dt")
    write_partitions(per.where("dt = '199603'").withColumn("orders", F.col("orders") * 2), path, "dt")
    append(per.where("dt = '199604'"), path, "dt")
    months = spark.read.orc(path).where(F.col("dt").cast("string") != "199605").unionByName(read_day(spark, path, "199605"))
    return months.groupBy("o_orderstatus", F.col("dt").cast("string").alias("dt")).agg(F.sum("orders").alias("orders"), F.count(F.lit(1)).alias("n_rows"))


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as CSV with a header, their types inferred; every row carries the count of rows."""
    path = scratch_folder(spark)
    load(spark, sf_dir, "part").write.option("header", True).csv(path)
    df, n = csv_counted(spark, path)
    return df.select("p_partkey", "p_brand", "p_retailprice", F.lit(n).alias("n_rows"))


def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with renames and a choice of columns, appended twice."""
    path, target = scratch_folder(spark), scratch_folder(spark)
    load(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("\n"), "c_mktsegment").alias("label")).write.option("header", True).option("quoteAll", True).csv(path)
    rows = renamed_csv(spark, path, {"c_custkey": "id", "label": "name"})
    for _ in range(2):
        append_rows(rows, target, ["id", "name"])
    return spark.read.schema(rows.schema).parquet(target).groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))


def platform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as CSV of two platforms in one table, tabs taken out."""
    paths = {"shop": scratch_folder(spark), "depot": scratch_folder(spark)}
    load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("a\t"), "c_name").alias("name")).write.option("header", True).option("quoteAll", True).csv(paths["shop"])
    load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("x").alias("more")).write.option("header", True).option("quoteAll", True).csv(paths["depot"])
    return platform_files(spark, paths).select("platform", "id", "name", "more")


def json_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, every eleventh broken and every thirteenth blank: good rows per type with nested text, and the rejects."""
    path = scratch_folder(spark)
    text = F.to_json(F.struct("event_id", "event_type", F.struct("user_id", "value").alias("body")))
    key = F.col("event_id")
    load(spark, sf_dir, "events").select(F.when(key % 13 == 0, "  ").when(key % 11 == 0, F.substring(text, 1, 25)).otherwise(text).alias("value")).write.text(path)
    good, bad = json_lines(spark, path, "event_id long, event_type string, body string")
    counted = good.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("row_ids"), F.count_distinct(F.get_json_object("body", "$.user_id")).alias("users"))
    rejects = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("reject").alias("event_type"), "n", F.lit(0).cast("long").alias("row_ids"), F.lit(0).cast("long").alias("users"))
    return counted.unionByName(rejects)


def region_code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a code file `code region,nation` and regions as `code region`; names have no blanks in it."""
    path = scratch_folder(spark)
    regions = load(spark, sf_dir, "region").withColumn("r_name", F.replace("r_name", F.lit(" "), F.lit("_")))
    nations = load(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    lines = nations.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(" "), "r_name", F.lit(","), "n_name").alias("value")).unionByName(regions.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(" "), "r_name").alias("value")))
    lines.write.text(path)
    return region_codes(spark, path)


def extract_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest day's orders as an incremental extract, in the types of the warehouse, and the nations as a full one."""
    orders = load(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    newest = orders.agg(F.to_date(F.max("o_orderdate"))).first()[0] or date(1970, 1, 1)
    rows = typed(changed_on(orders, "o_orderdate", newest), {"o_orderkey": "bigint", "o_totalprice": "decimal(12,2)", "o_orderstatus": "char(1)"})
    part = rows.select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), "ds")
    full = full_day(load(spark, sf_dir, "nation"), newest).select(F.lit("nation").alias("source"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"), "ds")
    return part.unionByName(full)


def camel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with camel-case names, one renamed with another put behind it, by a temporary view; the load's time stamp is not compared."""
    rows = renamed_with(camel_columns(load(spark, sf_dir, "orders")), "oOrderstatus", "status", "isOpen", (F.col("oOrderstatus") == "O").cast("int"))
    temporary(stamped(rows), "camel_orders_view")
    return spark.table("camel_orders_view").groupBy("status", "isOpen").agg(F.count(F.lit(1)).alias("n"), F.count("etl_time").alias("stamped"))


def word_file_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names checked by their last word against a word file made of the second word of all names."""
    path = scratch_folder(spark)
    part = load(spark, sf_dir, "part")
    part.select(F.concat(F.lit(" "), F.element_at(F.split("p_name", " "), 2), F.lit("\r")).alias("value")).write.text(path)
    return check_last_word(part.select("p_partkey", F.regexp_replace("p_name", " ", ",").alias("label")), "label", word_list(spark, path))


def names_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long benchmark words found anywhere in the turns of conversations, also inside other words."""
    names = load(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]{8,}"), F.lit(0))).alias("name"))
    return names_inside(load(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", names)


def keyed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of prices as text merged into a table of one row per part; the newer batch wins, broken prices are null."""
    path = scratch_folder(spark)
    price = F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    rows = load(spark, sf_dir, "part").select("p_partkey", price.alias("price"), F.lit(1).alias("version"))
    put = keyed_table(path, ["p_partkey"], ["version"], "price")
    put(rows, 0)
    put(rows.where("p_partkey % 2 = 0").select("p_partkey", F.lit("1.50").alias("price"), F.lit(2).alias("version")), 1)
    return read_keyed(spark, path, f"p_partkey {dict(rows.dtypes)['p_partkey']}, price decimal(18,2), version int").select("p_partkey", F.col("price").cast("double").alias("price"), "version")


def topic_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first message of every topic that events are routed to; errors have none of their own and fall back."""
    rows = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("route"))
    sent = routed_messages(rows, F.col("route"), "rest").withColumn("nth", F.get_json_object("value", "$.event_id").cast("long"))
    return preview(sent, order=["nth"]).select("topic", "nth")


def dearest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a limit: the 50 dearest parts."""
    return head_rows(load(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (-F.col("p_retailprice")).alias("negative")), 50, ["negative", "p_partkey"]).drop("negative")


QUERIES = {
    f.__name__: f
    for f in (
        layout_round_trips,
        partition_overwrites,
        csv_scan,
        renamed_columns,
        platform_rows,
        json_line_rows,
        region_code_rows,
        extract_day,
        camel_orders,
        word_file_check,
        names_anywhere,
        keyed_prices,
        topic_previews,
        dearest_parts,
    )
}

ORACLE = {
    "layout_round_trips": "select o_orderstatus, strftime(o_orderdate, '%Y%m') as dt, count(*) as orders, layout from orders, (values ('orc'), ('parquet'), ('csv')) as t(layout) group by all",
    "partition_overwrites": """with p as (select o_orderstatus, strftime(o_orderdate, '%Y%m') as dt, count(*) as n from orders group by all)
select o_orderstatus, dt, (case when dt in ('199603', '199604') then 2 * n else n end)::bigint as orders, (case when dt = '199604' then 2 else 1 end)::bigint as n_rows from p""",
    "csv_scan": "select p_partkey::int as p_partkey, p_brand, p_retailprice, (count(*) over ())::int as n_rows from part",
    "renamed_columns": "select c_custkey::varchar as id, c_name || ' ' || c_mktsegment as name, 2::bigint as n from customer",
    "platform_rows": "select 'shop' as platform, c_custkey::varchar as id, 'a' || c_name as name, null::varchar as more from customer union all select 'depot', s_suppkey::varchar, s_name, 'x' from supplier",
    "json_line_rows": """select event_type, count(*) as n, count(*) as row_ids, count(distinct user_id) as users from events where event_id % 13 <> 0 and event_id % 11 <> 0 group by 1
union all select 'reject', count(*), 0, 0 from events where event_id % 13 <> 0 and event_id % 11 = 0""",
    "region_code_rows": "with r as (select r_regionkey, replace(r_name, ' ', '_') as r_name from region) select 'n' || n_nationkey as code, r_name || ',' || n_name as origin, r_name as province, n_name as city, null::varchar as area from nation join r on n_regionkey = r_regionkey union all select 'r' || r_regionkey, r_name, r_name, null, null from r",
    "extract_day": """with t as (select max(cast(o_orderdate as date)) as d from orders)
select 'orders' as source, o_orderkey as id, o_orderstatus as label, strftime(d, '%Y%m%d') as ds from orders, t where cast(o_orderdate as date) = d union all select 'nation', n_nationkey, n_name, strftime(d, '%Y%m%d') from nation, t""",
    "camel_orders": "select o_orderstatus as status, (o_orderstatus = 'O')::int as \"isOpen\", count(*) as n, count(*) as stamped from orders group by all",
    "word_file_check": """with w as (select distinct string_split(p_name, ' ')[2] as word from part)
select p_partkey, replace(p_name, ' ', ',') as label, (word is not null)::int as flag, case when word is not null then 'P0' end as grade, word from part left join w on string_split(p_name, ' ')[-1] = word""",
    "names_anywhere": r"with n as (select distinct unnest(regexp_extract_all(text, '[\p{L}\p{N}]{8,}')) as name from benchmark) select distinct conv_id, turn, name from conversations join n on contains(text, name)",
    "keyed_prices": "select p_partkey, case when p_partkey % 2 = 0 then 1.5::double when p_partkey % 5 <> 0 then cast(cast(p_retailprice as decimal(18,2)) as double) end as price, (case when p_partkey % 2 = 0 then 2 else 1 end)::int as version from part",
    "topic_previews": "select case when event_type = 'error' then 'rest' else event_type end as topic, min(event_id) as nth from events group by 1",
    "dearest_parts": "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 50",
}
