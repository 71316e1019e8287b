"""Dimensions of the warehouse, full builds and zipper tables, over the test tables.

Suppliers play organs, drivers and transport complexes, customers couriers and
users, parts skus, trucks and products, nations and regions the levels above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import hash_if, mask_name
from millrace.operators.dims import attribute_sets, calendar_of, chain, labelled, levels_of, not_deleted, rule_text
from millrace.operators.facts import order_details
from millrace.operators.loads import OPEN, zipper_daily, zipper_first
from millrace.operators.ranking import latest_per_key
from millrace.plans.logistics import organ_dim
from millrace.plans.trade import business_date
from millrace.sources.tables import load

SEGMENTS = {"AUTOMOBILE": "car", "BUILDING": "house", "FURNITURE": "home", "MACHINERY": "works", "HOUSEHOLD": "home"}
PHONE_PATTERN = "^1[3-9][0-9]{9}$"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city"), F.col("n_regionkey").alias("province_id"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("province_id"), F.col("r_name").alias("province"))


def dim_organ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organ_dim(spark, sf_dir)


def dim_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations in one table of (id, level, name, parent), with the parent's name by a self-join."""
    up = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(1).alias("level"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    down = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(2).alias("level"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    both = up.unionByName(down)
    return chain(both, [(both.select("id", F.col("name").alias("parent")), "id", "parent_id")])


def dim_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexes that aren't deleted (a balance below 0 plays the mark), with city, province and number of couriers."""
    marked = load(spark, sf_dir, "supplier").withColumn("is_deleted", F.when(F.col("s_acctbal") < 0, "1").otherwise("0"))
    couriers = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("city_id")).agg(F.count(F.lit(1)).alias("couriers"))
    base = not_deleted(marked).select(F.col("s_suppkey").alias("complex_id"), F.col("s_name").alias("complex"), F.col("s_nationkey").alias("city_id"))
    return chain(base, [(_nations(spark, sf_dir), "city_id", "city_id"), (_regions(spark, sf_dir), "province_id", "province_id"), (couriers, "city_id", "city_id")]).fillna(0, ["couriers"])


def dim_courier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Couriers with hashed phones (one in ten is no valid number) and the label of their kind of work."""
    phone = F.concat(F.when(F.col("c_custkey") % 10 == 0, "12").otherwise("13"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("courier_id"), mask_name(F.col("c_name")).alias("name"), hash_if(phone, PHONE_PATTERN).alias("phone"), labelled(F.col("c_mktsegment"), SEGMENTS, "other").alias("work"), F.col("c_nationkey").alias("city_id"))
    return rows.join(_nations(spark, sf_dir).select("city_id", "city"), "city_id").drop("city_id")


def dim_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts from one organ's city to another's: the organ dictionary is met in two roles."""
    trips = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("start_id"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 10).alias("end_id")).distinct()
    organs = organ_dim(spark, sf_dir).select(F.col("organ_id").alias("id"), F.col("city").alias("name"))
    none = spark.range(1).select(F.lit(1).alias("one"))
    named = order_details(trips.withColumn("one", F.lit(1)), none, "one", {"start_id": organs, "end_id": organs})
    return named.select("line_no", "start_id", "end_id", F.col("start_id_name").alias("start_city"), F.col("end_id_name").alias("end_city"))


def dim_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("driver_id"), mask_name(F.col("s_name")).alias("name"), F.col("s_nationkey").alias("city_id"), F.when(F.col("s_acctbal") < 0, "inactive").otherwise("active").alias("state"))
    return rows.join(_nations(spark, sf_dir).select("city_id", "city"), "city_id")


def dim_truck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trucks with the size of their type's fleet."""
    part = load(spark, sf_dir, "part")
    fleet = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("fleet"))
    return part.select(F.col("p_partkey").alias("truck_id"), F.col("p_brand").alias("brand"), "p_type", F.col("p_size").alias("tons")).join(fleet, "p_type")


def dim_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skus flattened with product, three category levels, brand, price band and their sorted attributes: seven joins."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku_id"), "p_name", "p_brand", "p_type", "p_size", F.col("p_retailprice").alias("price"))
    word = lambda k: F.element_at(F.split("p_name", " "), k)
    spu = part.select(word(2).alias("spu")).distinct().select("spu", F.upper("spu").alias("spu_name"))
    third = part.select("p_type").distinct().select("p_type", F.lower("p_type").alias("category3"), F.substring("p_type", 1, 1).alias("c2"))
    second = third.select("c2").distinct().select("c2", F.concat(F.lit("group "), F.col("c2")).alias("category2"), F.when(F.col("c2") < "M", "A-L").otherwise("M-Z").alias("c1"))
    first = second.select("c1").distinct().select("c1", F.concat(F.lit("part "), F.col("c1")).alias("category1"))
    brand = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("brand_skus"))
    rows = part.select("sku_id", F.explode(F.array(F.struct(F.lit("colour").alias("name"), word(1).alias("value")), F.struct(F.lit("size").alias("name"), F.col("p_size").cast("string").alias("value")))).alias("a")).select("sku_id", "a.*")
    attributes = attribute_sets(rows, "sku_id", ["name", "value"], "attributes").select("sku_id", F.array_join(F.transform("attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ";").alias("attributes"))
    sold = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"))
    flat = chain(part.withColumn("spu", word(2)), [(spu, "spu", "spu"), (third, "p_type", "p_type"), (second, "c2", "c2"), (first, "c1", "c1"), (brand, "p_brand", "p_brand"), (attributes, "sku_id", "sku_id"), (sold, "l_partkey", "sku_id")])
    return flat.select("sku_id", "spu_name", "category1", "category2", "category3", "p_brand", "brand_skus", "price", "attributes", F.coalesce("lines", F.lit(0)).alias("lines"))


def dim_coupon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts as coupons: below 4 per cent a fixed cut, below 8 a discount, beyond a voucher, with their rule as text."""
    n = F.round(F.col("l_discount") * 100).cast("int")
    coupons = load(spark, sf_dir, "lineitem").select(n.alias("coupon_id")).distinct().withColumn("code", F.when(F.col("coupon_id") < 4, "1").when(F.col("coupon_id") < 8, "2").otherwise("3"))
    c = F.col("coupon_id")
    text = rule_text(F.col("code"), {"1": ("over ", c * 100, " off ", c), "2": ("over 5 pieces ", 100 - c, " per cent"), "3": ("less ", c)})
    return coupons.select("coupon_id", labelled(F.col("code"), {"1": "full cut", "2": "discount", "3": "voucher"}).alias("kind"), text.alias("benefit"))


def dim_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax rates as activities with their first and last day."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_tax") * 100).cast("int").alias("activity_id"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("dt"))
    span = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("activity_id").agg(F.min("dt").alias("first_day"), F.max("dt").alias("last_day"))
    kind = F.when(F.col("activity_id") % 2 == 0, "3101").otherwise("3102")
    text = rule_text(kind, {"3101": ("from ", F.col("activity_id"), " on free post"), "3102": ("every ", F.col("activity_id"), "th half price")})
    return span.select("activity_id", labelled(kind, {"3101": "full", "3102": "piece"}, "none").alias("kind"), text.alias("rule"), "first_day", "last_day")


def dim_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(_nations(spark, sf_dir), [(_regions(spark, sf_dir), "province_id", "province_id")])


def dim_promotion_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types as positions."""
    rows = load(spark, sf_dir, "events").select("event_type").distinct()
    return rows.select(F.col("event_type").alias("position"), F.upper(F.substring("event_type", 1, 1)).alias("area"))


def dim_promotion_referrer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts of pages as referrers."""
    host = F.try_parse_url("url", F.lit("HOST"))
    return load(spark, sf_dir, "pages").select(host.alias("referrer")).distinct().withColumn("domain", F.substring_index("referrer", ".", -2))


def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from the first order to the last with calendar parts, and the orders of each."""
    per = load(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg(F.count(F.lit(1)).alias("orders")).where("dt is not null")
    days = per.agg(F.explode(F.sequence(F.min("dt"), F.max("dt"))).alias("dt"))
    return calendar_of(days).join(per, "dt", "left").fillna(0, ["orders"])


def dim_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category tree of the parts, from their type, brand and size, with the parts below each node."""
    return levels_of(load(spark, sf_dir, "part"), ["p_type", "p_brand", "p_size"], "parts")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, object]:
    """Customers' states before the last 30 days, as open rows, and the changes since; a state is that of the newest order."""
    today = business_date(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("dt"))
    split = F.date_sub(today, 30)
    old = latest_per_key(orders.where(F.col("dt") <= split), ["o_custkey"], [F.desc("dt"), F.desc("o_orderkey")])
    return zipper_first(old, F.col("dt")), orders.where(F.col("dt") > split), today


def scd2_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zipper table after a daily load: a changed customer's old row closes on the day before, the newest stays open."""
    open_rows, changes, today = _versions(spark, sf_dir)
    return zipper_daily(open_rows, changes, ["o_custkey"], [F.desc("dt"), F.desc("o_orderkey")], today)


def scd2_user_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simpler zipper: masked first, then rows of old and new numbered by start, newest first."""
    open_rows, changes, today = _versions(spark, sf_dir)
    names = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), mask_name(F.col("c_name")).alias("name"))
    masked = lambda df: df.join(names, "o_custkey")
    rows = zipper_daily(masked(open_rows), masked(changes), ["o_custkey"], [F.desc("dt"), F.desc("o_orderkey")], today)
    return rows.select("o_custkey", "name", "status", "start_date", "end_date", (F.col("end_date") == F.lit(OPEN)).cast("int").alias("is_open"))


QUERIES = {
    f.__name__: f
    for f in (
        dim_organ,
        dim_region,
        dim_complex,
        dim_courier,
        dim_shift,
        dim_driver,
        dim_truck,
        dim_sku,
        dim_coupon,
        dim_activity,
        dim_province,
        dim_promotion_position,
        dim_promotion_referrer,
        dim_date,
        dim_category,
        scd2_customer,
        scd2_user_masked,
    )
}

_VERSIONS = """
o as (select o_custkey, o_orderkey, o_orderstatus as status, cast(o_orderdate as date) as dt from orders), t as (select max(dt) as d from o),
old as (select o.* from o, t where dt <= d - 30 qualify row_number() over (partition by o_custkey order by dt desc, o_orderkey desc) = 1),
new as (select o.*, d from o, t where dt > d - 30 qualify row_number() over (partition by o_custkey order by dt desc, o_orderkey desc) = 1),
z as (select old.*, old.dt as start_date, case when new.o_custkey is null then date '9999-12-31' else new.d - 1 end as end_date from old left join new using (o_custkey)
  union all select o_custkey, o_orderkey, status, dt, d, date '9999-12-31' from new)
"""
_SEGMENT_SQL = "case c_mktsegment " + " ".join(f"when '{k}' then '{v}'" for k, v in SEGMENTS.items()) + " else 'other' end"

ORACLE = {
    "dim_organ": "select s_suppkey as organ_id, s_nationkey as city_id, n_name as city, n_regionkey as province_id, r_name as province from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey",
    "dim_region": "select 'r' || r_regionkey as id, 1 as level, r_name as name, null::varchar as parent_id, null::varchar as parent from region union all select 'n' || n_nationkey, 2, n_name, 'r' || n_regionkey, r_name from nation left join region on n_regionkey = r_regionkey",
    "dim_complex": """with c as (select c_nationkey as city_id, count(*) as couriers from customer group by 1)
select s_suppkey as complex_id, s_name as complex, s_nationkey as city_id, n_name as city, n_regionkey as province_id, r_name as province, coalesce(couriers, 0) as couriers
from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join c on c.city_id = s_nationkey where not s_acctbal < 0""",
    "dim_courier": f"""select c_custkey as courier_id, c_name[1:1] || '*' as name, case when c_custkey % 10 <> 0 then md5('13' || lpad(c_custkey::varchar, 9, '0')) end as phone, {_SEGMENT_SQL} as work, n_name as city from customer join nation on c_nationkey = n_nationkey""",
    "dim_shift": """with s as (select distinct l_linenumber as line_no, l_suppkey as start_id, (l_suppkey + l_linenumber) % 10 as end_id from lineitem),
o as (select s_suppkey as id, n_name as city from supplier left join nation on s_nationkey = n_nationkey)
select s.*, a.city as start_city, b.city as end_city from s left join o a on a.id = start_id left join o b on b.id = end_id""",
    "dim_driver": "select s_suppkey as driver_id, s_name[1:1] || '*' as name, s_nationkey as city_id, case when s_acctbal < 0 then 'inactive' else 'active' end as state, n_name as city from supplier join nation on s_nationkey = n_nationkey",
    "dim_truck": "select p_partkey as truck_id, p_brand as brand, p_type, p_size as tons, count(*) over (partition by p_type) as fleet from part",
    "dim_sku": """with l as (select l_partkey, count(*) as lines from lineitem group by 1)
select p_partkey as sku_id, upper(string_split(p_name, ' ')[2]) as spu_name, case when p_type[1:1] < 'M' then 'part A-L' else 'part M-Z' end as category1, 'group ' || p_type[1:1] as category2, lower(p_type) as category3,
  p_brand, count(*) over (partition by p_brand) as brand_skus, p_retailprice as price, 'colour=' || string_split(p_name, ' ')[1] || ';size=' || p_size as attributes, coalesce(lines, 0) as lines
from part left join l on l_partkey = p_partkey""",
    "dim_coupon": """with c as (select distinct round(l_discount * 100)::int as c from lineitem)
select c as coupon_id, case when c < 4 then 'full cut' when c < 8 then 'discount' else 'voucher' end as kind, case when c < 4 then 'over ' || c * 100 || ' off ' || c when c < 8 then 'over 5 pieces ' || (100 - c) || ' per cent' else 'less ' || c end as benefit from c""",
    "dim_activity": """with a as (select round(l_tax * 100)::int as a, min(cast(o_orderdate as date)) as first_day, max(cast(o_orderdate as date)) as last_day from lineitem join orders on l_orderkey = o_orderkey group by 1)
select a as activity_id, case when a % 2 = 0 then 'full' else 'piece' end as kind, case when a % 2 = 0 then 'from ' || a || ' on free post' else 'every ' || a || 'th half price' end as rule, first_day, last_day from a""",
    "dim_province": "select n_nationkey as city_id, n_name as city, n_regionkey as province_id, r_name as province from nation left join region on n_regionkey = r_regionkey",
    "dim_promotion_position": "select distinct event_type as position, upper(event_type[1:1]) as area from events",
    "dim_promotion_referrer": "with h as (select distinct regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as referrer from pages) select referrer, array_to_string(string_split(referrer, '.')[-2:], '.') as domain from h",
    "dim_date": """with o as (select cast(o_orderdate as date) as dt, count(*) as orders from orders group by 1), d as (select unnest(generate_series(min(dt), max(dt), interval 1 day))::date as dt from o)
select dt, year(dt)::int as year, quarter(dt)::int as quarter, month(dt)::int as month, day(dt)::int as day, isoyear(dt)::int as iso_year, weekofyear(dt)::int as week, isodow(dt)::int as weekday, (isodow(dt) >= 6)::int as is_weekend, coalesce(orders, 0) as orders
from d left join o using (dt)""",
    "dim_category": """select 1 as level, p_type as name, null::varchar as parent, count(*) as parts from part group by all union all select 2, p_type || ' / ' || p_brand, p_type, count(*) from part group by all
union all select 3, p_type || ' / ' || p_brand || ' / ' || p_size, p_type || ' / ' || p_brand, count(*) from part group by all""",
    "scd2_customer": f"with {_VERSIONS} select * from z",
    "scd2_user_masked": f"with {_VERSIONS} select o_custkey, c_name[1:1] || '*' as name, status, start_date, end_date, (end_date = date '9999-12-31')::int as is_open from z join customer on c_custkey = o_custkey",
}
