"""The column functions over whole tables: masks, keys, texts, times, numbers and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.sources.tables import load

#: Customers whose bucket is given, not hashed.
OVERRIDES = {"Customer#000000007": "0999"}
BUCKETS = 16


def mask_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, phones and addresses of customers masked; one phone in ten and one address in seven is not valid."""
    key = F.col("c_custkey")
    phone = F.concat(F.when(key % 10 == 0, "12").otherwise("13"), F.lpad(key.cast("string"), 9, "0"))
    mail = F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.when(key % 7 == 0, " at ").otherwise("@"), F.lower("c_mktsegment"), F.lit(".example.com"))
    return load(spark, sf_dir, "customer").select("c_custkey", C.mask_name(F.col("c_name")).alias("name"), C.mask_phone(phone).alias("phone"), C.mask_email(mail).alias("mail"), C.hash_if(phone, C.PHONE).alias("phone_hash"))


def customer_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per bucket of their hashed name."""
    rows = load(spark, sf_dir, "customer").select(C.hash_bucket(F.col("c_name"), BUCKETS, OVERRIDES).alias("bucket"), C.surrogate_key(F.col("c_name"), F.col("c_mktsegment")).alias("sk"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("customers"), F.count_distinct("sk").alias("surrogate_keys"), F.min("sk").alias("least_key"))


def text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names joined, capitalised, lowered and repeated; blank and character checks."""
    name = F.col("p_name")
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        C.capitalised(name).alias("capital"),
        C.lower_first(F.col("p_type")).alias("lowered"),
        C.joined(F.split(name, " "), "-").alias("dashed"),
        C.repeated(F.substring(name, 1, 1), 3).alias("thrice"),
        C.is_blank(F.substring(name, 100, 5)).cast("int").alias("no_tail"),
        C.only_allowed(name).cast("int").alias("plain"),
        C.only_allowed(F.col("p_brand")).cast("int").alias("plain_brand"),
        C.second_word(name).alias("second"),
    )


def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days from epoch days, milliseconds, compact and localised text, with calendar parts."""
    day = F.to_date("o_orderdate")
    local = F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", day.alias("dt"), local.alias("local"))
    dt = F.col("dt")
    return rows.select(
        "o_orderkey",
        C.epoch_day(F.datediff(dt, F.lit("1970-01-01").cast("date"))).alias("from_epoch"),
        C.millis_date(F.unix_date(dt).cast("long") * 86_400_000).alias("from_millis"),
        C.compact_date(F.date_format(dt, "yyyyMMdd")).alias("from_compact"),
        C.iso_to_local(F.date_format(dt, "yyyy-MM-dd'T'00:00:00")).alias("from_iso"),
        C.local_timestamp(F.col("local"), F.lit("8:05")).alias("from_local"),
        F.size(C.days_between(F.date_sub(dt, 9), dt)).alias("span"),
        C.week_key(dt).alias("week_key"),
        *[c.alias(name) for name, c in C.calendar_parts(dt).items()],
    )


def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex, decimal and broken texts as numbers, and hex payloads in words."""
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("0x"), F.lower(F.hex(key)))).when(key % 3 == 1, key.cast("string")).otherwise(F.concat(F.lit("n"), key.cast("string")))
    value, wrong = C.safe_number(text, "decimal(18,2)")
    words = C.hex_words(F.concat(F.lit("0x"), F.repeat(F.lit("ab"), (key % 5 * 20).cast("int"))))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", C.number_text(text).cast("long").alias("number"), C.number_text(text, 3).alias("scaled"), value.cast("double").alias("safe"), wrong.cast("int").alias("wrong"), F.size(words).alias("words"))
    return rows


def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the events' props got, put, removed and merged; a list held as text; a map."""
    props = F.col("props")
    put, merged = C.json_put(props, "kind", F.col("event_type")), C.json_merge(props, F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("k"))))
    listed = C.text_list_append(F.when(F.col("event_id") % 2 == 0, F.lit('["a"]')), F.col("event_type"))
    return load(spark, sf_dir, "events").select(
        "event_id",
        C.json_get(props, "k").alias("k"),
        C.json_get(put, "kind").alias("kind"),
        C.json_get(C.json_remove(put, "k"), "k").isNull().cast("int").alias("removed"),
        C.json_get(merged, "info_user").alias("info_user"),
        C.json_get(merged, "info_k").alias("info_k"),
        listed.alias("listed"),
        C.map_value(F.create_map(F.lit("view"), F.lit(1), F.lit("click"), F.lit(2)), F.col("event_type")).alias("code"),
    )


QUERIES = {f.__name__: f for f in (mask_fields, customer_buckets, text_checks, time_formats, number_formats, json_members)}

_PHONE = "case when c_custkey % 10 = 0 then '12' else '13' end || lpad(c_custkey::varchar, 9, '0')"
_KEY = "md5(length(c_name) || ':' || c_name || length(c_mktsegment) || ':' || c_mktsegment)"
_NUMBER = "case when o_orderkey % 3 < 2 then o_orderkey end"
ORACLE = {
    "mask_fields": f"""select c_custkey, c_name[1:1] || '*' as name, case when c_custkey % 10 <> 0 then '13' || lpad(c_custkey::varchar, 9, '0')[1:1] || '********' end as phone,
  case when c_custkey % 7 <> 0 then '*@' || lower(c_mktsegment) || '.example.com' end as mail, case when c_custkey % 10 <> 0 then md5({_PHONE}) end as phone_hash from customer""",
    "customer_buckets": f"""with b as (select case when c_name = 'Customer#000000007' then '0999' else lpad((('0x' || md5(c_name)[-3:])::int % {BUCKETS})::varchar, 4, '0') end as bucket, {_KEY} as sk from customer)
select bucket, count(*) as customers, count(distinct sk) as surrogate_keys, min(sk) as least_key from b group by 1""",
    "text_checks": """select p_partkey, upper(p_name[1:1]) || p_name[2:] as capital, lower(p_type[1:1]) || p_type[2:] as lowered, replace(p_name, ' ', '-') as dashed, repeat(p_name[1:1], 3) as thrice, 1 as no_tail,
  regexp_full_match(p_name, '[\\p{L}\\p{N} _.-]+')::int as plain, regexp_full_match(p_brand, '[\\p{L}\\p{N} _.-]+')::int as plain_brand, string_split(p_name, ' ')[2] as second from part""",
    "time_formats": """with d as (select o_orderkey, cast(o_orderdate as date) as dt from orders)
select o_orderkey, dt as from_epoch, dt as from_millis, dt as from_compact, strftime(dt, '%Y-%m-%d') || ' 00:00:00' as from_iso, strftime(dt, '%Y-%m-%d') || ' 08:05:00' as from_local, 10 as span, (isoyear(dt) * 100 + weekofyear(dt))::int as week_key,
  year(dt)::int as year, quarter(dt)::int as quarter, month(dt)::int as month, day(dt)::int as day, weekofyear(dt)::int as week, isodow(dt)::int as weekday, (isodow(dt) >= 6)::int as is_weekend from d""",
    "number_formats": f"""select o_orderkey, {_NUMBER} as number, ({_NUMBER})::double / 1000 as scaled, case when o_orderkey % 3 = 1 then o_orderkey::double end as safe, (o_orderkey % 3 <> 1)::int as wrong, ((o_orderkey % 5 * 40) // 64)::int as words from orders""",
    "json_members": """select event_id, props::json->>'k' as k, event_type as kind, 1 as removed, user_id::varchar as info_user, event_type as info_k,
  case when event_id % 2 = 0 then '["a","' || event_type || '"]' else '["' || event_type || '"]' end as listed, case event_type when 'view' then 1 when 'click' then 2 end as code from events""",
}
