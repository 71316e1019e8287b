"""Static twins of the stream operators and word checks, over events, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.text import check_last_word, main_relation, name_mentions, name_pairs, name_strength, relation_types
from millrace.sources.tables import load
from millrace.streaming.events import drop_repeats, first_visit, merge_parts, newest_only, windowed

#: Keywords of relations between names.
RELATIONS = {"joined": ["and", "with"], "apart": ["but", "not", "from"], "part": ["of", "in"]}
#: Benchmark words of six letters or more play the names.
NAME = r"[\p{L}\p{N}]{6,}"


def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("amount")]


def event_windows_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(load(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], _measures()).drop("window_end")


def event_windows_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(load(spark, sf_dir, "events"), "ts", "5 minutes", [], _measures()).drop("window_end")


def event_windows_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(load(spark, sf_dir, "events"), "ts", "10 seconds", ["event_type"], _measures()).drop("window_end")


def new_visitor_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is an event on its user's first day?"""
    days = load(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("dt"))
    return first_visit(days, "user_id", "dt")


def event_newest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose item number is above all that came before for their user."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "struct<k:long>")["k"].alias("item"))
    return newest_only(events, "user_id", "item", "event_id")


def event_repeats_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(load(spark, sf_dir, "events").select("user_id", "event_type", "props"), ["user_id", "event_type", "props"])


def user_wide_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest view, click and purchase value of each user in one row."""
    kinds = ["view", "click", "purchase"]
    parts = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in kinds])
    return merge_parts(parts, ["user_id"], ["ts", "event_id"], kinds)


def comment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments `user,item` of the events; the word set is the items that error events name on their newest day."""
    events = load(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("dt"), F.concat_ws(",", "user_id", F.from_json("props", "struct<k:long>")["k"]).alias("comment"))
    errors = events.where("event_type = 'error'")
    newest = errors.agg(F.max("dt").alias("dt"))
    words = errors.join(newest, "dt", "left_semi").select(F.element_at(F.split("comment", ","), -1).alias("word"))
    return check_last_word(events.select("event_id", "comment"), "comment", words)


def _mentions(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    names = load(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("name"))
    sentences = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[.!?\\n]")).alias("nth", "sentence"))
    return name_mentions(sentences, keep, "sentence", names)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(_mentions(spark, sf_dir, ["doc_id", "nth"]), ["doc_id", "nth"])


def name_pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of long benchmark words, as names, that share a sentence of a document."""
    return _pairs(spark, sf_dir)


def name_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_strength(_pairs(spark, sf_dir))


def name_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent kind of keyword between two names."""
    per = _mentions(spark, sf_dir, ["doc_id", "nth", "sentence"]).groupBy("doc_id", "nth").agg(F.collect_set("name").alias("names"), F.first("sentence").alias("sentence")).where(F.size("names") > 1)
    pairs = per.select(F.explode("names").alias("a"), "names", "sentence").select("a", F.explode("names").alias("b"), "sentence").where("a < b")
    return main_relation(relation_types(pairs, RELATIONS), list(RELATIONS))


def _window_sql(start: str, key: str = "") -> str:
    return f"select {start} as window_start, {key} count(*) as events, count(distinct user_id) as users, cast(sum(cast(value as decimal(18,4))) as double) as amount from events group by all"


_MENTIONS = rf"""
with names as (select distinct unnest(regexp_extract_all(text, '{NAME}')) as name from benchmark),
split as (select doc_id, regexp_split_to_array(text, '[.!?\n]') as s from documents),
sentences as (select doc_id, unnest(range(len(s))) as nth, unnest(s) as sentence from split),
said as (select doc_id, nth, unnest(list_distinct(regexp_extract_all(sentence, '[\p{{L}}\p{{N}}]+'))) as name from sentences),
mentions as (select doc_id, nth, name from said join names using (name)),
pairs as (select l.name as a, r.name as b, count(*) as weight from mentions l join mentions r on l.doc_id = r.doc_id and l.nth = r.nth and l.name < r.name group by all)
"""

_BETWEEN = "m as (select l.name as a, r.name as b, sentence, instr(sentence, l.name) as x, instr(sentence, r.name) as y from mentions l join mentions r on l.doc_id = r.doc_id and l.nth = r.nth and l.name < r.name join sentences s on s.doc_id = l.doc_id and s.nth = l.nth), between_ as (select a, b, substring(sentence, least(x, y), abs(x - y)) as t from m)"
_KINDS = " union all ".join(f"select a, b, '{kind}' as relation, {nth} as place from between_ where " + " or ".join(f"contains(t, '{w}')" for w in words) for nth, (kind, words) in enumerate(RELATIONS.items()))

QUERIES = {f.__name__: f for f in (event_windows_1d, event_windows_5min, event_windows_10s, new_visitor_repair, event_newest_only, event_repeats_dropped, user_wide_row, comment_check, name_pair_weights, name_degrees, name_relations)}
ORACLE = {
    "event_windows_1d": _window_sql("time_bucket(interval '1 day', ts)", "event_type,"),
    "event_windows_5min": _window_sql("time_bucket(interval '5 minutes', ts)"),
    "event_windows_10s": _window_sql("time_bucket(interval '10 seconds', ts)", "event_type,"),
    "new_visitor_repair": "select event_id, user_id, cast(ts as date) as dt, cast(cast(ts as date) = min(cast(ts as date)) over (partition by user_id) as int) as is_new from events",
    "event_newest_only": "with e as (select event_id, user_id, cast(props::json->>'k' as bigint) as item from events), b as (select *, max(item) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from e) select event_id, user_id, item from b where item is not null and (before is null or item > before)",
    "event_repeats_dropped": "select distinct user_id, event_type, props from events",
    "user_wide_row": "select user_id, " + ", ".join(f'(list(value order by ts desc, event_id desc) filter (event_type = \'{k}\' and value is not null))[1] as "{k}"' for k in ("view", "click", "purchase")) + " from events group by user_id",
    "comment_check": "with e as (select event_id, event_type, cast(ts as date) as dt, concat_ws(',', user_id, props::json->>'k') as comment from events), w as (select distinct string_split(comment, ',')[-1] as word from e where event_type = 'error' and dt = (select max(dt) from e where event_type = 'error')) select event_id, comment, cast(word is not null as int) as flag, case when word is not null then 'P0' end as grade, word from e left join w on string_split(comment, ',')[-1] = word",
    "name_pair_weights": _MENTIONS + "select * from pairs",
    "name_degrees": _MENTIONS + "select name, count(*) as degree, sum(weight)::bigint as strength from (select a as name, weight from pairs union all select b, weight from pairs) group by name",
    "name_relations": f"{_MENTIONS}, {_BETWEEN}, k as ({_KINDS}), n as (select a, b, relation, place, count(*) as n from k group by all) select a, b, arg_max(relation, n * 10 - place) as relation from n group by a, b",
}
