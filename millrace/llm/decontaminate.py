"""Benchmark decontamination: MinHash containment search.

A test item is short, a document may be long, so Jaccard similarity says
little. MinHash is therefore used for containment: the element of an item's
shingle set that minimises a hash function is a uniform sample of that set, so
the share of functions whose minimiser lies in a document estimates how much of
the item the document contains, whatever the document's length.

Items are partitioned by size. A partition (see SIZES) sets how many functions
are drawn and how many must hit, and bounds from below the runs of a document
that can contain one of its items. The smallest items can miss no run at all at
the threshold, so one function decides; large items draw more functions and
demand more hits, so that fewer documents need the exact check. Candidates are
verified by exact containment of shingle texts.

Everything here is DataFrame operations. The probe table has a bounded number
of rows per item; it is broadcast if it is counted to have a million rows at
most, and beyond that the same join shuffles, and adaptive execution splits a
shingle that very many documents share. The exact check meets shingles by document and
shingle, so no shingle and no item gathers its documents in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import explode_shingles, run_hash, run_text, table, words, written
from millrace.operators.lookups import small_broadcast

SHINGLE = 5
THRESHOLD = 0.8
#: Copies of an item's shingle list that the candidates of a very common item are dealt over.
SALTS = 16


class Size(NamedTuple):
    """A partition of items: the least number of shingles, functions to draw, hits needed."""

    least: int
    functions: int
    hits: int


#: Chance that a function hits is 0.8 at the threshold, so the chance to miss an item there is that of fewer hits.
SIZES = (
    Size(1, 1, 1),  # up to 3 shingles: all must be there, none is missed
    Size(4, 9, 1),  # one of 5 may lack: (1/5)^9 = 5e-7
    Size(8, 12, 2),  # 2e-7
    Size(32, 16, 4),  # 2.5e-7
    Size(128, 24, 8),  # 1e-7
)


def _of_size(n: Column, value: Callable[[Size], int]) -> Column:
    out = F.lit(value(SIZES[0]))
    for size in SIZES[1:]:
        out = F.when(n >= size.least, value(size)).otherwise(out)
    return out


def item_probes(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, n_item, h, weight, hits, least_runs): minimisers of each item.

    items has (item, words). weight is the number of functions that h
    minimises, hits and least_runs are those of the item's size partition.
    """
    shingles = explode_shingles(items, "words", ["item"], SHINGLE).select("item", run_hash(SHINGLE).alias("h")).distinct()
    most = max(s.functions for s in SIZES)
    signed = shingles.groupBy("item").agg(
        F.count(F.lit(1)).alias("n_item"),
        F.array(*[F.min_by("h", F.xxhash64(F.lit(j), "h")) for j in range(most)]).alias("sig"),
    )
    n = F.col("n_item")
    drawn = signed.select("item", "n_item", F.explode_outer(F.slice("sig", F.lit(1), _of_size(n, lambda s: s.functions))).alias("h"))
    counted = drawn.groupBy("item", "n_item", "h").agg(F.count(F.lit(1)).alias("weight"))
    return counted.select("*", _of_size(n, lambda s: s.hits).alias("hits"), F.ceil(_of_size(n, lambda s: s.least) * F.lit(threshold) - F.lit(1e-9)).alias("least_runs"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc, text_hash, item, n_item, n_common): every item contained to `threshold` or more.

    Containment is |item shingles in the document| / |item shingles| over
    distinct five-word shingles. Null and empty texts contain nothing, items
    without words are in nothing; repeated rows give one result row; texts of
    any length are read whole. A null id is an id like any other; texts of one
    item id are one item. Ties don't matter, other columns are not looked at,
    an empty table on either side gives no rows.
    """
    item_words = written(items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("words")).distinct())
    probes = small_broadcast(written(item_probes(item_words, threshold)))
    least = F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9))

    base = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    worded = base.select("doc", "text_hash", words(F.col("body")).alias("w"))
    candidates = written(
        explode_shingles(worded, "w", ["doc", "text_hash"], SHINGLE)
        .select("doc", "text_hash", "n_runs", run_hash(SHINGLE).alias("h"))
        .join(probes, "h")
        .where((F.col("n_runs") >= F.col("least_runs")) & (F.col("n_runs") >= least))
        .groupBy("doc", "text_hash", "item", "h")
        .agg(F.max("weight").alias("weight"), F.max("hits").alias("needed"))
        .groupBy("doc", "text_hash", "item")
        .agg(F.sum("weight").alias("found"), F.max("needed").alias("needed"))
        .where(F.col("found") >= F.col("needed"))
        .select("doc", "text_hash", "item")
    )

    # Every candidate's wanted shingles meet those of its document, by document and shingle.
    shingles = explode_shingles(item_words, "words", ["item"], SHINGLE).select("item", run_text(SHINGLE).alias("shingle")).distinct()
    per_item = written(shingles.groupBy("item").agg(F.collect_list("shingle").alias("shingles")))
    salted = per_item.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = candidates.withColumn("salt", F.pmod(F.xxhash64("doc", "text_hash"), F.lit(SALTS)).cast("int"))
    same_item = dealt["item"].eqNullSafe(salted["item"]) & (dealt["salt"] == salted["salt"])
    wanted = dealt.join(salted, same_item).select("doc", "text_hash", dealt["item"], F.size("shingles").cast("long").alias("n_item"), F.explode("shingles").alias("shingle"))

    ids = candidates.select(F.col("doc").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    held = worded.join(ids, worded["doc"].eqNullSafe(F.col("_d")) & (worded["text_hash"] == F.col("_t")), "left_semi")
    held = explode_shingles(held, "w", ["doc", "text_hash"], SHINGLE).select(F.col("doc").alias("_d"), F.col("text_hash").alias("_t"), run_text(SHINGLE).alias("_s")).distinct()
    match = wanted["doc"].eqNullSafe(F.col("_d")) & (wanted["text_hash"] == F.col("_t")) & (wanted["shingle"] == F.col("_s"))
    common = wanted.join(held, match).groupBy("doc", "text_hash", "item", "n_item").agg(F.count(F.lit(1)).alias("n_common"))
    return common.where(F.col("n_common") >= least)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the rows that contain a benchmark item; columns unchanged."""
    bad = written(contained_items(docs, items, doc_id=doc_id, text=text, **how).select("doc", "text_hash").distinct())
    bad = bad.select(F.col("doc").alias("_mr_doc"), F.col("text_hash").alias("_mr_hash"))
    match = docs[doc_id].eqNullSafe(bad["_mr_doc"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["_mr_hash"])
    return docs.join(bad, match, "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment of every contaminated pair."""
    pairs = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    pairs = pairs.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("n_item").alias("n_item")).agg(F.max("n_common").alias("n_common"))
    return pairs.withColumn("containment", F.col("n_common") / F.col("n_item"))


_SHINGLES_SQL = """
  select {key}, unnest(list_distinct(case when len(w) >= 5
      then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s
  from (select {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from {table})
"""

OP2_SQL = f"""
with d as ({_SHINGLES_SQL.format(key="doc_id", table="documents")}),
b as ({_SHINGLES_SQL.format(key="item_id", table="benchmark")}),
n as (select item_id, count(*) as n_item from b group by item_id)
select doc_id, item_id, n_item, count(*) as n_common, count(*) / n_item as containment
from d join b using (s) join n using (item_id)
group by doc_id, item_id, n_item
having count(*) >= ceil(n_item * 0.8 - 1e-9)
"""
