"""Line dedup by site-relative frequency.

Lines are compared with their pages' own host only: the share of a host's
pages that hold a line is the count of pages with the line over the host's page
total. A line whose share exceeds the boilerplate ratio is dropped from every
page of that host.

Pages are a host's rows with a text. With copies="once" equal texts of a host
are one page, so that a group of copies can't make its own content look like
boilerplate; the pipeline, which drops copies later, takes them so.

Lines are compared by 128 bits of hash: among 10^12 different lines the chance
that any two agree is about 10^-15.

All steps are DataFrame operations. Counts are pre-aggregated before each
shuffle, lines meet the boilerplate list by host and line, and its hits return
to their pages by host and text: no step gathers a host's pages or lines, so a
host may hold any share of all rows. A line or a text that very many rows share
is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written

MAX_RATIO = 0.05
MIN_PAGES = 3
BLANKS = " \t\r"
COPIES = ("each", "once")


def _line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashed(line: Column) -> Column:
    return F.struct(F.xxhash64(_line_key(line)).alias("h1"), F.xxhash64(F.lit("line"), _line_key(line)).alias("h2"))


def _page_lines(pages: DataFrame, host: str, text: str) -> DataFrame:
    """(host, page, line) for every page and distinct line that isn't blank; page is the text's hash."""
    base = pages.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), F.col(text).alias("body"))
    filled = F.filter(F.transform(_lines(F.col("body")), _line_key), lambda x: x != "")
    return base.select("host", "page", F.explode_outer(F.array_distinct(filled)).alias("text")).where(F.col("text").isNotNull()).select("host", "page", _hashed(F.col("text")).alias("line"))


def boilerplate_lines(pages: DataFrame, *, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: str = "once") -> DataFrame:
    """(host, line, n_pages, host_pages) of the lines over the ratio; line is a struct of two hashes.

    Lines are compared without blanks at their ends; empty lines and null
    texts count for nothing; a null host is a host of its own.
    """
    if copies not in COPIES:
        raise ValueError(f"copies must be one of {COPIES}")
    once = copies == "once"
    page = F.count_distinct(F.xxhash64(text)) if once else F.count(F.lit(1))
    totals = pages.where(F.col(text).isNotNull()).groupBy(F.col(host).alias("total_host")).agg(page.alias("host_pages"))
    lines = _page_lines(pages, host, text)
    counts = (lines.distinct() if once else lines).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    return (
        counts.join(totals, counts["host"].eqNullSafe(totals["total_host"]))
        .where(F.col("n_pages") > F.lit(max_ratio) * F.col("host_pages"))
        .select("host", "line", "n_pages", "host_pages")
    )


def drop_boilerplate(pages: DataFrame, *, host: str = "source", text: str = "text", counted: bool = False, **how) -> DataFrame:
    """pages with boilerplate lines taken out of `text`; no row is dropped.

    Texts without such a line, and null and empty texts, stay as they are; a
    text of nothing else becomes empty. Very long texts are read whole,
    repeated rows and null ids stay, ties don't matter, an empty table gives no
    rows. With counted, `n_lines` and `n_dropped` are added, in place of columns
    of those names; all other columns stay.
    """
    bad = written(boilerplate_lines(pages, host=host, text=text, **how).select(F.col("host").alias("_mr_host"), "line"))
    lines = _page_lines(pages, host, text)
    met = lines.join(bad, lines["host"].eqNullSafe(bad["_mr_host"]) & (lines["line"] == bad["line"]))
    hits = met.groupBy(lines["host"].alias("_mr_host"), F.col("page").alias("_mr_page")).agg(F.collect_set(lines["line"]).alias("_mr_bad"))
    lined = pages.join(hits, pages[host].eqNullSafe(hits["_mr_host"]) & (F.xxhash64(pages[text]) == hits["_mr_page"]), "left").withColumn("_mr_lines", _lines(F.col(text)))
    some = F.col("_mr_bad").isNotNull()
    kept = lined.withColumn("_mr_kept", F.when(some, F.filter("_mr_lines", lambda x: ~F.array_contains(F.col("_mr_bad"), _hashed(x)))).otherwise(F.col("_mr_lines")))
    names = [c for c in pages.columns if not (counted and c in ("n_lines", "n_dropped"))]
    cleaned = F.when(some, F.array_join("_mr_kept", "\n")).otherwise(F.col(text))
    columns = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in names]
    if counted:
        size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
        columns += [size("_mr_lines").alias("n_lines"), (size("_mr_lines") - size("_mr_kept")).alias("n_dropped")]
    return kept.select(*columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without boilerplate lines, n_lines, n_dropped of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, counted=True, copies="each").drop("source")


OP4_SQL = f"""
with p as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
l as (select source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, chr(32) || chr(9) || chr(13))))) as line from p),
t as (select source, count(text) as total from p group by source),
bad as (select source, list(line) as bad from (
    select source, line, count(*) as n from l where line <> '' group by source, line having count(*) >= {MIN_PAGES})
  join t using (source) where n > {MAX_RATIO} * total group by source),
k as (select doc_id, text, lines, list_filter(lines, lambda x: not coalesce(list_contains(bad, trim(x, chr(32) || chr(9) || chr(13))), false)) as kept
  from p left join bad using (source))
select doc_id, case when len(kept) = len(lines) then text else array_to_string(kept, chr(10)) end as text,
  len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped
from k
"""
