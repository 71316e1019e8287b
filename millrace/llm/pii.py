"""Personal data: patterns, then information-theoretic sanitisation of terms.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers. They
are the protected entities. A term that shares documents with an entity can
reveal it without being one: how much is estimated from corpus co-occurrence.
With I(e) = -log2 p(e) the information of an entity kind and
PMI(t; e) = log2(p(t, e) / (p(t) p(e))), the term t discloses the share
PMI(t; e) / I(e) of it; the share is 1 when the term never occurs without the
entity. Terms whose share exceeds the disclosure threshold are risky: wherever
they occur, in any document, they are generalised (numbers) or removed (other
terms), and reported as spans of kind `term`.

Probabilities are shares of all documents, read whole: p(t) counts the
documents that hold t outside base spans, p(t, e) those of them that hold an
entity of kind e as well. The share must not be chance: if t were independent
of e, so many of t's distinct texts (copies of a text are one text there) would
hold e with a probability of exp(-n KL(k/n || p(e))) at most (Chernoff), which
for k = n is exactly p(e)^n. Every term is tried with every kind, and among so
many trials some look unlikely by chance: of the terms that are called risky, a
share of `discovery` at most is expected to be such (Benjamini and Hochberg's
rule over all trials; a histogram of the bounds' logarithms gives the cut in
one pass). No number of texts is demanded as such.

DataFrame operations only. Patterns are written without backtracking (possessive
quantifiers and look-behinds that give the same matches), so that a long run of
digits or letters costs linear time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
#: The match may start where the previous one ended or at the start of a run of its first class.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,match:string>>"
DISCLOSURE = 0.8
#: Share at most, of the terms called risky, that is expected to be independent of the entity.
DISCOVERY = 0.05
#: Cells of the histogram for one unit of the bound's logarithm, and its last cell: bounds beyond it are alike.
CELLS = 8
LAST_CELL = 8 * 700
#: Up to so many risky terms every text is met with their list; beyond it a join finds each text's own, with the same result.
LISTED_TERMS = 2_000
#: In that join, risky terms of three texts or more are broadcast up to this count; beyond it the join shuffles.
BROADCAST_TERMS = 500_000
#: Items that are scanned together; it only sets the speed.
CHUNK = 32
#: Stands for every character of a base span while terms are cut out.
MASK = "\ue000"
MASKED_TERM = r"[\p{L}\p{N}\x{E000}]+"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum of up to 19 digits is a multiple of ten."""
    total = F.lit(0)
    for k in range(19):  # from the last digit
        d = F.try_element_at(F.split(F.reverse(digits), ""), F.lit(k + 1)).cast("int")
        d = F.coalesce(d, F.lit(0))
        total = total + (d if k % 2 == 0 else F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(items: Column) -> Column:
    """An array in pieces of CHUNK, at least one."""
    count = lambda x: F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / CHUNK).cast("int")
    return _let(items, lambda x: F.transform(F.sequence(F.lit(0), count(x)), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK))))


def _running(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column], zero: Column, levels: int = 2) -> Column:
    """array<struct<before, item>>: each item with its predecessors' values, joined.

    The items of a chunk, the chunks of a chunk of chunks, and so on: an array of
    n takes about n CHUNK / 2 steps, and (n / CHUNK^levels)^2 / 2 more on the last level.
    No array or text grows by appending.
    """
    inside = lambda c, start: F.transform(c, lambda x, j: F.struct(F.aggregate(F.slice(c, F.lit(1), j), start, lambda acc, y: join(acc, value(y))).alias("before"), x.alias("item")))
    if not levels:
        return _let(items, lambda c: inside(c, zero))

    def per_chunk(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda acc, x: join(acc, value(x))))
        starts = _running(totals, lambda t: t, join, zero, levels - 1)
        return _let(starts, lambda s: F.flatten(F.transform(chunks, lambda c, i: inside(c, s[i]["before"]))))

    # Each array is worked out once: its name is bound before it is used again. An empty one is one empty chunk.
    return _let(items, lambda x: _let(_chunks(x), per_chunk))


def _positions(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of every match in code points; null where there is none.

    The pieces between matches and the matches alternate, so positions are
    running sums of their lengths.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("match"))
        sums = _running(pairs, lambda x: F.length(x["piece"]) + F.length(x["match"]), lambda a, b: a + b, F.lit(0))
        start = lambda r: r["before"] + F.length(r["item"]["piece"])
        return F.transform(sums, lambda r: F.struct(start(r).alias("start"), (start(r) + F.length(r["item"]["match"])).alias("end"), r["item"]["match"].alias("match")))

    return _let(found, lambda x: F.when(F.size(x) > 0, placed(x)))


def _located(text: Column, kind: str) -> Column:
    """array<struct<start, end, match>> of every match, valid or not."""
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    return F.coalesce(F.when(may, _positions(text, PATTERNS[kind])), empty)


def _rewritten(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with each of the spans, in order of start, as put(span, reach); reach is the end of those before.

    Text is cut by chunks of spans first, so that a piece is not looked for
    from the text's first letter.
    """

    def chunk(c: Column) -> Column:
        low, high = c[0]["before"], F.array_max(F.transform(c, lambda r: F.greatest(r["before"], r["item"]["end"])))
        own = lambda r, cut: F.concat(F.substring(cut, r["before"] - low + 1, F.greatest(r["item"]["start"] - r["before"], F.lit(0))), put(r["item"], r["before"]))
        return _let(F.substring(text, low + 1, high - low), lambda cut: F.array_join(F.transform(c, lambda r: own(r, cut)), ""))

    reached = _running(spans, lambda x: x["end"], lambda a, b: F.greatest(a, b), F.lit(0))
    body = F.array_join(F.transform(_chunks(reached), chunk), "")
    return F.when(F.size(spans) > 0, F.concat(body, F.substring(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length(text)))).otherwise(text)


def _checked(no: int, kind: str) -> Column:
    valid = F.filter(f"all_{kind}", lambda x: _valid(kind, x["match"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match")))


def base_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, body, n_email, n_ip, n_card, n_phone, base) of every row of docs.

    base is array<struct<start, kind_no, end, kind, match>> in order of start,
    then of kind. Null texts count as empty. Rows that are repeated are kept.
    """
    return _with_base(docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body")))


def _with_base(df: DataFrame) -> DataFrame:
    """df with n_ columns and base from its body."""
    names = df.columns
    df = df.select("*", *[_located(F.col("body"), k).alias(f"all_{k}") for k in KINDS])
    df = df.select(*names, *[_checked(no, k).alias(k) for no, k in enumerate(KINDS)])
    return df.select(*names, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sort_array(F.concat(*[F.col(k) for k in KINDS])).alias("base"))


def _with_mask(spans: DataFrame) -> DataFrame:
    """spans with `masked`, the body with its base spans as runs of MASK; positions stay. A term that touches one holds MASK."""
    hide = lambda x, reach: F.repeat(F.lit(MASK), F.greatest(x["end"] - F.greatest(x["start"], reach), F.lit(0)))
    plain = spans.withColumn("plain", F.replace("body", F.lit(MASK), F.lit(" ")))
    return plain.withColumn("masked", _rewritten(F.col("plain"), F.col("base"), hide)).drop("plain")


def _held_terms() -> Column:
    """The distinct terms of the row's masked text."""
    return F.array_distinct(F.transform(F.regexp_extract_all("masked", F.lit(MASKED_TERM), F.lit(0)), F.lower))


def _terms(spans: DataFrame, keep: list[str], *, whole: bool = False) -> DataFrame:
    """A row per row of spans and distinct term outside its base spans; with `whole` one more with a null term for each row."""
    found = F.concat(F.array(F.lit(None).cast("string")), _held_terms()) if whole else _held_terms()
    rows = _with_mask(spans).select(*keep, F.explode_outer(found).alias("term"))
    kept = ~F.contains("term", F.lit(MASK))
    return rows.where(kept | F.col("term").isNull() if whole else kept)


def disclosing_terms(spans: DataFrame, *, disclosure: float = DISCLOSURE, discovery: float = DISCOVERY) -> DataFrame:
    """(term, kind, n_texts, disclosed, first_page, last_page) of the terms over the threshold.

    spans has (page, body, base) of all documents; page identifies a text, and
    first_page and last_page are the least and the greatest that hold the term.
    Documents are counted per term and kind in one aggregation.
    """
    copies = written(spans.groupBy("page").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    weighed = spans.join(copies, "page", "left").withColumn("one", 1 / F.coalesce("copies", F.lit(1)))
    kinds = F.transform("base", lambda b: b["kind"])
    held = [F.array_contains(kinds, k).alias(f"has_{k}") for k in KINDS]
    weighed = weighed.select("page", "body", "base", "one", *held)
    sums = ["n_docs", "n_texts", *[f"{x}_{k}" for k in KINDS for x in ("docs", "texts")]]
    counts = [F.count(F.lit(1)).alias("n_docs"), F.sum("one").alias("n_texts")]
    for k in KINDS:
        counts += [F.count_if(f"has_{k}").alias(f"docs_{k}"), F.sum(F.when(F.col(f"has_{k}"), F.col("one")).otherwise(0.0)).alias(f"texts_{k}")]
    # A text without any term is counted by a null, so that one pass counts terms and documents.
    rows = _terms(weighed, ["page", "one", *[f"has_{k}" for k in KINDS]], whole=True)
    per = written(rows.groupBy("term").agg(*counts, F.min("page").alias("first_page"), F.max("page").alias("last_page")))
    every = per.where("term is null").first()
    whole = {c: every[c] for c in sums} if every else dict.fromkeys(sums, 0)
    terms = per.where("term is not null")
    n_terms = terms.count()
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), *[F.col(f"{x}_{k}").alias(x) for x in ("docs", "texts")], *[F.lit(whole[f"{x}_{k}"]).alias(f"all_{x}") for x in ("docs", "texts")]) for k in KINDS]))
    some = terms.where(" or ".join(f"docs_{k} > 0" for k in KINDS))
    scored = some.select("term", "n_docs", "n_texts", "first_page", "last_page", each.alias("x")).select("*", "x.*").where((F.col("docs") > 0) & (F.col("all_docs") < whole["n_docs"]))
    info = F.log2(whole["n_docs"] / F.col("all_docs"))
    pmi = F.log2(F.col("docs") * whole["n_docs"] / (F.col("n_docs") * F.col("all_docs")))
    # Shares of distinct texts; sums of 1/copies are whole numbers but for rounding.
    p, share = F.col("all_texts") / whole["n_texts"], F.least(F.col("texts") / F.col("n_texts"), F.lit(1.0))
    rest = F.when(F.round("texts") < F.round("n_texts"), (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    bound = F.when(share > p, F.col("n_texts") * (share * F.log(share / p) + rest)).otherwise(0.0)
    scored = scored.withColumn("cell", F.least(F.floor(bound * CELLS + 1e-6), F.lit(LAST_CELL)).cast("int"))
    # At most LAST_CELL rows come to the driver. Trials without a common document have a bound of 0.
    cells = scored.where("cell > 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("cell")).collect()
    cut = discovery_cut([(r.cell, r.n) for r in cells], n_terms * sum(0 < whole[f"docs_{k}"] < whole["n_docs"] for k in KINDS), discovery)
    found = scored.where(F.col("cell") >= cut).select("term", "kind", F.round("n_texts").cast("long").alias("n_texts"), (pmi / info).alias("disclosed"), "first_page", "last_page")
    return found.where(F.col("disclosed") > disclosure)


def discovery_cut(cells: list[tuple[int, int]], trials: int, discovery: float) -> int:
    """The least cell from which on the expected share of chance is `discovery` at most; cells fall, each with its number of trials."""
    cut, seen = LAST_CELL + 1, 0
    for cell, n in cells:
        seen += n
        if math.exp(-cell / CELLS) * trials <= discovery * seen:
            cut = cell
    return cut


def _flagged(spans: DataFrame, risky: DataFrame) -> DataFrame:
    """(page, terms): the risky terms that each text holds outside its base spans.

    A term of one or two texts names them itself, as its first and last page.
    Only the others are looked for in the texts: they are broadcast up to a
    counted size, and beyond it the same join shuffles.
    """
    rare = risky.where("n_texts <= 2").select(F.explode(F.array_distinct(F.array("first_page", "last_page"))).alias("page"), "term")
    often = risky.where("n_texts > 2").select("term")
    often = F.broadcast(often) if often.count() <= BROADCAST_TERMS else often
    common = _terms(spans, ["page"]).join(often, "term").select("page", "term")
    return written(rare.unionByName(common).groupBy("page").agg(F.collect_set("term").alias("terms")))


def _term_spans() -> Column:
    """Spans of every occurrence of the row's `terms` in its masked text.

    Words and terms are sorted together, terms before equal words: a word is
    hit where the greatest term so far is the word itself.
    """
    words = F.transform(_positions(F.col("masked"), MASKED_TERM), lambda x: F.struct(F.lower(x["match"]).alias("term"), x["start"].alias("start"), x["end"].alias("end")))
    marks = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(-1).alias("start"), F.lit(-1).alias("end")))
    placed = _running(F.sort_array(F.concat(marks, words)), lambda x: F.when(x["start"] < 0, x["term"]), lambda a, b: F.greatest(a, b), F.lit(None).cast("string"))
    hits = F.filter(placed, lambda r: (r["item"]["start"] >= 0) & (r["before"] == r["item"]["term"]))
    return F.transform(hits, lambda r: F.struct(r["item"]["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"), r["item"]["end"].alias("end"), F.lit("term").alias("kind"), r["item"]["term"].alias("match")))


def find_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE, discovery: float = DISCOVERY) -> DataFrame:
    """base_spans() with `spans`, the base spans and those of every disclosing term.

    A span of kind term never overlaps a base span. Null texts count as empty
    and have no spans; repeated rows stay; an id may be of any type and null;
    columns other than the two are not looked at. Very long texts and texts of
    very many matches take time in proportion (see _running()). Empty tables give no rows.
    """
    paged = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("page", F.xxhash64("body"))
    spans = _with_base(paged.select("page", "body"))
    terms = written(disclosing_terms(spans, disclosure=disclosure, discovery=discovery).groupBy("term", "n_texts", "first_page", "last_page").agg(F.max("disclosed").alias("disclosed")))
    listed = [r.term for r in terms.select("term").limit(LISTED_TERMS + 1).collect()]
    if len(listed) <= LISTED_TERMS:
        marked = _with_mask(_with_base(paged))
        marked = marked.withColumn("terms", F.array_intersect(_held_terms(), F.lit(sorted(listed)).cast("array<string>")) if listed else F.lit(None).cast("array<string>"))
        marked = marked.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")))
    else:
        marked = _with_mask(_with_base(paged.join(_flagged(spans, terms), "page", "left")))
    none = F.array().cast(SPANS)
    extra = F.when(F.col("terms").isNotNull(), F.coalesce(_term_spans(), none)).otherwise(none)
    return marked.select("doc", *[f"n_{k}" for k in KINDS], "base", F.sort_array(F.concat("base", extra)).alias("spans"), "body")


def sanitised(found: DataFrame) -> DataFrame:
    """found with `clean`: base spans become <KIND>, number terms <number>, other terms go; null where there are no spans."""
    name = lambda x: F.when(x["kind"] != "term", F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))).when(x["match"].rlike("^[0-9]+$"), F.lit("<number>")).otherwise(F.lit(""))
    # A span that starts inside one that is already replaced adds nothing.
    put = lambda x, reach: F.when(x["start"] < reach, F.lit("")).otherwise(name(x))
    return found.withColumn("clean", F.when(F.size("spans") > 0, _rewritten(F.col("body"), F.col("spans"), put)))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every document, and `clean`, its text with the spans generalised or removed."""
    found = sanitised(find_personal_data(table(spark, sf_dir, "documents")))
    n_terms = (F.size("spans") - F.size("base")).cast("long").alias("n_terms")
    return found.select(F.col("doc").alias("doc_id"), *[f"n_{k}" for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), n_terms, "clean")
