"""Toxicity by maximum-scoring segments.

Tokens (words, and letter prefixes of words as stems) get log-odds between toxic
and clean labelled documents under a Dirichlet prior that is proportional to
their frequency in both (so rare tokens are shrunk), and a z-score; tokens with
a large and significant excess in toxic documents form the lexicon. A word that training
has seen too seldom is smoothed towards its stem by count; a word never seen
takes the score of its longest stem. Inside a toxic passage a share `DENSITY` of the tokens is
taken to come from it. A token's score is the log ratio of its probability in
such a passage to that in clean text: positive for the lexicon, negative for
everything else, so that segment sums follow extreme-value theory.

One linear scan finds every maximal segment of positive sum. In clean text the
best segment S of n tokens has P(S > x) = 1 - exp(-K n e^-x); K is fitted on
clean documents. A document's excess, the sum of its segments' scores above
log(K n), is turned into a probability by a logistic fit on the labelled
documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import sampled, table, words, written

THRESHOLD = 0.7
DENSITY = 0.25
#: Weight of the prior, as a share of all tokens counted.
PRIOR = 0.1
MIN_Z = 4.0
#: Least log-odds of a lexicon token: at least eight times likelier in toxic text. Unlike z it doesn't grow with the rows, so no weak tilt comes in with more data.
MIN_ODDS = math.log(8)
#: A passage is reported where so many like it are expected in a clean document at most.
MAX_EXPECTED = 0.01
#: The model is fitted on about so many labelled rows at most, those of least hashed id; it bounds labels sent to tasks and the lexicon.
MAX_SAMPLE = 200_000
#: Letters of the prefixes (written with a star) that stand in for words of little evidence.
STEMS = (5, 7)
#: A word without significance of its own leans on its stem as much as on so many occurrences.
BACK_OFF = 2.0
_TOKEN = re.compile(r"[^\W_]+")


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


class Model(NamedTuple):
    scores: dict[str, float]
    neutral: float
    k: float
    slope: float
    offset: float


def maximal_segments(positions: list[int], gains: list[float], neutral: float, steps: list[int] | None = None) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score), in linear time.

    positions and gains are those of lexicon tokens; all tokens between score
    `neutral`. Candidates are kept with the running sums before and after them
    and a link to the nearest candidate to the left whose left sum is lower. A
    new candidate joins that one as long as its right sum isn't higher. Links
    skip all candidates between, so each is passed over once. steps, where
    given, counts the links followed.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, link
    total, last, followed = 0.0, -1, 0
    for at, gain in zip(positions, gains, strict=True):
        total += neutral * (at - last - 1)
        first, before, after = at, total, total + gain
        total, last = after, at
        link = len(kept) - 1
        while link >= 0 and kept[link][2] >= before:
            link, followed = kept[link][4], followed + 1
        while link >= 0 and kept[link][3] < after:
            first, _, before, _, lower = kept[link]
            del kept[link:]
            link, followed = lower, followed + 1
        kept.append((first, at, before, after, link))
    if steps is not None:
        steps.append(followed)
    return [(a, b, right - left) for a, b, left, right, _ in kept]


def gain(word: str, scores: dict[str, float]) -> float:
    """The score of the word, or where it has no entry that of its longest stem with one."""
    s = scores.get(word)
    for k in reversed(STEMS):
        if s is None and len(word) > k:
            s = scores.get(word[:k] + "*")
    return s or 0.0


def scan(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """Tokens and all maximal segments of a text."""
    tokens = _TOKEN.findall((text or "").lower())
    hits = [(i, s) for i, t in enumerate(tokens) if (s := gain(t, model.scores))]
    if not hits:
        return len(tokens), []
    return len(tokens), maximal_segments([i for i, _ in hits], [s for _, s in hits], model.neutral)


def _excess(scores: list[float], n: int, k: float) -> float:
    """log(1 + x) of the sum of the segments' scores, each above the best that n clean tokens are expected to give.

    The logarithm keeps a few very long texts from ruling the fit.
    """
    chance = max(0.0, math.log(k * max(n, 1)))
    return math.log1p(sum(max(0.0, s - chance) for s in scores))


def _labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column | None, most: int) -> DataFrame:
    """(doc_id, text, label) of the sample; held out ids go before any text is met."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out) if held_out is not None else known
    known = written(sampled(known.groupBy("doc_id").agg(F.max(label).alias("label")), "doc_id", most))
    # At most about MAX_SAMPLE rows of 16 bytes, whatever the tables' size.
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def _stems(words_: str, k: int) -> Column:
    return F.transform(F.filter(words_, lambda x: F.length(x) > k), lambda x: F.concat(F.substring(x, 1, k), F.lit("*")))


def fit_lexicon(train: DataFrame) -> tuple[dict[str, float], float]:
    """Scores of significant tokens, and the score of all others.

    train has (text, label). Counts are taken over all of it, a token once per
    distinct line: neither a text that repeats a word nor a group of copies and
    near copies can make a word look typical. Words and each length of stem are
    counted apart. All significant tokens come to the driver, and a score of 0
    for each seen word (or stem) that isn't one but has a stem that is.
    """
    once = train.select("label", F.explode_outer(F.split("text", "\n")).alias("line")).distinct()
    tokens = once.select("label", words(F.col("line")).alias("w")).select("label", F.explode_outer(F.array_distinct(F.concat("w", *[_stems("w", k) for k in STEMS]))).alias("token")).where(F.col("token").isNotNull())
    counts = written(tokens.groupBy("token").agg(F.sum((F.col("label") == 1).cast("double")).alias("t"), F.sum((F.col("label") != 1).cast("double")).alias("c")))
    level = F.when(F.endswith("token", F.lit("*")), F.length("token") - 1).otherwise(0)
    counts = counts.withColumn("level", level)
    totals = {r.level: r for r in counts.groupBy("level").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()}
    if 0 not in totals or not totals[0].t or not totals[0].c:
        return {}, math.log(1 - DENSITY)
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("level"))
    total_t, total_c = of({k: r.t for k, r in totals.items()}), of({k: r.c for k, r in totals.items()})
    weight = PRIOR * (total_t + total_c)
    prior = (F.col("t") + F.col("c")) * PRIOR
    t, c = F.col("t") + prior, F.col("c") + prior
    rest = lambda x: F.greatest(x, F.lit(1e-9))  # a level may have one token only
    odds = F.log(t / rest(total_t + weight - t)) - F.log(c / rest(total_c + weight - c))
    scored = counts.select("token", "level", "t", "c", total_t.alias("rest_t"), total_c.alias("rest_c"), (t / (total_t + weight)).alias("pt"), (c / (total_c + weight)).alias("pc"), ((odds >= MIN_ODDS) & (odds / F.sqrt(1 / t + 1 / c) >= MIN_Z)).alias("typical"))
    top = scored.where("typical")
    sums = {r.level: r for r in top.groupBy("level").agg(F.sum("pt").alias("mass"), F.sum("pc").alias("clean")).collect()}
    if not sums:
        return {}, math.log(1 - DENSITY)
    passage = F.log(DENSITY * F.col("pt") / of({k: r.mass for k, r in sums.items()}) / F.col("pc"))
    rated = F.log((F.col("t") + 0.5) * F.col("rest_c") / ((F.col("c") + 0.5) * F.col("rest_t")))
    each = written(scored.select("token", "level", F.col("t") + F.col("c"), rated, F.when(F.col("typical") & F.col("level").isin([int(k) for k in sums]), F.greatest(passage, F.lit(0.0)))).toDF("token", "level", "n", "rated", "own"))
    entries = each.where("own > 0 and level = 5").select("token", F.col("own").alias("score"))
    for level in (7, 0):
        head = F.when(F.lit(level == 0) & (F.length("token") > 7), F.substring("token", 1, 7)).when(F.length("token") > 5, F.substring("token", 1, 5))
        mine = each.where(F.col("level") == level).withColumn("head", F.concat(head, F.lit("*")))
        trust = F.col("n") / (F.col("n") + BACK_OFF)
        smooth = F.when(F.col("parent") > 0, F.greatest(F.lit(0.0), (1 - trust) * F.col("parent") + trust * F.col("rated"))).otherwise(F.col("parent"))
        joined = mine.join(entries.select(F.col("token").alias("head"), F.col("score").alias("parent")), "head", "left")
        found = joined.select("token", F.coalesce(F.when(F.col("own") > 0, F.col("own")), smooth).alias("score")).where("score is not null")
        entries = written(entries.unionByName(found))
    scores = {r.token: r.score for r in entries.collect()}
    clean = sums[0].clean if 0 in sums else 0.0
    return scores, math.log((1 - DENSITY) / max(1 - clean, 1e-9))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", held_out: Column | None = None, max_sample: int = MAX_SAMPLE) -> Model:
    """A model from the labelled rows that aren't held out, max_sample of them at most; without both labels it scores 0.5 at most."""
    train = written(_labelled(docs, labels, label, held_out, max_sample))
    scores, neutral = fit_lexicon(train)
    rough = Model(scores, neutral, 1.0, 1.0, 0.0)
    floor = min((s for s in scores.values() if s > 0), default=1.0)

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = [scan(x, rough) for x in batch["text"]]
            yield pd.DataFrame({"n": [n for n, _ in seen], "over": [sum(s >= floor for _, _, s in found) for _, found in seen]})

    # Clean text has K n e^-floor segments of at least that score.
    total, over = train.where("label <> 1").select("text").mapInPandas(tails, "n long, over long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("over"), F.lit(0))).first()
    k = (over + 1) / ((total + 1) * math.exp(-floor))

    def excesses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = [scan(x, rough) for x in batch["text"]]
            yield pd.DataFrame({"toxic": batch["label"] == 1, "excess": [round(16 * _excess([s for _, _, s in found], n, k)) / 16 for n, found in seen]})

    # Sixteenths of a logarithm: a short table.
    cells = train.select("text", "label").mapInPandas(excesses, "toxic boolean, excess double").groupBy("toxic", "excess").agg(F.count(F.lit(1)).alias("rows")).orderBy("toxic", "excess").collect()
    slope, offset = _logistic(*(np.array([float(r[c]) for r in cells]) for c in ("excess", "toxic", "rows")))
    return Model(scores, neutral, k, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and offset by Newton steps with a weak ridge."""
    a, b = 0.1, 0.0
    for _ in range(60 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(weight * (p - y) * x) + 0.1 * a, np.sum(weight * (p - y)) + 0.1 * b])
        q = weight * p * (1 - p)
        h = np.array([[np.sum(q * x * x) + 0.1, np.sum(q * x)], [np.sum(q * x), np.sum(q) + 0.1]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = max(0.0, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score, n_tokens, passages) of every row.

    passages is array<struct<first, last, score>> in tokens: every segment of
    significance. Null and empty texts have no tokens and the lowest score;
    texts of any length are read whole in linear time; repeated rows and null
    ids stay; other columns are not looked at; an empty table gives no rows.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, sizes, passages = [], [], []
            for body in batch.column(1).to_pylist():
                n, found = scan(body, model)
                z = model.slope * _excess([s for _, _, s in found], n, model.k) + model.offset
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                sizes.append(n)
                passages.append([{"first": a, "last": b, "score": s} for a, b, s in found if model.k * max(n, 1) * math.exp(-s) <= MAX_EXPECTED])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(passages, segments)], names=["doc", "score", "n_tokens", "passages"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc {kind}, score double, n_tokens long, passages array<struct<first:long,last:long,score:double>>"
    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).mapInArrow(apply, schema)


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(F.col(doc_id), 3) == 1, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs without rows that score `threshold` or more; columns are unchanged.

    The decision is taken per distinct text.
    """
    model = fit(docs, labels, held_out=_held_out())
    body = F.coalesce(docs["text"], F.lit(""))
    scored = score(docs.select(F.sha2(body, 256).alias("key"), "text"), model, doc_id="key")
    bad = written(scored.where(F.col("score") >= threshold).select(F.col("doc").alias("_mr_key")).distinct())
    return docs.join(bad, F.sha2(body, 256) == bad["_mr_key"], "left_anti")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), held_out=_held_out())
    scored = score(docs, model)
    return scored.select(
        F.col("doc").alias("doc_id"),
        _held_out("doc").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )
