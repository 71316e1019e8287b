"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into quantile bins. Boosting visits the features in
turn; each visit fits a shallow tree on one feature's bins to the gradient and
adds a small share of it to that feature's lookup table. When the single tables
are done, the pairs whose joint bins explain most of what remains get tables of
their own in the same way. A score is an intercept plus one addition per table,
for whole batches at once.

The model is fitted on a bounded sample: about MAX_SAMPLE labelled rows, those
of least hashed id (all, where there are fewer). Scoring covers every row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import sampled, table, written

THRESHOLD = 0.7
MAX_SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
MAX_PAIRS = 6
ROUNDS = 120
RATE = 0.1

FEATURES = (
    "log_bytes",
    "log_words",
    "bytes_per_word",
    "upper",
    "digits",
    "blanks",
    "sentence_marks",
    "exclamations",
    "symbols",
    "other_marks",
    "distinct_words",
    "top_word",
    "top_five_words",
    "distinct_pairs",
    "words_per_line",
    "distinct_lines",
    "words_ending_in_mark",
)


def _byte_classes() -> np.ndarray:
    """The class of each byte: 0 other text, 1 upper case, 2 digit, 3 blank, 4 .,;:?'"-(), 5 !, 6 #$%&*+<=>@^_`{|}~, 7 other marks."""
    classes = np.zeros(256, np.uint8)
    for number, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\n", ".,;:?'\"-()", "!", "#$%&*+<=>@^_`{|}~", "[]\\/"), 1):
        classes[list(chars.encode())] = number
    return classes


_CLASSES = _byte_classes()


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; an empty one has zeros."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(FEATURES) - 1)
    share = np.bincount(_CLASSES[raw], minlength=8) / len(raw)
    n, counts, lines = len(words), Counter(words), text.split("\n")
    top = [c for _, c in counts.most_common(5)]
    marked = sum(not w[-1].isalnum() for w in words)
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(n)),
        len(raw) / n,
        *share[1:8].tolist(),
        len(counts) / n,
        top[0] / n,
        sum(top) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        n / len(lines),
        len(set(lines)) / len(lines),
        marked / n,
    ]


class Model(NamedTuple):
    intercept: float
    edges: list[np.ndarray]  # inner bin edges per feature
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins with gradient g and curvature h; 0 for none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree of this depth."""
    gain, at = _split(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cut by one axis, then by the other on each side."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, a.shape[0]):
            values, gain = np.empty_like(a), 0.0
            for part in (slice(None, at), slice(at, None)):
                row_g, row_h = a[part].sum(0), b[part].sum(0)
                own, cut = _split(row_g, row_h)
                base = row_g.sum() ** 2 / (row_h.sum() + 1)
                gain += own + base
                leaf = lambda p: -row_g[p].sum() / (row_h[p].sum() + 1)  # noqa: E731, B023
                values[part, :cut], values[part, cut:] = leaf(slice(None, cut)), leaf(slice(cut, None))
            if gain > best[0]:
                best = (gain, values.T.copy() if turn else values)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of rows of features and 0/1 labels; without rows it scores 0.5."""
    width = x.shape[1]
    edges = [_edges(x[:, j], BINS) if len(x) else np.empty(0) for j in range(width)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    rate = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(rate / (1 - rate)))
    logit = np.full(len(y), intercept)

    def slope():
        p = 1 / (1 + np.exp(-logit))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS if len(x) else 0):
        for j in range(width):
            g, h = slope()
            size = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            tables[j] += step
            logit += step[bins[j]]

    pair_edges = [_edges(x[:, j], PAIR_BINS) if len(x) else np.empty(0) for j in range(width)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]

    def joint(i: int, j: int):
        shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
        cell, (g, h) = coarse[i] * shape[1] + coarse[j], slope()
        return cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = sorted(((-_pair_tree(*joint(i, j)[1:])[0], i, j) for i, j in combinations(range(width), 2)), key=lambda r: r) if len(x) else []
    pairs = [(i, j) for _, i, j in gains[:MAX_PAIRS]]
    pair_tables = [np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)) for i, j in pairs]
    for _ in range(ROUNDS // 4):
        for k, (i, j) in enumerate(pairs):
            cell, g, h = joint(i, j)
            step = RATE * _pair_tree(g, h)[1]
            pair_tables[k] += step
            logit += step.ravel()[cell]
    return Model(intercept, edges, tables, pairs, pair_edges, pair_tables)


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1."""
    logit = np.full(len(x), model.intercept)
    for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)):
        logit += t[np.searchsorted(e, x[:, j], side="right")]
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        logit += t[np.searchsorted(model.pair_edges[i], x[:, i], side="right"), np.searchsorted(model.pair_edges[j], x[:, j], side="right")]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def with_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, FEATURES as array<double> `x`) of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in batch.column(len(keep)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], x], names=[*keep, "x"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("_mr_text")).mapInArrow(measure, f"{kinds}, x array<double>")


def fit_on(docs: DataFrame, labels: DataFrame, *, label: str = "quality", held_out: Column | None = None, max_sample: int = MAX_SAMPLE) -> Model:
    """A model of the sample. Null labels and ids are left out, of several labels of an id the greatest counts, no rows give scores of 0.5."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.where(~held_out) if held_out is not None else known
    # Ids are chosen first, so that only the sample's texts are measured; ids that repeat can't lift the rows above the bound.
    chosen = written(sampled(known.where("doc_id is not null"), "doc_id", max_sample))
    rows = with_features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["doc_id", "label"]).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_sample).select("label", "x").collect()
    x = np.array([r.x for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([float(r.label) for r in rows]))


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score) of every row.

    Null texts count as empty and have a score too; texts of any length are
    read whole; repeated rows and null ids stay; other columns are not looked
    at; an empty table gives no rows.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], dtype=np.float64).reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predict(model, x))], names=["doc", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).mapInArrow(apply, f"doc {kind}, score double")


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs, table(spark, sf_dir, "labels"), held_out=_held_out())
    return score(docs, model).select(F.col("doc").alias("doc_id"), _held_out("doc").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
