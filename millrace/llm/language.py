"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound from the
vectors of its letters, each permuted (rotated) once for every place that it
stands before the last, by elementwise multiplication. A text's vector bundles
(adds) those of all its n-grams; a language's prototype bundles the texts
that are known to be in it, each scaled to the same length. A document gets the
language whose prototype has the largest cosine with its vector.

Letters are drawn from their code points, so any script has vectors without a
table of letters. n-grams of a batch meet their vectors in one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written

DIMENSIONS = 2048
GRAM = 3
SEED = 20_240
#: A language's prototype bundles about so many texts at most, those of least hash.
MAX_SAMPLE = 20_000
#: Prototypes are sent to every task, so more languages than this are an error.
MAX_LANGUAGES = 2_000
#: A text's vector is scaled to this length and rounded, so that sums of them are the same in any order.
LENGTH = 1 << 20
#: Letters, and n-grams, of one matrix product; they bound memory only.
CHUNK = 400_000
COLUMNS = 4_096
#: Letter vectors that a worker keeps.
LETTERS = 20_000
NONE = "und"


def letters(text: Column) -> Column:
    """Lower-case letters and marks; everything else is one blank. Null and texts without a letter give ''."""
    body = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "))
    return F.when(F.regexp_like(body, F.lit(r"\p{L}")), body).otherwise("")


class Space:
    """Vectors of letters and n-grams."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED):
        if not 1 <= gram <= 3:
            raise ValueError("n-grams have 1 to 3 letters: three code points fit a 64-bit number")
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self._kept: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        found = self._kept.get(code)
        if found is None:
            if len(self._kept) >= LETTERS:
                self._kept.clear()
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dimensions, dtype=np.int8)
            found = self._kept[code] = bits * np.int8(2) - np.int8(1)
        return found

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams, given as rows of code points."""
        out = np.ones((len(grams), self.dimensions), np.int8)
        for place in range(self.gram):
            codes, at = np.unique(grams[:, place], return_inverse=True)
            turned = np.stack([np.roll(self.letter(int(c)), self.gram - 1 - place) for c in codes]) if len(codes) else out
            out *= turned[at]
        return out

    def bundles(self, texts: list[str]) -> np.ndarray:
        """The vector of each text, all of its n-grams; texts are as from letters()."""
        framed = [f" {t} " if t else "" for t in texts]
        codes = np.frombuffer("".join(framed).encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum([len(t) for t in framed])
        total = np.zeros((len(texts), self.dimensions), np.float64)
        starts = np.arange(len(codes) - self.gram + 1)
        doc = np.searchsorted(ends, starts, side="right")
        inside = starts + self.gram <= ends[doc] if len(starts) else np.zeros(0, bool)
        starts, doc = starts[inside], doc[inside]
        packed = np.zeros(len(starts), np.int64)
        for place in range(self.gram):
            packed = packed << 21 | codes[starts + place]
        kinds, at = np.unique(packed, return_inverse=True)
        order = np.argsort(at, kind="stable") if len(kinds) > COLUMNS else np.arange(len(at))
        bounds = np.searchsorted(at[order], np.arange(0, len(kinds) + COLUMNS, COLUMNS)) if len(kinds) > COLUMNS else [0, len(at)]
        for low, a, b in zip(range(0, len(kinds), COLUMNS), bounds[:-1], bounds[1:], strict=False):
            part = kinds[low : low + COLUMNS]
            mine = order[a:b]
            counts = np.bincount(doc[mine] * len(part) + at[mine] - low, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
            grams = np.stack([part >> 21 * (self.gram - 1 - p) & 0x1FFFFF for p in range(self.gram)], axis=1)
            # Sums of whole numbers below 2^24 are exact in single precision.
            kind = np.float32 if counts.max(initial=0) * len(part) < 1 << 24 else np.float64
            total += counts.astype(kind) @ self.bound(grams).astype(kind)
        return total


class Model(NamedTuple):
    languages: list[str]
    prototypes: np.ndarray  # of length 1
    space: Space


def _rounds(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK letters and 256 rows at most; a row is never cut."""
    sizes = pc.utf8_length(batch.column(text)).to_numpy()
    low = size = 0
    for i, n in enumerate(sizes):
        if i > low and (size + n > CHUNK or i - low >= 256):
            yield batch.slice(low, i - low)
            low, size = i, 0
        size += n
    if len(batch) > low:
        yield batch.slice(low)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(length > 0, length, 1.0)


def sample_of(docs: DataFrame, *, held_out: Column, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """(lang, body) to learn from: equal texts of a language count once, of each language about max_sample at most.

    held_out is over doc_id and lang only. Rows without id, language or letter
    are not learned from.
    """
    rows = docs.where(~held_out & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.regexp_like("text", F.lit(r"\p{L}"))).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    once = written(rows.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")))
    sizes = once.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; prototypes of all of them are sent to every task")
    share = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, min(1.0, max_sample / r.n)) for r in sizes], "lang string, share double"))
    # By the same rule on both sides, so that only the sample's texts are shuffled, if any.
    least = lambda df: df.join(share, "lang").where(F.shiftrightunsigned(F.xxhash64("h"), 11) / 2.0**53 < F.col("share")).drop("share")
    return least(rows).join(least(once), ["doc_id", "lang", "h"], "left_semi").select("lang", letters(F.col("text")).alias("body"))


def fit(sample: DataFrame, *, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED) -> Model:
    """Prototypes of the sample's languages; an empty one gives a model without languages."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions, gram, seed), {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["lang", "total"])

        for batch in batches:
            for part in _rounds(batch, 1):
                whole = np.rint(_scaled(space.bundles(part.column(1).to_pylist())) * LENGTH).astype(np.int64)
                names = np.array(part.column(0).to_pylist(), object)
                for name in dict.fromkeys(names.tolist()):
                    sums[name] = sums.get(name, 0) + whole[names == name].sum(axis=0)
        if sums:
            yield rows()

    parts = sample.select("lang", "body").mapInArrow(bundle, "lang string, total array<long>")
    cells = parts.select("lang", F.posexplode("total").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("cells")).orderBy("lang").collect()
    total = np.array([[c.value for c in r.cells] for r in rows], np.float64).reshape(len(rows), dimensions)
    return Model([r.lang for r in rows], _scaled(total), Space(dimensions, gram, seed))


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lang_pred, score) of every row.

    score is the cosine with the language's prototype, 0 where it is negative;
    of equal cosines the first language by name counts. Null and empty texts
    and texts without a letter are `und` with score 0, and so is everything
    where no language was learned. Texts of any length are read whole; repeated
    rows and null ids stay; other columns are not looked at; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(model.space.dimensions, model.space.gram, model.space.seed)
        names = np.array([*model.languages, NONE], object)
        for batch in batches:
            for part in _rounds(batch, 1):
                vectors = _scaled(space.bundles(part.column(1).to_pylist()))
                known = (pc.utf8_length(part.column(1)).to_numpy() > 0) & bool(model.languages)
                likeness = vectors @ model.prototypes.T if model.languages else np.zeros((len(part), 1))
                best = np.where(known, likeness.argmax(axis=1), len(model.languages))
                score = np.where(known, np.clip(likeness.max(axis=1), 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score)], names=["doc", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc"), letters(F.col(text)).alias("body")).mapInArrow(run, f"doc {kind}, lang_pred string, score double")


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a null id is not held out, and not learned from either."""
    docs = table(spark, sf_dir, "documents")
    model = fit(sample_of(docs, held_out=_held_out()))
    return predict(docs, model).select(F.col("doc").alias("doc_id"), _held_out("doc").alias("held_out"), "lang_pred", "score")
