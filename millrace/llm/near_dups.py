"""MinHash near-duplicates by DartMinHash.

A document is a weighted set of five-word shingles. For every element a fixed
pattern of darts (a Poisson process on the plane weight x rank, derived from
the element's hash) is thrown; the darts that land below the element's weight
are kept, each falls on one of `coordinates` coordinates, and a coordinate keeps
its dart of earliest rank. Two documents agree in a coordinate with the chance
of their weighted Jaccard similarity. Ranks are only explored as far as needed:
to about (ln k + 2) darts a coordinate over the whole document, so the cost
depends little on k and falls with the weight.

Signatures are cut into bands; documents that share a band are candidates.
Every candidate link is verified by the exact similarity of shingle sets. No
step emits all pairs of a group of copies:

1. Equal texts are one class; a task signs a text once, however often it meets it.
2. A band's bucket is a star: members are compared with two representatives.
3. Where a bucket still holds several components, its remaining members are
   compared tile by tile inside tasks, and only true links leave a task. Members
   are dealt by total weight first: those whose weights differ by more than the
   threshold allows can't be similar and never meet.

Classes are the connected components of the links.

Weights are 1 a shingle (`set`, the default: similarity of shingle sets) or its
number of occurrences (`count`: weighted similarity of shingle bags). Signatures
and the exact check use the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, words, written

SHINGLE = 5
THRESHOLD = 0.8
ROWS = 5
BANDS = 24
#: Widths of the first and of the widest rank interval; a dart count is drawn per cell.
FIRST = 0.125
MOST = 8.0
#: Documents whose signatures are computed together.
TOGETHER = 64
TILE = 256
#: Signed texts that a Python worker remembers.
REMEMBER = 20_000
WEIGHTS = ("set", "count")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


_FACTORIALS = np.cumprod(np.concatenate([[1.0], np.arange(1, 40)]))


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts by inverting its distribution; mean is at most MOST."""
    table_ = np.cumsum(np.exp(-mean) * mean ** np.arange(40) / _FACTORIALS)
    return np.searchsorted(table_, u, side="right")


def word_shingles(word_hashes: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of runs of n words, and how often each occurs; fewer words are one run."""
    w = word_hashes.view(np.uint64) if word_hashes.dtype == np.int64 else word_hashes
    if not len(w):
        return np.empty(0, np.uint64), np.empty(0)
    n = min(n, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h = _mix(h * _U(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    found, counts = np.unique(h, return_counts=True)
    return found, counts.astype(np.float64)


def weighted(word_hashes: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles and their weights."""
    found, counts = word_shingles(word_hashes)
    return found, counts if weights == "count" else np.ones(len(found))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_docs: int, coordinates: int) -> np.ndarray:
    """The earliest dart (a 64-bit id) per document and coordinate.

    elements are hashes, distinct within their owner, a document's number. The
    dart plane of an element is cut into cells: weight layers [j, j+1) by rank
    intervals [0, FIRST), [FIRST, 2 FIRST), ... that double up to MOST. A cell's
    count and its darts' places come from a hash of (element, layer, interval),
    hence agree between documents. All documents are worked on together;
    those that are explored far enough drop out.
    """
    out = np.zeros(n_docs * coordinates, np.uint64)
    best = np.full(n_docs * coordinates, np.inf)
    total = np.bincount(owner, weights, n_docs)
    goal = (np.log(coordinates) + 2) * coordinates / np.maximum(total, 1e-300)
    layers = np.ceil(weights).astype(np.int64)
    layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
    height = np.minimum(np.repeat(weights, layers) - layer, 1.0)
    owner = np.repeat(owner, layers)
    with np.errstate(over="ignore"):
        base = _mix(np.repeat(elements, layers) * _U(0x9E3779B97F4A7C15) + layer.astype(np.uint64))
        low, cell = 0.0, 0
        while True:
            active = (total > 0) & ((low < goal) | np.isinf(best.reshape(n_docs, coordinates)).any(axis=1))
            if not active.any():
                return out.reshape(n_docs, coordinates)
            mine = active[owner]
            if not mine.all():
                base, owner, height = base[mine], owner[mine], height[mine]
            width = FIRST if cell == 0 else min(low, MOST)
            seed = _mix(base + _U(cell) * _U(0xD1342543DE82EF95))
            count = _poisson(_unit(seed), width)
            some = np.flatnonzero(count)
            who = np.repeat(some, count[some])
            nth = np.arange(len(who)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            dart = _mix(seed[who] ^ _mix((nth + 1).astype(np.uint64)))
            inside = _unit(_mix(dart + _U(1))) < height[who]
            dart, who = dart[inside], who[inside]
            rank = low + width * _unit(_mix(dart + _U(2)))
            place = owner[who] * coordinates + (_mix(dart + _U(3)) % _U(coordinates)).astype(np.int64)
            new = rank < best[place]
            rank, place, dart = rank[new], place[new], dart[new]
            order = np.argsort(-rank, kind="stable")  # the earliest is written last
            best[place[order]] = rank[order]
            out[place[order]] = dart[order]
            low, cell = low + width, cell + 1


def dart_signature(elements: np.ndarray, weights: np.ndarray, coordinates: int) -> np.ndarray:
    """The signature of one weighted set."""
    return dart_signatures(elements, weights, np.zeros(len(elements), np.int64), 1, coordinates)[0]


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.arange(1, bands + 1, dtype=np.uint64)
        for column in signature[: bands * rows].reshape(bands, rows).T:
            h = _mix(h * _U(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(x))


def _lists(column: pa.ChunkedArray | pa.Array) -> Iterator[np.ndarray]:
    ends, values = np.asarray(column.offsets), np.asarray(column.values)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield values[a:b]


def banded(texts: DataFrame, *, bands: int = BANDS, rows: int = ROWS, weights: str = "set") -> DataFrame:
    """(key, id, total, bands) from (key, id, w), w the hashes of a text's words.

    total is the sum of the weights; texts without words get no bands. key
    identifies the text.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, np.ndarray]] = {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if len(known) > REMEMBER:
                known.clear()
            fresh = dict.fromkeys(k for k in keys if k not in known)
            words_ = {k: w for k, w in zip(keys, _lists(batch.column(2)), strict=True) if k in fresh}
            todo = list(words_)
            for at in range(0, len(todo), TOGETHER):
                names = todo[at : at + TOGETHER]
                some = [weighted(words_[k], weights) for k in names]
                elements, sizes = np.concatenate([e for e, _ in some]), np.concatenate([w for _, w in some])
                owner = np.repeat(np.arange(len(some)), [len(e) for e, _ in some])
                signed = dart_signatures(elements, sizes, owner, len(some), bands * rows)
                for k, sig, (e, w) in zip(names, signed, some, strict=True):
                    known[k] = (float(w.sum()), band_hashes(sig, bands, rows) if len(e) else np.empty(0, np.int64))
            found = [known[k] for k in keys]
            ends = np.cumsum([0, *(len(x) for _, x in found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *(x for _, x in found)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.float64()), lists], names=["key", "id", "total", "bands"])

    return texts.select("key", "id", "w").mapInArrow(sign, f"key string, id {kind}, total double, bands array<bigint>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted weighted sets."""
    (x, wx), (y, wy) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(x):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x
    both = float(np.minimum(wx[same], wy[at[same]]).sum())
    return both / (wx.sum() + wy.sum() - both)


def star_links(members: DataFrame, sets: DataFrame, threshold: float, weights: str = "set") -> DataFrame:
    """True links (a, b, like) between each bucket's members and its two representatives; like is their similarity.

    members has (bucket, id); sets (id, w). The representatives are those of
    least and of greatest scrambled id; a row per member and representative.
    """
    rep = members.groupBy("bucket").agg(F.min_by("id", F.xxhash64("id")).alias("r1"), F.max_by("id", F.xxhash64("id")).alias("r2"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = members.join(rep, "bucket").select("id", F.explode(F.array("r1", "r2")).alias("r")).where("id <> r")
    pairs = pairs.select(F.least("id", "r").alias("a"), F.greatest("id", "r").alias("b")).distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("w").alias("wa")), sets.select(F.col("id").alias("b"), F.col("w").alias("wb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = np.array([similarity(weighted(x, weights), weighted(y, weights)) for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True)], np.float64)
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like)], names=["a", "b", "like"])
            yield found.filter(pa.array(like >= threshold - 1e-9))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(verify, "a long, b long, like double")


def tile_links(members: DataFrame, sets: DataFrame, threshold: float, weights: str = "set") -> DataFrame:
    """Components (a, b) that a true link between members of one bucket joins, and such a link: (x, y, like).

    members has (bucket, id, comp, total). Only buckets that the stars left in
    several parts come here. Their members are dealt into classes of total
    weight, each 1/threshold times the one before, so that a similar pair is of
    one class or of neighbours, and classes into blocks of about TILE members.
    A pair of blocks is a task's group of its own, so that memory stays bounded.
    """
    wide = -math.log(threshold)
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("comp").alias("n_comp")).where("n_comp > 1 and n > 2").select("bucket")
    open_ = members.join(sizes, "bucket").withColumn("cls", F.floor(F.log("total") / F.lit(wide)).cast("int"))
    per = open_.groupBy("bucket", "cls").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    down = per.select("bucket", (F.col("cls") + 1).alias("cls"), F.col("blocks").alias("below"))
    up = per.select("bucket", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("above"))
    plan = per.join(down, ["bucket", "cls"], "left").join(up, ["bucket", "cls"], "left")
    dealt = open_.join(plan, ["bucket", "cls"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = F.struct(F.col("cls").alias("c"), F.col("block").alias("b"))
    blocks = lambda n, step: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.struct((F.col("cls") + step).alias("c"), k.alias("b")))).otherwise(F.array().cast("array<struct<c:int,b:int>>"))
    tiled = dealt.withColumn("other", F.explode(F.concat(blocks("below", -1), blocks("blocks", 0), blocks("above", 1))))
    tiled = tiled.select("bucket", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), own.alias("at"), "id", "comp").join(sets, "id")
    tiled = tiled.select("bucket", "i", "j", (F.col("at") == F.col("i")).alias("first"), "id", "comp", "w")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [weighted(np.asarray(w), weights) for w in pdf["w"]]
        ids, comps, first = pdf["id"].to_numpy(), pdf["comp"].to_numpy(), pdf["first"].to_numpy()
        totals = np.array([w.sum() for _, w in pairs])
        lengths = np.array([len(e) for e, _ in pairs])
        weight = np.concatenate([w for _, w in pairs])
        _, code = np.unique(np.concatenate([e for e, _ in pairs]), return_inverse=True)
        owner = np.repeat(np.arange(len(pairs)), lengths)
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(code.max() + 2))
        owners, weights_, ends = owner[order], weight[order], np.cumsum(lengths)
        one_block = bool(first.all())
        found = []
        for x in range(len(pairs)):
            if not one_block and not first[x]:
                continue
            mine = slice(ends[x] - lengths[x], ends[x])
            spans = [slice(starts[c], starts[c + 1]) for c in code[mine]]
            met = np.concatenate([owners[s] for s in spans])
            least = np.concatenate([np.minimum(weights_[s], w) for s, w in zip(spans, weight[mine], strict=True)])
            both = np.bincount(met, least, minlength=len(pairs))
            hit = (both >= (threshold - 1e-9) * (totals[x] + totals - both)) & (comps != comps[x])
            hit &= ids > ids[x] if one_block else ~first
            others, first_hit = np.unique(comps[hit], return_index=True)
            for other, y in zip(others, np.flatnonzero(hit)[first_hit], strict=True):
                found.append((comps[x], other, ids[x], ids[y], both[y] / (totals[x] + totals[y] - both[y])))
        kinds = {"a": "int64", "b": "int64", "x": "int64", "y": "int64", "like": "float64"}
        return pd.DataFrame(found, columns=list(kinds)).astype(kinds)

    return tiled.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long, x long, y long, like double").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every linked id; comp is the least id of its component.

    Rounds of large-star and small-star; each round is a written table, and a
    round that changes nothing ends them.
    """
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select("a", "b", "m")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small)
        now = mark(edges)
        if now == before:
            break
        before = now
    star = edges.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("id"), "comp")
    return star.unionByName(star.select(F.col("comp").alias("id"), "comp").distinct())


def near_duplicate_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weights: str = "set", linked: bool = False) -> DataFrame:
    """(doc, key, comp, class_id) of every row: class_id is the least id of its class.

    With `linked` also n_texts, the different texts of the class; n_links, the
    different texts of it that the row's text was compared with and found
    similar; linked_to, the least id of the most similar of them, and like, that
    similarity. These links hold the class together. Equal texts aren't links;
    a row whose text has no link has 0 and nulls.

    key is the text's SHA-256, comp identifies the class (ids may repeat, and
    be of any type that has an order). Null counts as empty; texts without
    words are linked to equal texts only; very long texts are read whole. A
    null id stands after all others, and a class of null ids alone has a null
    class_id; repeated rows stay. Ties of the least id can't occur, as equal
    ids are one id. Empty tables give no rows; other columns are not looked at.
    """
    if weights not in WEIGHTS:
        raise ValueError(f"weights must be one of {WEIGHTS}")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc"), F.sha2(body, 256).alias("key"), body.alias("body"))
    worded = keyed.select("key", "doc", _word_hashes(F.col("body")).alias("w"))
    signed = banded(worded.select("key", F.col("doc").alias("id"), "w"), bands=bands, rows=rows, weights=weights)
    groups = signed.groupBy("key").agg(F.min("id").alias("least"), F.first("total").alias("total"), F.first("bands").alias("bands"))
    # Numbers of a written table: unique, and the same whenever it is read.
    groups = written(groups.select("key", "least", F.monotonically_increasing_id().alias("id"), "total", "bands"))

    members = groups.select("id", "total", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = written(members.join(shared, "bucket").select("bucket", "id", "total"))
    wanted = members.select("id").distinct()
    first = keyed.join(groups.select("id", F.col("key").alias("k"), F.col("least").alias("l")).join(wanted, "id"), (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("l")))
    # Repeated rows of one text and id are one set.
    sets = written(first.dropDuplicates(["id"]).select("id", _word_hashes(F.col("body")).alias("w")))

    links = written(star_links(members.select("bucket", "id"), sets, threshold, weights))
    comps = written(components(links))
    marked = members.join(comps, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"), "total")
    # Only components that a tile joins take part in the second search.
    tiles = written(tile_links(marked, sets, threshold, weights))
    wider = components(tiles).select(F.col("id").alias("part"), F.col("comp").alias("whole"))
    parts = groups.select("key", "least", "id").join(comps, "id", "left").select("key", "least", F.coalesce("comp", "id").alias("part"))
    classed = written(parts.join(wider, "part", "left").select("key", "least", F.coalesce("whole", "part").alias("comp")))
    classes = classed.groupBy("comp").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    found = classed.join(classes, "comp").select("key", "comp", "class_id", *(["n_texts"] if linked else []))
    if linked:
        held = links.select(F.col("a").alias("x"), F.col("b").alias("y"), "like").unionByName(tiles.select("x", "y", "like"))
        both = held.unionByName(held.select(F.col("y").alias("x"), F.col("x").alias("y"), "like")).distinct()
        # A representative may have very many links, so they are counted before anything is joined.
        best = both.groupBy("x").agg(F.count(F.lit(1)).alias("n_links"), F.max_by(F.struct("y", "like"), F.struct("like", -F.col("y"))).alias("best"))
        names = groups.select(F.col("id").alias("x"), "key")
        partner = groups.select(F.col("id").alias("y"), F.col("least").alias("linked_to"))
        per = best.select("x", "n_links", "best.y", "best.like").join(partner, "y").join(names, "x").select("key", "n_links", "linked_to", "like")
        found = found.join(per, "key", "left").fillna(0, ["n_links"])
    return keyed.select("doc", "key").join(found, "key")


def keep_one_per_class(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each class: that of the least id (null is the last), of equal ids any one.

    Columns are unchanged.
    """
    classes = near_duplicate_classes(docs, doc_id=doc_id, text=text, **how)
    head = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "key")).alias("head")
    heads = written(classes.groupBy("comp").agg(head).select(F.col("head.doc").alias("_mr_id"), F.col("head.key").alias("_mr_key")))
    key = F.sha2(F.coalesce(docs[text], F.lit("")), 256)
    kept = docs.withColumn("_mr_k", key).join(heads, docs[doc_id].eqNullSafe(F.col("_mr_id")) & (F.col("_mr_k") == F.col("_mr_key")), "left_semi")
    return kept.dropDuplicates([doc_id, "_mr_k"]).drop("_mr_k")


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, of every document, with the links of its text."""
    found = near_duplicate_classes(table(spark, sf_dir, "documents"), linked=True)
    return found.select(F.col("doc").alias("doc_id"), "class_id", "n_texts", "n_links", "linked_to", F.col("like").alias("similarity"))
