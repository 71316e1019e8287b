"""Alignment of two tokenizers' tokens by byte offsets.

Spark deals the texts out; inside a task everything is Arrow. Token lists are
flattened with their parent indices, the bytes of each token are summed within
its document to the offset at which it ends, and an Acero hash join on
(document, end) finds the places where tokens of both sides end together. These
places cut the tokens into groups, and every such pair of tokens is a link.
Table.group_by counts the links of each document by id pair; Spark merges these
partial counts into the corpus-wide ones.

Looking the corpus-wide counts up again is a join on id pairs, of which a few
hold most links. Pairs with at least one link in `HEAVY` number HEAVY at most,
so they are broadcast; every other pair has too few links to burden a task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Bytes of text that one round of Arrow tables covers; a longer text is a round of its own.
CHUNK = 2 << 20
#: A pair is broadcast where it holds one link in so many at least.
HEAVY = 100_000
SPACE = "▁"
#: Single spaces between characters that are no spaces to either tokenizer: no token reaches over one from its left.
CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")

ALIGNED = "n_a long, n_b long, n_groups long, `groups` string, links array<struct<a:int,b:int,n:long>>"


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable Latin-1 stands for itself, all others for 256 and up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """The bytes of every id of a vocabulary, and their number."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pa.array(pieces, pa.binary())
        self.sizes = pc.binary_length(self.pieces).cast(pa.int64())
        self.names = pa.array([str(i) for i in range(len(pieces))], pa.string())


class _Pair:
    """A worker's two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.one = tokenizers.Tokenizer.from_file(path_a)
        self.one.encode_special_tokens = True  # their strings in a text are plain text
        letters, vocabulary = byte_letters(), self.one.get_vocab()
        raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            raw[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a = _Side(raw)
        self.two = sentencepiece.SentencePieceProcessor(model_file=path_b)
        ids = range(self.two.get_piece_size())
        self.cuts = not any(SPACE in self.two.id_to_piece(i).lstrip(SPACE) for i in ids)
        self.b = _Side([bytes([int(self.two.id_to_piece(i)[1:-1], 16)]) if self.two.is_byte(i) else self.two.id_to_piece(i).replace(SPACE, " ").encode() for i in ids])

    def tokens(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Both sides' ids of each text; words that the texts share are encoded once.

        Side A's pattern begins anew at each CUT, and side B's merges don't pass
        it, as its pieces have spaces in front only; so a text has its words' ids.
        """
        cut = [CUT.split(t) for t in texts] if self.cuts else [[t] for t in texts]
        words = pa.array([w for c in cut for w in c], pa.string()).dictionary_encode()
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])
        own, kind = words.dictionary.to_pylist(), pa.list_(pa.int32())
        one = [x.ids for x in self.one.encode_batch_fast([f" {w}" for w in own], add_special_tokens=False)]
        both = [pa.array(ids, kind).take(words.indices) for ids in (one, self.two.encode(own, num_threads=1))]
        return tuple(_lists(pc.list_flatten(ids), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])[ends[1:]]) for ids in both)


_pairs: dict[tuple[str, str], _Pair] = {}


def _pair(*paths: str) -> _Pair:
    if paths not in _pairs:
        _pairs[paths] = _Pair(*paths)
    return _pairs[paths]


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    """values cut into lists behind each of these ends."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _joined(side: _Side, tokens: pa.ListArray) -> pa.Array:
    """The bytes that each list of ids stands for."""
    return pc.binary_join(_lists(side.pieces.take(pc.list_flatten(tokens)), np.cumsum(pc.list_value_length(tokens).to_numpy())), b"")


def _ends(side: _Side, tokens: pa.ListArray, name: str) -> pa.Table:
    """A row per token: document, byte offset of its end, its number in the batch, its id."""
    ids, doc = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(side.sizes.take(ids))
    # Within a document: less what had been summed before its first token.
    sums = total.to_numpy()
    counts = pc.list_value_length(tokens).to_numpy()
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, sums[np.maximum(first - 1, 0)], 0) if len(sums) else np.zeros(len(counts), np.int64)
    end = pc.subtract(total, pa.array(before, pa.int64()).take(doc))
    return pa.table({"doc": doc, "end": end, f"at_{name}": pa.array(np.arange(len(ids)), pa.int64()), name: ids})


def _group_texts(side: _Side, tokens: pa.ListArray, cuts: np.ndarray) -> pa.Array:
    """The ids of each group, joined by commas."""
    return pc.binary_join(_lists(side.names.take(pc.list_flatten(tokens)), cuts + 1), ",")


def _align(pair: _Pair, texts: pa.Array) -> list[pa.Array]:
    """Columns of ALIGNED for texts (string, no nulls)."""
    words = texts.to_pylist()
    a, b = pair.tokens(words)
    wanted = pc.binary_join_element_wise(pa.scalar(b" "), texts.cast(pa.binary()), b"")
    fit = np.asarray(pc.and_(pc.equal(_joined(pair.a, a), wanted), pc.equal(_joined(pair.b, b), wanted))) & (pc.binary_length(texts).to_numpy() > 0)
    kept = pa.array(np.flatnonzero(fit))
    a, b = a.take(kept), b.take(kept)
    meet = _ends(pair.a, a, "a").join(_ends(pair.b, b, "b"), ["doc", "end"], join_type="inner", use_threads=False).sort_by("at_a")
    # Tokens aren't empty and the last ones end together: each place closes a group, and no group leaves its document.
    groups = pc.binary_join_element_wise(_group_texts(pair.a, a, meet["at_a"].to_numpy()), _group_texts(pair.b, b, meet["at_b"].to_numpy()), "|")
    n_groups = np.bincount(meet["doc"].to_numpy(), minlength=len(kept))
    texts_of = pc.binary_join(_lists(groups, np.cumsum(n_groups)), ";")
    counted = meet.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("a", "ascending"), ("b", "ascending")]).combine_chunks()
    links = pa.StructArray.from_arrays([_whole(counted[c], k) for c, k in (("a", pa.int32()), ("b", pa.int32()), ("count_all", pa.int64()))], ["a", "b", "n"])
    per_doc = np.cumsum(np.bincount(counted["doc"].to_numpy(), minlength=len(kept)))

    # Documents that don't fit have zeros, '' and no links.
    def spread(values: np.ndarray) -> pa.Array:
        out = np.zeros(len(words), np.int64)
        out[fit] = values
        return pa.array(out)

    place = pa.array(np.where(fit, np.cumsum(fit) - 1, 0), mask=~fit)
    return [spread(pc.list_value_length(a).to_numpy()), spread(pc.list_value_length(b).to_numpy()), spread(n_groups), pc.fill_null(texts_of.take(place), ""), _lists(links, np.cumsum(np.diff(per_doc, prepend=0)[place.fill_null(0).to_numpy()] * fit)) if len(kept) else pa.array([[]] * len(words), pa.list_(links.type))]


def _whole(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return column.cast(kind).combine_chunks() if column.num_chunks != 1 else column.chunk(0).cast(kind)


def _chunks(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes of text; a row is never cut."""
    step = np.cumsum(sizes) // CHUNK
    edges = [0, *(np.flatnonzero(np.diff(step)) + 1), len(sizes)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def align(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_a, n_b, n_groups, groups, links) of every row.

    groups is `a1,a2|b1;a3|b2,b3`, ids in order; links counts the document's
    links by id pair. Null and empty texts, and texts whose tokens don't give
    the bytes of a space and the text, have zeros, '' and no links. Repeated
    rows and null ids stay; other columns are not looked at; an empty table
    gives no rows. A task holds CHUNK bytes of text or the longest one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy() if len(batch) else np.empty(0)
            for part in _chunks(batch, sizes):
                out = _align(_pair(path_a, path_b), part.column(1).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), *out], names=["doc", "n_a", "n_b", "n_groups", "groups", "links"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body")).mapInArrow(run, f"doc {kind}, {ALIGNED}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n_all, best): links of each id pair in the corpus, and whether no pair of that b has more.

    The best pair of each b is a row per id of the second vocabulary at most,
    so it is broadcast.
    """
    counts = written(aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("l.n").alias("n_all")))
    top = counts.groupBy("b").agg(F.max("n_all").alias("top"))
    return counts.join(F.broadcast(top), "b").select("a", "b", "n_all", (F.col("n_all") == F.col("top")).alias("best"))


def rated(aligned: DataFrame, row: str, *, heavy: int = HEAVY) -> DataFrame:
    """(row, n_links, n_best, count_sum) of the rows with links; row is a unique column of aligned, whose rows must be the same on each reading."""
    counts = written(pair_counts(aligned))
    total = counts.agg(F.coalesce(F.sum("n_all"), F.lit(0)).alias("n")).first().n
    often = F.col("n_all") * heavy >= total
    links = aligned.select(F.col(row).alias("row"), F.explode("links").alias("l")).select("row", "l.a", "l.b", "l.n")
    sums = [F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_all")).alias("count_sum")]
    # At most `heavy` pairs pass.
    met = links.join(F.broadcast(counts.where(often)), ["a", "b"]).groupBy("row").agg(*sums)
    seldom = links.join(F.broadcast(counts.where(often).select("a", "b")), ["a", "b"], "left_anti")
    others = seldom.join(counts.where(~often), ["a", "b"]).groupBy("row").agg(*sums)
    return met.unionByName(others).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document; repeated rows stay, an empty table gives no rows."""
    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    # Rows get numbers as they are written, so that repeated ids stay apart.
    kept = written(found.select(F.monotonically_increasing_id().alias("row"), "doc", "n_a", "n_b", "n_groups", digest, "links"))
    per = rated(kept, "row")
    counted = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return kept.drop("links").join(per, "row", "left").select(F.col("doc").alias("doc_id"), "n_a", "n_b", "n_groups", *counted, "groups_sha256")
