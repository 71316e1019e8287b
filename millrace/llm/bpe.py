"""Byte-level BPE encoding and decoding by DuckDB recursive queries.

Spark splits texts into pieces and deals the work out; inside a partition, rows
(word, position, token) of the batch's distinct pieces join the merge table.
One step of a recursive query contracts each word's leftmost pair of minimum
rank, until no word has a pair to merge. A long word is cut beforehand where
no token of the vocabulary lies over two neighbouring bytes: no merge can join
them, so the parts contract alone. Decoding joins ids with the vocabulary
and puts the pieces together by an aggregation in order of position.

Ids are stored as little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Unicode's White_Space, which the pattern's \s stands for; Java's own \s is ASCII only.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces of a chunk, and bytes of words kept encoded in a Python worker; both only bound memory.
CHUNK = 400_000
CACHE_BYTES = 64_000_000
#: What a kept word takes beside its letters and ids, in bytes, about.
ENTRY_BYTES = 150
#: Words of more bytes are searched for cuts; shorter ones take few steps as they are.
CUT_FROM = 64
#: Bytes of words that one statement encodes, and tokens that one statement decodes.
WORD_BYTES = 2_000_000
DECODED = 400_000
NO_TOKEN = 65_535

#: A word's rows are numbered word * span + position; span is larger than the longest word.
MERGE_SQL = """
with recursive seq(k, id, nxt, live) as (
  select k, id, nxt, true from start
  union all
  (with best as (
     select k // {span} as word, min(rank * {span} + k % {span}) as code
     from seq join merges on pair = id * 65536 + nxt where live group by 1),
   spot as (
     select b.word, b.code // {span} as rank, b.code % {span} as pos, s.nxt
     from best b join seq s on s.k = b.word * {span}::bigint + b.code % {span} + 1)
   select s.k - case when s.k % {span} > p.pos then 1 else 0 end,
     case when s.k % {span} = p.pos then p.rank else s.id end,
     case s.k % {span} when p.pos then p.nxt when p.pos - 1 then p.rank else s.nxt end,
     p.pos is not null
   from seq s left join spot p on p.word = s.k // {span}
   where s.live and (p.pos is null or s.k % {span} <> p.pos + 1)))
select (k // {span})::int as word, id::int as id from seq where not live order by k
"""

DECODE_SQL = """
select doc, string_agg(piece, '' order by pos) as body
from ids join vocabulary using (id)
group by doc
"""


def java_pattern() -> str:
    """public_tokenizers.PATTERN for Java's regular expressions."""
    p = public_tokenizers.PATTERN
    return p.replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"[^\s", f"[^{WHITE}").replace(r"\s+", f"[{WHITE}]+")


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern()), F.lit(0))


class _Coder:
    """A worker's DuckDB session with the vocabulary's tables, and its cache of encoded words."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        merges = [(left * 65_536 + right, rank) for token, rank in self.ranks.items() for cut in range(1, len(token)) if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None]
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens = ahocorasick.Automaton()
        for token in self.ranks:
            if len(token) > 1:
                self.tokens.add_word(token.decode("latin-1"), len(token))
        self.tokens.make_automaton()
        self.cache: dict[str, bytes] = {}
        self.held = 0
        # No spill folder: statements are small enough for memory, and none is left on a worker's disk.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = np.array(merges, np.int64)
        self._put("merges", {"pair": pairs[:, 0], "rank": pairs[:, 1]})
        # Bytes stand as the first 256 code points: DuckDB strings are text, a token may be half a character.
        self._put("vocabulary", {"id": np.array(list(self.ranks.values()), np.int32), "piece": [t.decode("latin-1") for t in self.ranks]})

    def _put(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache lacks."""
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        cut: dict[str, list[bytes]] = {}
        for word in words:
            if word not in self.cache:
                data = word.encode()
                if (whole := self.ranks.get(data)) is not None:
                    self._keep(word, np.int32(whole).tobytes())
                else:
                    cut[word] = self._parts(data)
        merged = self._merged(dict.fromkeys(chain.from_iterable(cut.values())))
        for word, parts in cut.items():
            self._keep(word, b"".join(merged[p] for p in parts))

    def _keep(self, word: str, ids: bytes) -> None:
        self.cache[word] = ids
        self.held += len(word) + len(ids) + ENTRY_BYTES

    def _parts(self, data: bytes) -> list[bytes]:
        """The bytes, cut at every place that no token found there lies over; in linear time."""
        if len(data) <= CUT_FROM:
            return [data]
        hits = np.array(list(self.tokens.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
        open_tokens = np.zeros(len(data) + 1, np.int64)
        np.add.at(open_tokens, hits[:, 0] - hits[:, 1] + 2, 1)
        np.add.at(open_tokens, hits[:, 0] + 1, -1)
        edges = [*np.flatnonzero(np.cumsum(open_tokens[:-1]) == 0).tolist(), len(data)]
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _merged(self, parts: dict[bytes, None]) -> dict[bytes, bytes]:
        """The ids of each part, WORD_BYTES (or one longer part) a statement."""
        out: dict[bytes, bytes] = {}
        some: list[bytes] = []
        size = 0
        for part in parts:
            if some and size + len(part) > WORD_BYTES:
                out |= self._merge(some)
                some, size = [], 0
            some.append(part)
            size += len(part)
        return out | self._merge(some) if some else out

    def _merge(self, raw: list[bytes]) -> dict[bytes, bytes]:
        lengths = np.array([len(x) for x in raw], np.int64)
        span = 1 << int(lengths.max()).bit_length()
        ids = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw), dtype=np.int64), lengths)
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        nxt = np.append(ids[1:], NO_TOKEN)
        nxt[np.cumsum(lengths) - 1] = NO_TOKEN
        self._put("start", {"k": word * span + pos, "id": ids, "nxt": nxt})
        out = self.db.sql(MERGE_SQL.format(span=span)).to_arrow_table()
        word, ids = out["word"].to_numpy(), out["id"].to_numpy().astype("<i4")
        ends = np.searchsorted(word, np.arange(len(raw) + 1))
        return {part: ids[ends[i] : ends[i + 1]].tobytes() for i, part in enumerate(raw)}

    def encode(self, parts: pa.ListArray) -> list[bytes]:
        """The ids of each row's pieces."""
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(words)
        found = [self.cache[w] for w in words]
        tokens = np.frombuffer(b"".join(found), "<i4")
        lengths = np.array([len(x) // 4 for x in found], np.int64)
        starts, index = np.cumsum(lengths) - lengths, coded.indices.to_numpy()
        per_piece = lengths[index]
        ends = np.cumsum(per_piece)
        ids = tokens[np.repeat(starts[index] - ends + per_piece, per_piece) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[np.asarray(parts.offsets) - parts.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes of each row's ids; a long row is decoded in parts, one after the other."""
        parts = [(r, row[i : i + 4 * DECODED]) for r, row in enumerate(rows) for i in range(0, len(row), 4 * DECODED)]
        whole: list[list[bytes]] = [[] for _ in rows]
        at = 0
        while at < len(parts):
            upto, size = at, 0
            while upto < len(parts) and (upto == at or size + len(parts[upto][1]) <= 4 * DECODED):
                size, upto = size + len(parts[upto][1]), upto + 1
            for (r, _), body in zip(parts[at:upto], self._pieces([p for _, p in parts[at:upto]]), strict=True):
                whole[r].append(body)
            at = upto
        return [b"".join(x) for x in whole]

    def _pieces(self, rows: list[bytes]) -> list[bytes]:
        lengths = np.array([len(r) // 4 for r in rows], np.int64)
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
        pos = (np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        self._put("ids", {"doc": doc, "pos": pos, "id": np.frombuffer(b"".join(rows), "<i4")})
        out = self.db.sql(DECODE_SQL).to_arrow_table()
        whole = [b""] * len(rows)
        for d, body in zip(out["doc"].to_pylist(), out["body"].to_pylist(), strict=True):
            whole[d] = body.encode("latin-1")
        return whole


_coders: dict[str, _Coder] = {}


def _coder(path: str) -> _Coder:
    if path not in _coders:
        _coders[path] = _Coder(path)
    return _coders[path]


def _chunks(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK weight; a row is never cut."""
    step = np.cumsum(weights) // CHUNK
    edges = [0, *(np.flatnonzero(np.diff(step)) + 1), len(weights)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _encoding(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, pieces) to (doc, ids)."""
    for batch in batches:
        for part in _chunks(batch, np.diff(np.asarray(batch.column(1).offsets))):
            ids = pa.array(_coder(path).encode(part.column(1)), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc", "ids"])


def _decoding(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, ids) to (doc, ids, body)."""
    for batch in batches:
        for part in _chunks(batch, np.diff(np.asarray(batch.column(1).cast(pa.large_binary()).buffers()[1]).view(np.int64)[: len(batch) + 1]) // 4 if len(batch) else np.empty(0)):
            body = pa.array(_coder(path).decode(part.column(1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, body], names=["doc", "ids", "body"])


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, ids binary) of every row; null and empty texts have no ids.

    Repeated rows and null ids stay; other columns are not looked at; an empty
    table gives no rows. Texts of any length are encoded whole, in statements
    of bounded size; a part of n bytes, in which tokens overlap without a gap
    (one letter repeated n times, say), takes n steps.
    """
    cut = docs.select(F.col(doc_id).alias("doc"), pieces(F.col(text)).alias("pieces"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return cut.mapInArrow(lambda b: _encoding(path, b), f"doc {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc, ids, body binary) of rows as from encode()."""
    kind = encoded.schema["doc"].dataType.simpleString()
    return encoded.select("doc", "ids").mapInArrow(lambda b: _decoding(path, b), f"doc {kind}, ids binary, body binary")


def round_trip(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """decode(encode(docs)) in one Python worker a task instead of two."""
    cut = docs.select(F.col(doc_id).alias("doc"), pieces(F.col(text)).alias("pieces"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return cut.mapInArrow(lambda b: _decoding(path, _encoding(path, b)), f"doc {kind}, ids binary, body binary")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        F.col("doc").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("body", 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and digests of every document; null texts count as empty, repeated rows stay, an empty table gives no rows."""
    return digests(round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))
