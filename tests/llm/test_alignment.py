"""op11_alignment against a plain version, and odd input."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from millrace.llm import alignment
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    one = tokenizers.Tokenizer.from_file(PATHS[0])
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(texts, coders):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of the texts, by loops over tokens."""
    one, two = coders
    letters = alignment.byte_letters()
    sides, counts = [], Counter()
    for text in texts:
        want = b" " + (text or "").encode()
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in two.encode(text or ""):
            piece = two.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a = b = []
        ends = []
        for side in (a, b):
            at, found = 0, {}
            for i, x in side:
                at += len(x)
                found[at] = i
            ends.append(found)
        shared = [e for e in ends[0] if e in ends[1]]
        counts.update((ends[0][e], ends[1][e]) for e in shared)
        sides.append((ends, shared))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    rows = []
    for (a, b), shared in sides:
        pairs = [(a[e], b[e]) for e in shared]
        cut = [defaultdict(list), defaultdict(list)]
        for side, into in zip((a, b), cut, strict=True):
            for at, i in side.items():
                into[bisect_left(shared, at)].append(str(i))
        groups = [f"{','.join(cut[0][g])}|{','.join(cut[1][g])}" for g in range(len(shared))]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((len(a), len(b), len(groups), len(pairs), sum(counts[p] == top[p[1]] for p in pairs), sum(counts[p] for p in pairs), sha))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query(spark, coders):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = Counter((d["doc_id"], *r) for d, r in zip(docs, plain([d["text"] for d in docs], coders), strict=True))
    df = QUERIES["op11_alignment"](spark, SF)
    assert df.columns[0] == "doc_id" and [k for _, k in df.dtypes] == ["bigint"] * 7 + ["string"]
    assert Counter(tuple(r) for r in df.select("doc_id", *COLUMNS).collect()) == want


ODD = [None, "", "", "a", "a  b", "a▁b", "\ttab\x00\x01", "<|endoftext|> <s> <0x41> <unk>", "ﬁné é", "日本語 🙂🙂", "x" * 30_000, "same words", "same words", "one two three " * 40_000, " lead and trail  ", "\r\n\n"]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 3])
def test_odd_texts(spark, coders, tmp_path, heavy):
    big = 2**60
    rows = [(None if i % 5 == 4 else big + i // 2, t, "x", i, [7]) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, a int, links array<int>").coalesce(2)
    found = alignment.align(docs, *PATHS)
    found.withColumn("row", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    per = {r.row: r for r in alignment.rated(kept, "row", heavy=heavy).collect()}
    got = Counter()
    for r in kept.collect():
        p = per.get(r.row)
        sha = hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else ""
        got[(r.doc, r.n_a, r.n_b, r.n_groups, p.n_links if p else 0, p.n_best if p else 0, p.count_sum if p else 0, sha)] += 1
    assert got == Counter((d, *r) for (d, *_), r in zip(rows, plain(ODD, coders), strict=True))


def test_rounds_are_of_no_account(spark, coders, monkeypatch):
    import pyarrow as pa

    pair = alignment._pair(*PATHS)
    texts = [t or "" for t in ODD]
    whole = alignment._align(pair, pa.array(texts))
    single = [alignment._align(pair, pa.array([t])) for t in texts]
    assert [c.to_pylist() for c in whole] == [[x for s in single for x in s[i].to_pylist()] for i in range(len(whole))]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    found = alignment.align(none, *PATHS)
    assert found.count() == 0 and alignment.rated(found.withColumn("row", F.lit(1)), "row").count() == 0


def test_shared_words_are_encoded_once_and_alike(monkeypatch):
    pair = alignment._Pair(public_tokenizers.path(alignment.VOCABULARY_A), public_tokenizers.path(alignment.VOCABULARY_B))
    texts = ["", " ", "a", " a  b ", "it's a 's 't x", "a\u00a0b c\u2028 d", "\u2581 \u2581a b\u2581 c", "x\x1c y \x85 z", "<|endoftext|> <s> </s> <0x41> <unk>", "e\u0301 e \u0301 \u00b2 3 \u0663 \U0001f600 \u4e16 \u754c", "a\t b\n c \n\n d  \n e", "\u200b \u3000 \u00df \x00 0 \ufeff q", "the cat and the dog and the " * 50]
    a, b = pair.tokens(texts)
    assert a.to_pylist() == [pair.one.encode(f" {t}", add_special_tokens=False).ids for t in texts]
    assert b.to_pylist() == pair.two.encode(texts, num_threads=1)
    two, met = pair.two, []

    class Noted:
        def encode(self, words, **how):
            met.extend(words)
            return two.encode(words, **how)

    pair.two = Noted()
    pair.tokens(texts[-1:])
    assert sum(map(len, met)) < 50
