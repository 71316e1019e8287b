"""Small and brute-force tests of the training-data operators."""

import gzip
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import bpe, decontaminate, line_dedup, mpeg, near_dups, pii, quality, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string"
ODD = [(1, None), (2, ""), (2, ""), (None, "alone here"), (3, "x"), (4, "a b c d e f g " * 300), (4, "a b c d e f g " * 300), (5, "é " * 50)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None if i == 3 else "s", 0, "clash") for i, t in ODD], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def items(spark):
    return spark.createDataFrame([(7, "q0 q1 q2 q3 q4 q5 q6 q7 q8 q9"), (8, None), (9, "")], "item_id long, text string")


def test_odd_rows_keep_their_count(spark, odd):
    assert sharding.assign_shards(odd, shards=3).count() == len(ODD)
    assert line_dedup.drop_boilerplate(odd).count() == len(ODD)
    assert near_dups.near_duplicate_classes(odd).count() == len(ODD)
    assert pii.find_personal_data(odd).count() == len(ODD)
    assert bpe.round_trip(odd, public_tokenizers.path(bpe.VOCABULARY)).count() == len(ODD)
    assert mpeg.media_columns(mpeg.store_texts(odd)).count() == len(ODD)
    assert decontaminate.drop_contaminated(odd, items(spark)).count() == len(ODD)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert quality.score(odd, quality.fit_on(odd, labels)).count() == len(ODD)
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == len(ODD)


def test_empty_tables(spark, empty):
    assert sharding.assign_shards(empty).count() == 0
    assert line_dedup.drop_boilerplate(empty).count() == 0
    assert near_dups.near_duplicate_classes(empty).count() == 0
    assert pii.find_personal_data(empty).count() == 0
    assert bpe.round_trip(empty, public_tokenizers.path(bpe.VOCABULARY)).count() == 0
    assert decontaminate.contained_items(empty, items(spark)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(empty, quality.fit_on(empty, labels)).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_decontamination_finds_an_item_in_a_long_text(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    docs = spark.createDataFrame([(1, f"{long} q0 q1 q2 q3 q4 q5 q6 q7 q8 q9 {long}"), (2, long), (3, "q0 q1 q2 q3 q4 x")], "doc_id long, text string")
    assert [(r.doc, r.item) for r in decontaminate.contained_items(docs, items(spark)).collect()] == [(1, 7)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items(spark)).collect()) == [2, 3]


def test_line_dedup_is_relative_to_the_host(spark):
    rows = [(i, f"menu\nown line {i}", "a") for i in range(20)] + [(100 + i, ("menu\n" if i == 0 else "") + f"other {i}", "b") for i in range(40)]
    out = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[3] == "own line 3" and out[100] == "menu\nother 0"


def test_dart_signatures_agree_as_weighted_jaccard():
    r = np.random.default_rng(3)
    e = r.integers(1, 2**63, 300).astype(np.uint64)
    w = r.uniform(0.2, 4, 300)
    v = w * r.uniform(0.5, 1.5, 300)
    same = (near_dups.dart_signature(e, w, 3000) == near_dups.dart_signature(e, v, 3000)).mean()
    assert abs(same - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    base = [[f"t{rng.randrange(5000)}" for _ in range(120)] for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(12):
            words = list(b)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) * 3, " ".join(words)))
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc: r.class_id for r in near_dups.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in parent}


def test_bpe_equals_tiktoken(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "it's  we'll\n\n end ", "añø 漢字 😀 ١٢٣ 1234567", "  x \x1c y\t", "zzzz" * 400, "<|endoftext|>", "a" * 3]
    got = {r.doc: (bytes(r.ids), bytes(r.body)) for r in bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (np.array(own.encode_ordinary(t), "<u4").tobytes(), t.encode())


def test_mpeg_round_trip_tags_and_damage():
    n, payload = mpeg.padded("läng " * 900)
    data = mpeg.carry(payload, {"bytes": str(n)})
    track = mpeg.parse(data)
    assert mpeg.carried(data, track) == payload and track.tags["bytes"] == str(n) and track.vbr == "Xing"
    assert track.vbr_frames == len(track.offsets) and track.samples == 1152 * len(track.offsets) and track.bad == 0
    junk = data[: track.offsets[3]] + b"\xff\xfa\x00junk" + data[track.offsets[3] :] + b"TAG" + b"title".ljust(125, b"\0")
    hurt = mpeg.parse(junk)
    assert len(hurt.offsets) == len(track.offsets) and hurt.skipped == 7 and hurt.tags["TIT2"] == "title"
    flipped = bytearray(data)
    flipped[track.offsets[2] + 8] ^= 1
    assert mpeg.parse(bytes(flipped)).bad == 1
    assert mpeg.parse(b"").offsets == []


def test_maximal_segments_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 25)
        hits = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
        gains = [rng.choice([1.0, 2.0, 3.0]) for _ in hits]
        values = [-1.0] * n
        for at, gain in zip(hits, gains):
            values[at] = gain

        def split(a, b):
            best = max(((sum(values[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            return [*split(a, best[2]), (best[2], best[3] - 1, best[0]), *split(best[3], b)]

        found = toxicity.maximal_segments(hits, gains, -1.0)
        assert max((s for *_, s in found), default=0) == max((s for *_, s in split(0, n)), default=0)
        assert sum(s for *_, s in found) == sum(s for *_, s in split(0, n))


def test_warc_archive_is_gzip_and_lookups_find_all_captures(spark):
    body = "<p>" + "same " * 60
    pages = spark.createDataFrame([(3, "http://a.example.com/x?q=1", body), (1, "http://A.example.com/x?q=1", body), (2, "http://b.example.org", "short"), (4, None, None), (5, "http://[bad", "short")], "page_id long, url string, html string")
    archive = warc.write_archive(warc.with_revisits(pages))
    parts = defaultdict(bytes)
    for r in archive.orderBy("archive", "segment").collect():
        parts[r.archive] += bytes(r.data)
    whole = b"".join(gzip.decompress(p) for p in parts.values())
    assert whole.count(b"WARC/1.1\r\n") == 5
    index = warc.build_index(archive)
    wanted = spark.createDataFrame([("com,example,a)/x?q=1", None), ("org,example,c)/", None)], "key string, id long")
    rows = warc.read_captures(archive, warc.find_captures(index, wanted)).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in rows) == [(1, "response", None), (3, "revisit", 1)]
    assert {r.payload_digest for r in rows} == {hashlib.sha256(body.encode()).hexdigest()}


def test_pii_against_plain_patterns(spark):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(2)
    texts = ["a@b.c_d@e.f x@y 1.2.3.4.5 0255.1.1.1 256.1.1.1", "+1 (555) 010-9999, 4111 1111 1111 1111 😀 me@x.org"]
    texts += ["".join(rng.choice("a.@1+- 25_é(") for _ in range(60)) for _ in range(300)]
    rows = {r.doc: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        for kind, pattern in plain.items():
            want = []
            for m in re.finditer(pattern, t):
                digits = re.sub("[^0-9]", "", m.group())
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "phone" and 10 <= len(digits) <= 15:
                    want.append((m.start(), m.end()))
            assert [(s.start, s.end) for s in rows[i].base if s.kind == kind] == want, (kind, t)
    assert rows[1].n_card == 1
    clean = pii.sanitised(pii.find_personal_data(spark.createDataFrame([(1, texts[1])], "doc_id long, text string"))).first().clean
    assert clean == "<PHONE>, <CARD> 😀 <EMAIL>"


def test_shards_balance_and_slots(spark):
    rng = random.Random(4)
    rows = [(i, "hot " * 50 if i % 3 == 0 else "".join(rng.choice("abc ") for _ in range(rng.randrange(400)))) for i in range(3000)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    size, slots = defaultdict(int), defaultdict(list)
    for r in out:
        size[r.shard] += len(r.text) + 8
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(7)) and max(size.values()) < 1.05 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_quality_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((quality.predict(model, x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
