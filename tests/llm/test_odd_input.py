"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from millrace.llm import bpe, decontaminate, line_dedup, mpeg, near_dups, pii, quality, sharding, toxicity, warc

LONG = " ".join(f"w{i % 5000}x{i}" for i in range(150_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, key string, page string, line string, body string, shard int, hits long"
TEXTS = [(1, None), (2, ""), (2, ""), (None, "alone here"), (None, "alone here"), (3, " \n\t "), (4, "same words in a row here"), (5, "same words in a row here"), (6, LONG), (6, LONG), (7, "a@b.org 4111 1111 1111 1111 1.2.3.4 +1 555 010 9999 " * 300)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None if i == 3 else "s", 0, "d", "k", "p", "l", "b", 9, 9) for i, t in TEXTS], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


def items(spark, rows=((7, "same words in a row here"), (7, "same words in a row here"), (8, None), (9, ""), (None, "alone here"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def ids(df, column):
    return sorted(str(r[0]) for r in df.select(column).collect())


ALL = sorted(str(i) for i, _ in TEXTS)


def test_media(spark, odd, empty):
    assert ids(mpeg.media_columns(mpeg.store_texts(odd)), "doc") == ALL
    assert mpeg.media_columns(mpeg.store_texts(empty)).count() == 0
    sparse = mpeg.media_columns(mpeg.store_texts(odd.where("doc_id = 6")), seek_stride=100).first()
    assert len(sparse.seek_offsets) == -(-sparse.n_frames // 100)


def test_decontamination(spark, odd, empty):
    found = decontaminate.contained_items(odd, items(spark)).collect()
    assert sorted((str(r.doc), str(r.item)) for r in found) == [("4", "7"), ("5", "7"), ("None", "None")]
    assert ids(decontaminate.drop_contaminated(odd, items(spark)), "doc_id") == sorted(x for x in ALL if x not in ("4", "5", "None"))
    assert decontaminate.drop_contaminated(empty, items(spark)).count() == 0
    assert decontaminate.drop_contaminated(odd, items(spark)).columns == odd.columns


def test_decontamination_without_items(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(odd, none).count() == len(TEXTS)


def test_quality(spark, odd, empty, labels):
    model = quality.fit_on(odd, labels)
    rows = quality.score(odd, model)
    assert ids(rows, "doc") == ALL and rows.where("score between 0 and 1").count() == len(TEXTS)
    assert quality.score(empty, model).count() == 0
    assert quality.fit_on(odd, labels, max_sample=1) is not None


def test_line_dedup(spark, odd, empty):
    out = line_dedup.drop_boilerplate(odd, counted=True)
    assert ids(out, "doc_id") == ALL and set(odd.columns) < set(out.columns)
    assert line_dedup.drop_boilerplate(empty).count() == 0
    rows = [(i, f" menu \nown {i}\n\nmenu", "a") for i in range(10)] + [(90 + i, "menu", None) for i in range(10)] + [(50, "menu\nown", "b")]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # Ten copies of one page are one page; a host of one page has no boilerplate.
    assert got[3] == "own 3\n" and got[95] == "menu" and got[50] == "menu\nown"


def test_line_dedup_counts_copies_each_or_once(spark):
    rows = [(i, "menu\nown", "a") for i in range(5)] + [(10 + i, f"menu\nline {i}", "a") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df).collect()}
    each = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df, copies="each").collect()}
    assert once[0] == "own" and each[0] == "" and once[10] == each[10] == "line 0"
    with pytest.raises(ValueError):
        line_dedup.drop_boilerplate(df, copies="some")


def test_near_duplicates(spark, odd, empty):
    got = near_dups.near_duplicate_classes(odd).collect()
    assert sorted(str(r.doc) for r in got) == ALL
    by = {(str(r.doc)): r.class_id for r in got}
    assert by["4"] == by["5"] == 4 and by["1"] == by["2"] == 1 and by["None"] is None and by["6"] == 6
    assert near_dups.near_duplicate_classes(empty).count() == 0
    kept = near_dups.keep_one_per_class(odd)
    assert ids(kept, "doc_id") == ["1", "3", "4", "6", "7", "None"] and kept.columns == odd.columns


def test_near_duplicates_with_text_ids_and_bags(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [("a", " ".join(base)), ("b", " ".join([*base, "tail"])), ("c", " ".join(base * 3)), (None, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc: r.class_id for r in near_dups.near_duplicate_classes(df).collect()}["b"] == "a"
    sets = {r.doc: r.class_id for r in near_dups.near_duplicate_classes(df, weights="set").collect()}
    bags = {r.doc: r.class_id for r in near_dups.near_duplicate_classes(df, weights="count").collect()}
    # As a set, the text three times over is close to one of its own; as a bag it isn't.
    assert sets["c"] == "a" and bags["c"] == "c" and bags["b"] == "a"
    with pytest.raises(ValueError):
        near_dups.near_duplicate_classes(df, weights="idf")


def test_tiles_join_what_stars_leave_apart(spark):
    """A bucket of groups that are unlike each other: links inside each group are found whatever the representatives."""
    rng = random.Random(9)
    rows, group = [], {}
    for g in range(6):
        base = [f"g{g}t{i}" for i in range(60 + 30 * g)]
        for nth in range(5):
            words = list(base)
            if nth:
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "id long, text string")
    sets = df.select("id", near_dups._word_hashes(F.col("text")).alias("w"))
    members = df.select(F.lit(1).cast("long").alias("bucket"), "id", F.col("id").alias("comp"), F.size(F.split("text", " ")).cast("double").alias("total"))
    linked = near_dups.components(near_dups.tile_links(members, sets, 0.8)).collect()
    comp = {r.id: r.comp for r in linked}
    assert all((comp[a] == comp[b]) == (group[a] == group[b]) for a in comp for b in comp) and len(comp) == len(rows)


def test_bpe(spark, odd, empty):
    path = public_tokenizers.path(bpe.VOCABULARY)
    out = bpe.round_trip(odd, path)
    assert ids(out, "doc") == ALL and bpe.round_trip(empty, path).count() == 0
    assert {bytes(r.body) for r in out.where("doc = 6").collect()} == {LONG.encode()}


def test_bpe_statements_are_cut_without_a_trace(monkeypatch):
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    coder = bpe._Coder(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    text = "unheardof words " * 40 + "zq" * 900 + " " + LONG[:3000]
    monkeypatch.setattr(bpe, "WORD_BYTES", 300)
    monkeypatch.setattr(bpe, "DECODED", 70)
    import numpy as np
    import pyarrow as pa
    import regex

    parts = regex.findall(public_tokenizers.PATTERN, text)
    ids_ = coder.encode(pa.array([parts, []], pa.list_(pa.string())))
    assert ids_[0] == np.array(own.encode_ordinary(text), "<u4").tobytes() and ids_[1] == b""
    assert coder.decode([*ids_, ids_[0]]) == [text.encode(), b"", text.encode()]


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, size long")


def test_warc(spark):
    same = "<p>" + "same " * 60
    rows = [(5, "http://a.example/x", same), (5, "http://a.example/y", same), (2, "http://a.example/x", same), (2, "http://a.example/x", same), (None, "http://b.example", same), (9, None, None), (10, "http://[bad", ""), (11, "http://a.example/l", LONG), (12, " http://a.example/q?r=s t", "x" * 99), (13, "http://b.example/2", "x" * 99)]
    archive = warc.write_archive(warc.with_revisits(_pages(spark, [(*r, "d", 1) for r in rows])))
    index = warc.build_index(archive)
    lines = archive.select(F.explode(F.split("lines", "\n")).alias("line"))
    wanted = lines.select(F.substring_index("line", "\t", 1).alias("key"), F.expr("try_cast(split_part(line, '\t', 2) as bigint)").alias("id"))
    out = warc.resolved(archive, index, warc.read_captures(archive, warc.find_captures(index, wanted))).collect()
    got = sorted((str(r.record_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in out)
    n = len(same)
    assert got == sorted([("5", "revisit", "2", n), ("5", "revisit", "2", n), ("2", "response", "None", n), ("2", "response", "None", n), ("None", "revisit", "2", n), ("9", "response", "None", 0), ("10", "response", "None", 0), ("11", "response", "None", len(LONG)), ("12", "response", "None", 99), ("13", "response", "None", 99)])


def test_warc_without_pages(spark):
    archive = warc.write_archive(warc.with_revisits(_pages(spark, [])))
    index = warc.build_index(archive)
    wanted = spark.createDataFrame([("x)/", None)], "key string, id long")
    assert warc.resolved(archive, index, warc.read_captures(archive, warc.find_captures(index, wanted))).count() == 0


def test_a_damaged_archive_raises(spark):
    pages = _pages(spark, [(i, f"http://a.example/{i}", f"page {i} " * 40, "d", 1) for i in range(3)])
    base = warc.with_revisits(pages)
    wrong = base.withColumn("digest", F.when(F.col("page_id") == 1, F.lit("0" * 64)).otherwise(F.col("digest")))
    archive = warc.write_archive(wrong)
    index = warc.build_index(archive)
    records = warc.read_captures(archive, warc.find_captures(index, spark.createDataFrame([("example,a)/1", None)], "key string, id long")))
    with pytest.raises(Exception, match="payload is not what its record states"):
        warc.resolved(archive, index, records).collect()


def test_pii(spark, odd, empty):
    out = pii.sanitised(pii.find_personal_data(odd))
    assert ids(out, "doc") == ALL and pii.find_personal_data(empty).count() == 0
    many = out.where("doc = 7").first()
    assert (many.n_email, many.n_ip, many.n_phone) == (300, 300, 300) and many.clean.count("<EMAIL>") == 300


def test_pii_of_very_many_matches(spark):
    """Thousands of matches in one text: their places are exact and the text comes out whole."""
    text = " ".join(f"no {i} u{i}@x.org" for i in range(4000))
    row = pii.sanitised(pii.find_personal_data(spark.createDataFrame([(1, text)] + [(2 + i, "no mail") for i in range(9)], "doc_id long, text string"))).where("doc = 1").first()
    assert row.n_email == 4000 and all(text[s.start : s.end] == s.match for s in row.base[::97])
    assert "@" not in row.clean and row.clean.count("<EMAIL>") == 4000


def test_terms_far_from_the_entity_count_as_near_ones(spark):
    """Blanks between a term and an entity, however many, change nothing."""
    plain = [(100 + i, f"other text {i}") for i in range(60)]
    for gap in (1, 130, 5000):
        rows = [(i, f"codename zebra{' ' * (gap if i % 2 else 1)}a{i}@x.org") for i in range(20)]
        got = pii.find_personal_data(spark.createDataFrame(rows + plain, "doc_id long, text string")).where("doc < 100").collect()
        assert all({"codename", "zebra"} <= {s.match for s in r.spans if s.kind == "term"} for r in got)


def test_toxicity(spark, odd, empty, labels):
    model = toxicity.fit(odd, labels)
    assert ids(toxicity.score(odd, model), "doc") == ALL and toxicity.score(empty, model).count() == 0
    assert toxicity.drop_toxic(empty, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(odd, none).count() == len(TEXTS)


def test_the_scan_is_linear():
    """Links followed don't outnumber the hits, in the worst orders too."""
    rng = random.Random(3)
    for gains in ([1.0] * 5000, [rng.choice([0.5, 1.0, 4.0]) for _ in range(5000)], [1 + i / 5000 for i in range(5000)], [2 - i / 5000 for i in range(5000)]):
        for gap in (1, 2, 5, 9):
            steps = []
            toxicity.maximal_segments(list(range(0, gap * len(gains), gap)), gains, -0.3, steps)
            assert steps[0] <= 2 * len(gains)


def test_sharding(spark, odd, empty):
    out = sharding.assign_shards(odd, shards=4)
    assert ids(out, "doc_id") == ALL and sharding.assign_shards(empty).count() == 0
    assert sorted(c for c in out.columns if c in ("shard", "slot")) == ["shard", "slot"]
    hot = spark.createDataFrame([(i % 3000, "hot", i % 7) for i in range(6000)], "doc_id long, text string, extra int")
    first, again = (sorted(map(tuple, sharding.assign_shards(df, shards=5).collect())) for df in (hot, hot.orderBy(F.desc("extra"))))
    assert first == again and {r[3] for r in first} == set(range(5))


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, odd, empty, labels):
    kept = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, df in (("odd", odd), ("empty", empty)):
        path = str(tmp_path / name)
        df.select(*kept).write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        items(spark).write.parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path)
        assert ids(out, "doc_id") == (["1", "3", "6", "7"] if name == "odd" else [])
        docs = df.select(*kept)
        for stage, run in corpus_pipeline.STAGES[:-1]:
            assert run(spark, docs, path).columns == kept, stage
