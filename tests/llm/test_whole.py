"""Tests that operators leave out nothing of their job."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.llm import near_dups, pii


def test_one_per_class_with_null_and_repeated_ids(spark):
    texts = {i: " ".join(f"{name}{k}" for k in range(40)) for i, name in enumerate("abcdef")}
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[4]), (9, texts[4]), (8, texts[5] + " tail"), (None, texts[5]), (None, None)]
    kept = near_dups.keep_one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4]), (8, texts[5] + " tail"), (None, None)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_terms_disclose_over_whole_documents_and_go_everywhere(spark):
    filler = "one two three four five six seven eight nine ten"
    rows = [(i, f"{filler} plain{i}") for i in range(60)]
    rows += [(100 + i, f"Orlok {filler} mail a{i}@x.org {filler}") for i in range(8)]
    rows += [(200, f"Once {filler} call +1 555 010 9999"), (300, f"{filler} ORLOK and orlok again")]
    out = {r.doc: r for r in pii.sanitised(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    # Far from the entity, and in a document without one.
    assert out[103].clean == f" {filler} mail <EMAIL> {filler}".replace("mail", "")
    assert out[300].clean == f"{filler}  and  again" and [(s.start, s.end, s.kind) for s in out[300].spans] == [(49, 54, "term"), (59, 64, "term")]
    # Words of a single text, beside an entity kind in 1 of 70 documents: of so many words some must stand there by chance.
    assert out[200].clean == f"Once {filler} call <PHONE>"
    assert out[3].clean is None and not out[3].spans


def test_a_term_of_few_texts_needs_a_rare_entity(spark):
    rows = [(i, f"common w{i} a{i}@x.org" if i % 2 else "common") for i in range(40)] + [(99, "common w1 a1@x.org")] * 30
    assert not [s for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans if s.kind == "term"]


def test_discovery_cut_by_all_trials():
    sure, chance = pii.CELLS * 20, pii.CELLS * 3
    # e^-20 by 1000 trials is rare enough for one term; e^-3 isn't, unless hundreds of terms are as unlikely.
    assert pii.discovery_cut([(sure, 1), (chance, 5)], 1000, 0.05) == sure
    assert pii.discovery_cut([(sure, 1), (chance, 999)], 1000, 0.05) == chance
    assert pii.discovery_cut([(chance, 5)], 1000, 0.05) > pii.LAST_CELL == pii.discovery_cut([], 0, 0.05) - 1


def test_filler_stays(spark):
    """Random words beside entities are no terms, whatever the number of texts; a name beside them is one."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(5))
    rows = []
    for i in range(400):
        body = " ".join(word() for _ in range(30))
        rows.append((i, body + (f" a{i}@x.org Orlok" if i % 20 == 0 else "")))
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {s.match.lower() for r in found for s in r.spans if s.kind == "term"} == {"orlok"}


@pytest.mark.parametrize("listed", [0, 2000])
def test_listed_and_joined_terms_are_the_same(spark, monkeypatch, listed):
    monkeypatch.setattr(pii, "LISTED_TERMS", listed)
    rows = [(i, f"plain{i} words") for i in range(60)] + [(100 + i, f"Orlok mail a{i}@x.org orlok Zed") for i in range(12)] + [(300, "zed ORLOK")]
    got = {r.doc: [(s.start, s.match) for s in r.spans if s.kind == "term"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[300] == [(0, "zed"), (4, "orlok")] and got[103] == [(0, "orlok"), (6, "mail"), (20, "orlok"), (26, "zed")] and not got[3]


def test_many_matches_take_time_in_proportion(spark):
    took = []
    for n in (20_000, 100_000, 200_000):
        df = spark.createDataFrame([(1, "a@b.cc " * n)], "doc_id long, text string")
        began = time.time()
        assert pii.base_spans(df).select("n_email", F.element_at("base", -1)["end"].alias("last")).first() == (n, 7 * n - 1)
        took.append(time.time() - began)
    assert took[2] < 3 * took[1] + 1
