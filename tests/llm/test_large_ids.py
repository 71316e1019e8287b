"""Ids beyond 2^53 beside null ids come back as they are, from every query that runs Python."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.llm import quality, toxicity, warc
from millrace.llm.queries import QUERIES

BIG = 2**60
IDS = [BIG + 1, None, BIG + 5, BIG + 7, None, 3]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables with large and null ids put in, in one file and so in one batch."""
    at = tmp_path_factory.mktemp("large")
    for name, column in (("documents", "doc_id"), ("pages", "page_id"), ("labels", None), ("embeddings", "vec_id"), ("benchmark", None)):
        rows = pq.read_table(f"{SF}/{name}.parquet")
        if column:
            ids = rows[column].to_pylist()
            rows = rows.set_column(rows.column_names.index(column), column, pa.array([*IDS, *ids[len(IDS) :]], rows.schema.field(column).type))
        pq.write_table(rows, at / f"{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name, column", [("op1_mpeg_media", "doc_id"), ("op3_quality", "doc_id"), ("op6_byte_bpe", "doc_id"), ("op7_warc", "page_id"), ("op9_toxicity", "doc_id"), ("op11_alignment", "doc_id"), ("op12_language", "doc_id"), ("op13_whitening", "vec_id")])
def test_queries(spark, folder, name, column):
    source = {"page_id": "pages", "vec_id": "embeddings"}.get(column, "documents")
    want = sorted(map(str, pq.read_table(f"{folder}/{source}.parquet")[column].to_pylist()))
    df = QUERIES[name](spark, folder)
    df = df.where("component = 1") if name == "op13_whitening" else df
    assert sorted(str(r[0]) for r in df.select(column).collect()) == want


def test_equal_large_pages(spark):
    rows = [(BIG + 3, "http://a.example/1", "x" * 500), (BIG + 1, "http://a.example/2", "x" * 500), (None, "http://a.example/3", "x" * 500), (BIG + 2, "http://b.example/", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archive = warc.write_archive(warc.with_revisits(pages))
    index = warc.build_index(archive)
    wanted = spark.createDataFrame([("example,a)/1", BIG + 3), ("example,a)/2", BIG + 1), ("example,a)/3", None), ("example,b)/", BIG + 2)], "key string, id long")
    got = warc.resolved(archive, index, warc.read_captures(archive, warc.find_captures(index, wanted))).collect()
    assert {(r.record_id, r.record_type, r.refers_to) for r in got} == {(BIG + 3, "revisit", BIG + 1), (BIG + 1, "response", None), (None, "revisit", BIG + 1), (BIG + 2, "response", None)}


def test_pages_with_ids_of_text(spark):
    ids = ["a b\tc", "é%", "", None, "<urn:page:>"]
    pages = spark.createDataFrame([(i, f"http://a.example/{n}", f"p{n % 2}" * 100) for n, i in enumerate(ids)], "page_id string, url string, html string")
    archive = warc.write_archive(warc.with_revisits(pages))
    index = warc.build_index(archive)
    wanted = spark.createDataFrame([(f"example,a)/{n}", i) for n, i in enumerate(ids)], "key string, id string")
    records = warc.read_captures(archive, warc.find_captures(index, wanted), id_type="string")
    got = warc.resolved(archive, index, records, id_type="string").collect()
    assert sorted(repr(r.record_id) for r in got) == sorted(map(repr, ids))
    # Of the even pages '' is least, of the odd ones 'é%', as a null id is never referred to.
    assert {(r.record_id, r.refers_to) for r in got} == {("a b\tc", ""), ("é%", None), ("", None), (None, "é%"), ("<urn:page:>", "")}


def test_operators_with_clashing_columns(spark):
    docs = spark.createDataFrame([(BIG + 1, "good words here", "x", 1.0, 5), (None, "more words", None, None, None), (BIG + 5, None, "y", 2.0, 6)], "doc_id long, text string, _mr_text string, score double, hits long").coalesce(1)
    labels = spark.createDataFrame([(BIG + 1, 1, 0), (BIG + 5, 0, 1)], "doc_id long, quality int, toxic int")
    for module, fitted in ((quality, quality.fit_on(docs, labels)), (toxicity, toxicity.fit(docs, labels))):
        assert sorted(str(r.doc) for r in module.score(docs, fitted).collect()) == sorted(map(str, (BIG + 1, None, BIG + 5)))
