"""Rows that repeat an id, rows without one, and columns named like the operators' own."""

import hashlib

from pyspark.sql import functions as F

from echosieve.llm.common import keep_ids, one_row_per_id
from echosieve.llm.decontaminate import contaminated
from echosieve.llm.embeddings import linked_vectors
from echosieve.llm.minhash import near_duplicates
from echosieve.llm.suffix import repeated_spans
from echosieve.llm.warc import archive_pages

TEXT = " ".join(f"word{k}" for k in range(30))


def docs(spark):
    rows = [(1, TEXT), (2, TEXT), (2, TEXT), (2, "zz other"), (3, None), (3, "a b"), (None, TEXT), (4, "")]
    return spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "doc_id long, text string, n int, digest string, id binary")


def test_one_row_per_id(spark):
    got = one_row_per_id(docs(spark).select(F.col("doc_id").alias("id"), "text"))
    assert sorted((r["id"], r["text"]) for r in got.collect() if r["id"] != 3) == [(1, TEXT), (2, TEXT), (4, "")]
    assert [r["text"] for r in got.where("id = 3").collect()] == [None]


def test_near_duplicates(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs(spark)).collect()}
    assert got == {1: (26, 1, True), 2: (26, 1, False), 3: (0, 3, True), 4: (0, 4, True)}
    assert near_duplicates(docs(spark)).count() == 4


def test_repeated_spans(spark):
    summary, changed = repeated_spans(docs(spark), length=64, gram=16)
    assert sorted((r["id"], r["n_bytes"]) for r in summary.collect()) == [(1, len(TEXT)), (2, len(TEXT)), (3, 0), (4, 0)]
    assert sorted((r["id"], r["n_removed"], r["n_spans"]) for r in changed.collect()) == [(1, len(TEXT), 1), (2, len(TEXT), 1)]


def test_contaminated(spark):
    bench = spark.createDataFrame([(7, TEXT, 1), (7, "zz", 2), (None, TEXT, 3), (8, TEXT, 4)], "item_id long, text string, doc_id int")
    assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(docs(spark), bench).collect()) == [(1, 7), (1, 8), (2, 7), (2, 8)]


def test_linked_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (None, [1.0, 0.0]), (3, None), (3, [1.0, 0.0]), (4, [float("nan"), 1.0])]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "vec_id long, embedding array<double>, copies int, digest string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in linked_vectors(df).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True)}  # least vector of 2, null of 3


def test_archive_pages(spark):
    html = "h" * 1200
    rows = [(1, "http://a/", html), (2, "http://b/", html), (2, "http://b/", html), (3, None, None), (None, "http://c/", html)]
    df = spark.createDataFrame([(*r, 3, "d") for r in rows], "page_id long, url string, html string, size int, digest string")
    sha = hashlib.sha1(html.encode()).hexdigest()
    got = {r["page_id"]: tuple(r)[1:] for r in archive_pages(df).collect()}
    assert got == {1: (1200, sha, "revisit", 2), 2: (1200, sha, "response", None), 3: (0, hashlib.sha1(b"").hexdigest(), "response", None)}


def test_keep_ids_beyond_its_filter(spark, monkeypatch):
    """With more ids than the filter holds a semi-join keeps exactly the wanted rows."""
    from echosieve.llm import common

    rows = spark.range(5000).withColumn("x", F.col("id") * 2)
    ids = spark.range(0, 5000, 7)
    want = {r["id"] for r in ids.collect()}
    assert want <= {r["id"] for r in keep_ids(rows, ids).collect()}
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 10)
    got = keep_ids(rows, ids)
    assert {r["id"] for r in got.collect()} == want and got.columns == rows.columns
