import random

from pyspark.sql import functions as F

from echosieve.functions.clauses import paragraphs_of
from echosieve.operators import diagnostics as D
from echosieve.operators import similarity as S
from echosieve.operators.fragments import fragment_rows, fragments, paragraphs, tokens_by_document

PIECES = ["\n", "\n\n", " \t\n", "---", "\n---\n", "# Kopf\n", "  ## b  \n", "#", "#x\n", "Anna: ", "the cat sat, ", "ein Haus; «é» ", "— you and i. ", "\r\n", "“q” ...", " ", "\x0b", "𝄞 so it goes: "]


def texts(spark, n=600):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choices(PIECES, k=rng.choice([0, 1, 5, 30])))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "---\na: b\n---\n# t\nthe cat sat, the dog ran\n"), (n + 3, "---\nopen\n"), (n + 4, "---\n---\nthe cat sat on it")]
    return spark.createDataFrame(rows, "doc_id long, text string").persist()


def test_paragraphs_are_those_of_the_windows(spark):
    docs = texts(spark)
    want = {(r.doc_id, r.para_index): (r.section, r.start_line, r.source_start, r.source) for r in paragraphs(docs).collect()}
    got = {(r.doc_id, k): p for r in docs.where("text is not null").collect() for k, p in enumerate(paragraphs_of(r.text))}
    assert len(want) > 500 and got.keys() == want.keys()
    differ = {k: (got[k], want[k]) for k in want if got[k] != (want[k][0], want[k][1], want[k][2], want[k][3])}
    assert not differ, list(differ.items())[:3]


def test_offsets_are_true(spark):
    docs = texts(spark)
    rows = fragments(docs).join(docs.withColumnRenamed("text", "whole"), "doc_id").collect()
    assert len(rows) > 500
    for r in rows:
        assert " ".join(r.whole[r.source_start : r.source_end].split()) == " ".join(r.text.split())


def test_counts_need_one_shuffle_of_texts(spark):
    """Postings are counted inside a document's row, and n-grams without numbering fragments."""
    docs = texts(spark)
    want = sorted(map(tuple, S.token_postings(fragments(docs)).collect()))
    df = S.postings_in_rows(tokens_by_document(docs))
    assert sorted(map(tuple, df.collect())) == want and want
    plan = S.postings_in_rows(tokens_by_document(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort [" not in plan and "HashAggregate" not in plan
    grams = D.ngram_counts(fragment_rows(docs))
    assert sorted(map(tuple, grams.collect())) == sorted(map(tuple, D.ngram_counts(fragments(docs)).collect()))
    assert "Window" not in grams._jdf.queryExecution().executedPlan().toString()
