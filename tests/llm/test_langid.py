from pyspark.sql import functions as F

from echosieve.llm.langid import identify, op2_langid, train


def test_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = op2_langid(spark, d)
    assert got.count() == docs.count()
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows)
    assert right > 0.95, right
    sure = sum(r["score"] for r in rows) / len(rows)
    assert abs(sure - right) < 0.06


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "de"), (4, "", "en"), (5, "123 !?", None), (6, "the the " * 100_000, None), (6, "the the " * 100_000, None)]
    df = spark.createDataFrame([(*r, 1.0, "q") for r in rows], "doc_id long, text string, lang string, score double, id string")
    model = train(df.where("lang is not null and text is not null").select(F.col("doc_id").alias("id"), "text", "lang"))
    got = sorted((r["doc_id"], r["lang_pred"]) for r in identify(df, model).collect())
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]
    assert {r["lang_pred"] for r in identify(df, None).collect()} == {"und"}
    assert identify(df.where("false"), model).count() == 0
    assert train(df.where("false").select(F.col("doc_id").alias("id"), "text", "lang")) is None
