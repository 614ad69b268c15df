import corpus_pipeline
from echosieve.llm.decontaminate import words_of


def test_stages_take_effect_and_keep_columns(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        docs.write.mode("overwrite").parquet(p := f"/tmp/echosieve-pipeline-test/{name.split()[0]}")
        docs = spark.read.parquet(p)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "benchmark decontamination":
            items = [b" " + b" ".join(words_of(r["text"])) + b" " for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            assert not any(q in b" " + b" ".join(words_of(r["text"])) + b" " for r in docs.collect() for q in items)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4] == sizes[5] > 0.5 * sizes[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    bad = sum(v == 0 for v in labels.values())
    left = {r["doc_id"] for r in docs.collect()}
    assert sum(labels[i] == 0 for i in labels if i in left) < 0.25 * bad


def test_stages_on_edge_rows(spark):
    """Nulls, empty texts, repeated rows, clashing columns, no n_chars, and empty tables."""
    d = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").limit(60)
    own = " ".join(f"nothing{k} repeats{k}" for k in range(40))
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, own), (10**6 + 2, own), (None, None), (None, own[::-1])], "doc_id long, text string")
    docs = plain.union(odd).selectExpr("doc_id", "text", "'c' AS cut", "1 AS id", "'l' AS label", "x'00' AS digest", "2.5 AS score", "0 AS kept")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, docs.where("false")):
            got = stage(spark, table, d)
            rows = got.collect()
            if k < 4:
                assert got.columns == docs.columns and got.schema == docs.schema or [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
                assert all((r["cut"], r["id"], r["kept"]) == ("c", 1, 0) for r in rows)
            if table is docs and k > 0:
                ids = [r["doc_id"] for r in rows]
                assert ids.count(10**6) == ids.count(10**6 + 1) == 1 and ids.count(10**6 + 2) == 2 and ids.count(None) == 2, name
            if table is not docs:
                assert rows == []
