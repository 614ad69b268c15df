import os

from echosieve.plans import catalogue as C


def test_cut_tables_have_plans_of_one_scan(spark, tmp_path, monkeypatch):
    df = spark.range(20).selectExpr("id", "array(id) AS a").groupBy("id", "a").count().withColumnRenamed("count", "n")
    want = sorted(map(tuple, df.collect()))
    text = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    held = C._cut(df)
    assert "Aggregate" in text(C._kept(df)) and "Aggregate" not in text(held)
    assert sorted(map(tuple, held.collect())) == want
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: f"file://{tmp_path}")
    written = C._cut(df, "some")
    assert "Aggregate" not in text(written) and len(os.listdir(tmp_path)) == 1
    assert sorted(map(tuple, written.collect())) == want
    C.release()
    assert os.listdir(tmp_path) == []
