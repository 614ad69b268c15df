import random

from pyspark.sql import functions as F

from echosieve.operators import templates as P


def test_places_in_a_document_are_those_of_the_joins(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(4)]
    rows = [(d, i, rng.choice(["a", "b", None]), rng.choices(words, k=rng.choice([3, 5, 6, 9, 14]))) for d in range(6) for i in range(60 if d else 400)]
    frags = spark.createDataFrame(rows, "doc_id long, idx int, section string, tokens array<string>").persist()
    cols = ["doc_id", "idx", "section", "start", "can_fix", "quads", "room", "reach"]
    # under another name the scope is met by joins
    want = P.frequent_starts(frags.withColumn("sc", F.col("doc_id")), ["sc"]).where("quads > 0").select(cols)
    got = P.frequent_starts(frags, ["doc_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2
    key = lambda df: sorted(map(repr, map(tuple, df.select(cols).collect())))
    assert key(got) == key(want) and got.count() > 500
    counts = P.template_counts(P.occurrences(frags, ["doc_id"]), ["doc_id"])
    again = P.template_counts(P.occurrences(frags.withColumn("sc", F.col("doc_id")), ["sc"]), ["sc"]).withColumnRenamed("sc", "doc_id")
    assert sorted(map(str, counts.collect())) == sorted(map(str, again.collect())) and counts.count() > 20
