import random

import pytest

from echosieve.operators import templates as P

SCHEMA = "template array<string>, count long, sections long, slot_variety long, slots int"


def counts(spark, n, seed=1):
    rng = random.Random(seed)
    seen = {tuple(rng.choices("abcdefghij", k=rng.choice([5, 6]))) for _ in range(n)}
    # a third differ in their text alone
    rows = [(["_", *t[1:]], *((4, 1, 3, 1) if k % 3 else (rng.randrange(4, 9), rng.randrange(1, 6), rng.randrange(1, 30), 1))) for k, t in enumerate(sorted({t[1:] for t in seen}))]
    return spark.createDataFrame([(["_", *t[0][1:]], *t[1:]) for t in rows], SCHEMA).dropDuplicates(["template"])


@pytest.mark.parametrize("ranges,sample", [(128, 8192), (7, 20), (2, 5)])
def test_ranks_equal_one_order(spark, ranges, sample):
    rows = P.ranked_templates(counts(spark, 3000), [])
    got = P._ranked_by_ranges(rows.drop("rank"), ranges, sample).collect()
    want = sorted(got, key=lambda r: (-r["score"], -r["count"], -r["slot_variety"], -len(r["template"]), r["text"]))
    assert len(want) > 1000 and [r["rank"] for r in want] == list(range(1, len(want) + 1))
    one = P.ranked_templates(counts(spark, 3000).selectExpr("1 as g", "*"), ["g"]).collect()
    assert {r["text"]: r["rank"] for r in one} == {r["text"]: r["rank"] for r in got}


def test_rows_are_ranked_within_ranges(spark):
    plan = P.ranked_templates(counts(spark, 300), [])._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "row_number()" in x and "Window" in x]
    assert windows and all("[range#" in x for x in windows)


def test_empty(spark):
    assert P.ranked_templates(spark.createDataFrame([], SCHEMA), []).count() == 0
