import random
from collections import Counter

from echosieve.operators import diagnostics as D

SCHEMA = "doc_id long, idx int, tokens array<string>"


def test_metrics_equal_counters_without_a_shuffle(spark):
    rng = random.Random(3)
    rows = [(1, k, rng.choices("abcde", k=rng.randrange(1, 30))) for k in range(200)] + [(2, 0, ["a"] * 5), (2, 1, ["a"])]
    out = D.pattern_metrics(spark.createDataFrame(rows, SCHEMA))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {(r["doc_id"], r["idx"]): r for r in out.collect()}
    assert len(got) == len(rows)
    for doc, idx, t in rows:
        grams = Counter(" ".join(t[i : i + n]) for n in (2, 3, 4) for i in range(len(t) - n + 1))
        r = got[doc, idx]
        assert r["signatures"] == sorted(g for g, c in grams.items() if c > 1)
        assert r["repeated_windows"] == sum(c - 1 for c in grams.values())
        assert r["repeated_mass"] == len(t) - len(set(t))
        assert r["dominant_share"] == max(Counter(t).values()) / len(t)
