import random

import pytest
from pyspark.sql import functions as F

from echosieve.config import CLI, WEB, WEIGHTS
from echosieve.operators import similarity as S


def frags(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, idx int, para_index int, tokens array<string>")


@pytest.mark.parametrize("settings", [WEB, CLI], ids=lambda s: s.dialect)
def test_no_pair_that_scores_enough_is_left_out(spark, settings):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["the"] * 30
    rows = [(d, i, i // 3, rng.choices(words, k=rng.choice([1, 2, 3, 5, 9, 20, 60]))) for d in range(4) for i in range(150)]
    rows += [(9, i, 0, [f"u{i}", "the", f"v{i % 40}", "a", "b", f"x{i % 7}"]) for i in range(260)]  # `the` is too common
    df = frags(spark, rows).persist()
    every = S.candidate_pairs(df, settings)
    some = S.similar_pairs(df, settings).persist()
    enough = S.pair_similarity(df, every, settings).where(F.col("score") >= settings.min_match_score)
    keys = ["doc_id", "a", "b", "distance"]
    assert enough.count() > 100 and some.count() < every.count()
    assert enough.join(some, keys, "left_anti").count() == 0
    assert some.join(every, keys, "left_anti").count() == 0
    df.unpersist()


def test_least_shared_is_a_lower_bound():
    for weights, bound in ((WEIGHTS["web"], 0.2), (WEIGHTS["cli"], 0.24)):
        raw, seq, two, three, size = weights
        for n in range(1, 60):
            k = S.least_shared(n, bound, weights)
            for o in range(1, k):  # fewer shared tokens never score enough, whatever the partner's length
                for m in range(o, 3 * n):
                    best = raw * o / n + seq * 2 * o / (n + m) + two * (o - 1) / max(n - 1, 1) + three * max(o - 2, 0) / max(n - 2, 1) + size * min(n, m) / max(n, m)
                    assert best < bound


def test_empty(spark):
    assert S.matches(frags(spark, []), WEB).count() == 0
