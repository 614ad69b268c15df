import pytest
from pyspark.sql import functions as F

from echosieve.config import Settings
from echosieve.operators import hotspots as H
from echosieve.operators import walk

from .test_frontier_units import book


def subsequence(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = row[:]
        for k, b in enumerate(y):
            row[k + 1] = last[k] + 1 if a == b else max(row[k], last[k + 1])
    return row[-1]


def test_common_subsequences_of_all_widths():
    import random

    import numpy as np

    rng = random.Random(1)
    texts = [[rng.randrange(5) for _ in range(n)] for n in (1, 3, 8, 9, 16, 17, 32, 33, 63, 64, 65, 90)]
    flat, at = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    a, b = [x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts)))]
    want = [subsequence(texts[i], texts[j]) for i, j in zip(a, b)]
    assert walk.lcs_lengths(flat, at, a, b).tolist() == want


@pytest.mark.parametrize("dialect,cells", [("web", 1 << 21), ("web", 300), ("cli", 300)])
def test_sums_are_those_of_the_matches(spark, monkeypatch, dialect, cells):
    """A walk gives back a row a fragment, and blocks of any size the same ones."""
    s = Settings(dialect=dialect, profile="high", paragraph_radius=2, max_candidates_per_token=40, min_match_score=0.3)
    df = book(spark, docs=1).withColumn("starts_capitalized", F.col("idx") % 3 == 0)
    cols = ["idx", "match_count", "density", "badness", "reusable", "unique", "reusable_ratio", "hint"]
    want = sorted(map(tuple, H.score_rows(df, H.frontier_matches(df, s)).select(cols).collect()))
    pdf = H.walk_units(df, s).toPandas().sort_values("idx", ignore_index=True)
    monkeypatch.setattr(walk, "CELLS", cells)
    sums = spark.createDataFrame(walk.match_sums(pdf, s).astype({"first_capital": float})).withColumn("density", F.round("density", H.PLACES))
    sums = sums.withColumn("first_capital", F.when(~F.isnan("first_capital"), F.col("first_capital").cast("int")))
    assert want and sorted(map(tuple, H.score_sums(df, sums).select(cols).collect())) == want
    assert sorted(map(tuple, H.hotspots(df, s).select(cols).collect())) == want
