import random

import pytest

from echosieve.operators import templates as P


@pytest.mark.parametrize("ranks,places", [(30, 400), (400, 2000)])
def test_ranges_keep_what_the_whole_order_keeps(spark, ranks, places):
    """Footprints are made range by range, and of no rank behind the range that settles it."""
    rng = random.Random(ranks)
    of = {}
    for r in range(1, ranks + 1):
        copy = of[rng.randrange(1, r)] if r > 1 and rng.random() < 0.4 else []
        of[r] = sorted({*copy[: rng.randrange(1, 12)], *(rng.randrange(places) for _ in range(rng.choice([1, 9])))})
    df = spark.createDataFrame([(r, p) for r, f in of.items() for p in f], "rank int, place long")
    asked = []

    def prints(low, high, some):
        asked.append((low, high))
        rows = df.where(df["rank"].between(low, high))
        return rows if some is None else rows.where(df["rank"].isin(some))

    want = P._greedy(sorted(of.items()))
    assert P._greedy_ranges(prints, ranks, first=8) == want
    assert want[-1] > 8 and max(low for low, _ in asked) <= want[-1] if len(want) == P.MOST else want[-1] > 8
