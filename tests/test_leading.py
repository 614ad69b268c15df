import random

import pytest

from echosieve.operators import leading as L
from echosieve.operators import templates as P

SCHEMA = "doc_id long, idx int, para_index int, section string, tokens array<string>"


def frags(spark, n=400, seed=1):
    rng = random.Random(seed)
    frames = [[rng.choice("abcdefgh") * 2 for _ in range(9)] for _ in range(6)]
    rows = []
    for k in range(n):
        t = [x if rng.random() < 0.8 else f"w{rng.randrange(30)}" for x in rng.choice(frames[: 1 + k % 6])]
        rows.append((k // 7, k % 7, 0, rng.choice(["s", "t"]), [f"v{rng.randrange(50)}"] * rng.randrange(3) + t))
    return spark.createDataFrame(rows, SCHEMA)


def kept(df, name=""):
    return df.localCheckpoint()


@pytest.mark.parametrize("first,most", [(8, 5), (200, 5), (8, None)])
def test_leading_equals_the_choice_of_all(spark, monkeypatch, first, most):
    rows, asked = kept(frags(spark)), []
    places = L.frequent_places
    monkeypatch.setattr(L, "FIRST", first)
    monkeypatch.setattr(L, "RANKS", 70)
    monkeypatch.setattr(L, "frequent_places", lambda f, t, least: asked.append(least) or places(f, t, least))
    text = lambda df: sorted(map(str, df.select("template", "rank", "model_rank", "count", "score").collect()))
    occ = P.occurrences(rows, [], table=kept)
    want = P.dedup_templates(kept(P.ranked_templates(P.template_counts(occ, []), [])), occ, [], most)
    got, own = L.leading(rows, kept, most)
    assert text(got) == text(want) and got.count() == (most or P.MOST)
    cells = lambda c, o: sorted(map(str, P.model_probabilities(c, o, []).collect()))
    assert cells(got, own) == cells(want, occ)
    assert asked and asked == sorted(asked, reverse=True) and min(asked) > P.LEAST or most is None


def test_nothing_leads_in_nothing(spark):
    chosen, occ = L.leading(frags(spark).where("false"), kept)
    assert chosen.count() == 0 and occ.count() == 0


def test_shared_places_of_windows_in_many_batches(spark):
    rng = random.Random(3)
    rows = [(d, i, s, rng.choice([5, 9]), [f"t{r}"]) for d in range(2) for i in range(3) for s in range(40) for r in range(6) if rng.random() < 0.4]
    occ = spark.createDataFrame(rows, "doc_id long, idx int, start int, length int, template array<string>")
    some = spark.createDataFrame([([f"t{r}"], r) for r in range(5)], "template array<string>, id int")
    covers = [{(d, i, s + k) for d, i, s, n, t in rows if t == [f"t{r}"] for k in range(n)} for r in range(5)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (3, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert L._shared(occ, some, 5).tolist() == [[len(a & b) for b in covers] for a in covers]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_candidates_are_scored_where_fragments_lie(spark, monkeypatch):
    rows = kept(frags(spark))
    chosen, occ = L.leading(rows, kept)
    probs = kept(P.model_probabilities(chosen, occ, []))
    got = P.pattern_candidates(rows, probs, [])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # tokens are neither dealt nor joined
    monkeypatch.setattr(L, "CELLS", 0)
    want = P.pattern_candidates(rows, probs, [])
    text = lambda df: sorted(map(str, df.select("doc_id", "model_rank", "idx", "para_index", "start", "score", "matched", "peak").collect()))
    assert text(got) == text(want) and got.count() > 100
