import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from echosieve.config import Settings
from echosieve.operators import hotspots as H
from echosieve.operators import similarity as S
from echosieve.operators import units

from .test_frontier_units import book


def brute(df, s, radius):
    """Pairs of a document within the radius that share a token which few enough fragments hold."""
    rows = [(r.doc_id, r.idx, r.para_index, set(r.tokens)) for r in df.collect()]
    df_of = {}
    for d, _, _, t in rows:
        for x in t:
            df_of[d, x] = df_of.get((d, x), 0) + 1
    return {(d, i, j, abs(p - q)) for d, i, p, t in rows for e, j, q, u in rows if d == e and i < j and abs(p - q) <= radius and any(df_of[d, x] <= s.max_candidates_per_token for x in t & u)}



@pytest.mark.parametrize("dialect,size,unit", [("web", 1, 8192), ("web", 100, 8192), ("cli", 64, 16)])
def test_units_of_short_documents_are_met_together_and_apart(spark, monkeypatch, dialect, size, unit):
    s = Settings(dialect=dialect, max_candidates_per_token=40, min_match_score=0.3)
    df = book(spark, paragraphs=20, docs=5).union(book(spark, paragraphs=2, docs=9, seed=8).withColumn("doc_id", F.col("doc_id") + 10)).persist()
    monkeypatch.setattr(units, "PACK", size)
    monkeypatch.setattr(units.walked, "__defaults__", (unit,))
    monkeypatch.setattr(units.packs, "__defaults__", (size,))
    got = [tuple(r) for r in S.candidate_pairs(df, s, 3).select("doc_id", "a", "b", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(df, s, 3)
    names = ["overlap", "seq", "bigram", "trigram", "size", "shared", "exchange", "score"]
    key = lambda rows: sorted((r.doc_id, r.a, r.b, *[round(r[c], 9) for c in names]) for r in rows.collect())
    assert key(S.scored_pairs(df, s, 3)) == key(S.pair_similarity(df, S.candidate_pairs(df, s, 3), s))
    again = S.pair_similarity(df, S.similar_pairs(df, s, 3), s).where(F.col("score") >= s.min_match_score)
    assert {(r.doc_id, r.a, r.b) for r in again.where(F.col("shared") >= s.min_shared).collect() if dialect == "web"} == {(r.doc_id, r.idx, r.other) for r in S.matches(df, s, 3).collect() if r.idx < r.other and dialect == "web"}
    df.unpersist()


def test_base_hotspots_are_sums_of_the_base_matches(spark):
    """No pair is shuffled: one exchange of fragments by unit, then a row a fragment."""
    s = Settings(profile="high", paragraph_radius=2, max_candidates_per_token=40, min_match_score=0.3)
    df = book(spark).withColumn("starts_capitalized", F.col("idx") % 3 == 0)
    cols = ["doc_id", "idx", "match_count", "density", "badness", "reusable", "unique", "hint"]
    want = sorted(map(tuple, H.score_rows(df, S.matches(df, s)).select(cols).collect()))
    assert want and sorted(map(tuple, H.hotspots(df, s, 0).select(cols).collect())) == want
    plan = H.hotspots(df, s, 0)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInPandas") == 1


def test_packs_keep_units_whole():
    rng = random.Random(2)
    sizes = [rng.choice([1, 2, 5, 30]) for _ in range(60)]
    pdf = pd.DataFrame([(d // 2, d % 2, i) for d, n in enumerate(sizes) for i in range(n)], columns=["doc_id", "unit", "idx"])
    for width in (1, 7, 1000):
        for size in (1, 8, 40):
            got = list(units.packs((pdf.iloc[a : a + width] for a in range(0, len(pdf), width)), size))
            assert pd.concat(got, ignore_index=True).equals(pdf)
            keys = [set(zip(g.doc_id, g.unit)) for g in got]
            assert sum(map(len, keys)) == len(set.union(*keys)) == 60
            assert all(len(g) < size + 30 for g in got) and all(len(g) >= size for g in got[:-1])
