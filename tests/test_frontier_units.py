import random

import pytest
from pyspark.sql import functions as F

from echosieve.config import Settings
from echosieve.operators import hotspots as H

WORDS = [f"w{k}" for k in range(50)]


def book(spark, paragraphs=120, docs=2, seed=3):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        idx = 0
        for p in range(paragraphs):
            for _ in range(rng.choice([1, 1, 2, 40 if p == 30 else 3])):
                rows.append((d, idx, p, [*rng.choices(["i", "you", "the"], k=2), *rng.choices(WORDS, k=rng.choice([2, 4, 7]))]))
                idx += 1
    return spark.createDataFrame(rows, "doc_id long, idx int, para_index int, tokens array<string>").persist()


def found(df):
    return sorted((r.doc_id, r.idx, r.other, r.distance, r.shared, r.score, r.weighted, tuple(sorted(r.common))) for r in df.collect())


@pytest.mark.parametrize("dialect,profile,least", [("web", "high", 0.3), ("cli", "med", 0.2)])
def test_units_of_any_size_walk_alike(spark, dialect, profile, least):
    s = Settings(dialect=dialect, profile=profile, paragraph_radius=2, max_candidates_per_token=40, min_match_score=least)
    df = book(spark)
    whole = found(H.frontier_matches(df, s))
    assert max(r[3] for r in whole) > 2  # beyond the base radius
    assert found(H.frontier_matches(df, s, unit=16)) == whole
    assert found(H.frontier_matches(df, s, unit=1)) == whole


def test_units_hold_their_halo_and_walk_once(spark):
    s = Settings(profile="low", paragraph_radius=2, max_candidates_per_token=10_000)
    df = book(spark, docs=1)
    units = H.walk_units(df, s, unit=20)
    n = df.count()
    assert units.where("walks").count() == n == units.where("walks").select("idx").distinct().count()
    para = {r.idx: r.para_index for r in df.collect()}
    held = {}
    for r in units.collect():
        held.setdefault(r.unit, set()).add(r.idx)
    for u, ids in held.items():
        for i in range(u * 20, min(n, u * 20 + 20)):
            assert all(j in ids for j in para if abs(para[j] - para[i]) <= 2)
    assert units.where(F.col("often").isNotNull()).count() == 0


def test_over_common_tokens_are_those_of_the_whole_document(spark):
    s = Settings(paragraph_radius=1, profile="low", max_candidates_per_token=40)
    df = book(spark, docs=1)
    df_of = {r.token: r.n for r in df.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    for r in H.walk_units(df, s, unit=5).collect():
        assert set(r.often or []) == {t for t in r.tokens if df_of[t] > 40}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, idx int, para_index int, tokens array<string>")
    assert H.frontier_matches(df, Settings()).count() == 0
