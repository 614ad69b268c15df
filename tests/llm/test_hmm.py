import collections
import itertools
import math
import re

import numpy as np
from pyspark.sql import functions as F

from echosieve.llm import hmm
from echosieve.llm.hmm import Hmm, op9_hmm, score_texts


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def base(rows):
    c = collections.Counter(w for _, t, train in rows if train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t, _ in rows}


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    k = 3
    m = Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(5), k).T)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6, 2)]
    for s, got in zip(seqs, m.forward(seqs)):
        want = sum(m.start[p[0]] * m.emit[s[0], p[0]] * np.prod([m.move[a, b] * m.emit[x, b] for a, b, x in zip(p, p[1:], s[1:])]) for p in itertools.product(range(k), repeat=len(s)))
        assert math.isclose(10**got, want, rel_tol=1e-9)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = op9_hmm(spark, d).collect()
    held = {r["doc_id"]: r["held_out"] for r in got}
    rows = [(r["doc_id"], r["text"], not held[r["doc_id"]]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = base(rows)
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert math.isclose(r["base_score"], w[3], rel_tol=1e-9)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_small_lexicon_edges_and_total_probability(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LEXICON", 8)
    rows = [(1, None, True), (2, "", True), (3, "A a b B c", True), (4, "a b " * 50, True), (5, "zz yy a", False), (6, "d e f g h i j k l m n o", True), (7, "q" * 100_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, learn boolean, token string")
    got = {r["doc_id"]: r for r in score_texts(df, F.col("learn")).collect()}
    want = base(rows)
    for i, w in want.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == w[:3]
        assert math.isclose(got[i]["base_score"], w[3], rel_tol=1e-9)
        assert -1e9 < got[i]["score"] < 0
    assert score_texts(df.where("false"), F.col("learn")).count() == 0
    assert score_texts(df, F.lit(False)).count() == len(rows)


def enumerated(m, s):
    """Expected counts of one sequence by summing over all state paths."""
    k = len(m.start)
    emit, move, start, total = np.zeros_like(m.emit), np.zeros((k, k)), np.zeros(k), 0.0
    for p in itertools.product(range(k), repeat=len(s)):
        w = m.start[p[0]] * m.emit[s[0], p[0]] * np.prod([m.move[a, b] * m.emit[x, b] for a, b, x in zip(p, p[1:], s[1:])])
        total += w
        start[p[0]] += w
        for x, a in zip(s, p):
            emit[x, a] += w
        for a, b in zip(p, p[1:]):
            move[a, b] += w
    return emit / total, move / total, start / total, math.log10(total)


def test_expected_counts_across_blocks(monkeypatch):
    """Messages are carried over blocks: counts of whole sequences equal enumeration."""
    monkeypatch.setattr(hmm, "STATES", 3)
    rng = np.random.default_rng(1)
    m = Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = sorted([rng.integers(0, 5, n).astype(np.uint16) for n in (1, 7, 6, 2, 6, 1)], key=len, reverse=True)
    want = [sum(x) for x in zip(*(enumerated(m, s) for s in seqs))]
    for cells in (1, 4, 9, 1000):
        monkeypatch.setattr(hmm, "CELLS", cells)
        emit, move, start = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
        total = m.expect(seqs, emit, move, start)
        for got, w in zip((emit, move, start, total), want):
            assert np.allclose(got, w, rtol=1e-4, atol=1e-5), cells


def test_training_raises_the_likelihood(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):  # two regimes that last
        state, out = 0, []
        for _ in range(200):
            state = state if rng.random() < 0.95 else 1 - state
            out.append(int(rng.integers(0, 6) + 6 * state))
        rows.append((bytes(np.array(out, np.uint16).tobytes()), True))
    unigram = np.bincount(np.concatenate([np.frombuffer(r[0], np.uint16) for r in rows]), minlength=12) / 12_000
    df = spark.createDataFrame(rows, "syms binary, train boolean").repartition(3)
    model, path = hmm.baum_welch(spark, df, unigram, 12_000, rounds=12)
    assert len(path) > 3 and all(b > a - 1e-3 * abs(a) for a, b in zip(path, path[1:])) and path[-1] > path[0] + 0.05 * 12_000
    assert model.forward([np.frombuffer(rows[0][0], np.uint16).astype(np.int64)])[0] > 200 * np.log10(1 / 12) + 5


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b", 3), (1, "a b", 3), (None, "a c", 4), (None, None, 5)], "doc_id long, text string, row int")
    got = score_texts(df, F.lit(True)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(0, 1, 1, 10), (0, 3, 3, 10), (1, 3, 3, 10), (1, 3, 3, 10)]
