import numpy as np

from echosieve.llm.quality import FEATURES, _marginals, fit, features, line_features, op3_quality, score_quality


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    offsets = np.array([0, 4, 5, 9])
    unary, stay = rng.normal(size=9), rng.normal(size=(2, 2))
    p, pairs = _marginals(unary, stay, offsets)
    want, all_pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(offsets, offsets[1:]):
        n, total, m, pp = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            s = np.exp(sum(unary[a + k] * y[k] for k in range(n)) + sum(stay[y[k], y[k + 1]] for k in range(n - 1)))
            total += s
            m += s * np.array(y)
            for k in range(n - 1):
                pp[y[k], y[k + 1]] += s
        want[a:b] = m / total
        all_pairs += pp / total
    assert np.allclose(p, want) and np.allclose(pairs, all_pairs)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = op3_quality(spark, d)
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    right = np.mean([r["quality"] == r["predicted"] for r in rows])
    recall = np.mean([r["predicted"] == 0 for r in rows if r["quality"] == 0])
    assert right > 0.95 and recall > 0.8, (right, recall)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "x " * 300_000), (4, "x " * 300_000), (5, "A fine line.\nAnother one.")]
    df = spark.createDataFrame([(*r, 1.0, "q") for r in rows], "doc_id long, text string, score double, id string")
    model = fit([(*features(t), y) for t, y in (("good words here\nand there.", 1), ("BAD!! BAD!!", 0), ("", 0))])
    got = [r["score"] for r in score_quality(df, model).collect()]
    assert len(got) == 6 and all(0 <= x <= 1 for x in got)
    assert {r["score"] for r in score_quality(df, None).collect()} == {0.5}
    assert score_quality(df.where("false"), model).count() == 0
    assert fit([]) is None


def test_symbols_count_wherever_they_are():
    few, many = b"., " * 3000, b"## " * 5000
    late, early = (dict(zip(FEATURES, line_features(x, 0.0))) for x in (few + many, many + few))
    assert late["commonest symbol"] == early["commonest symbol"] == 10000 / 24000
    assert late["doubled symbols"] == early["doubled symbols"] > 0
