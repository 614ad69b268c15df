import numpy as np

from echosieve.llm.embeddings import candidates, encode, linked_vectors, plan_tables


def brute(rows, t=0.95):
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    up = {i: i for i, _ in rows}
    n = {i: 0 for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i in sorted(ok):
        by.setdefault(len(ok[i]), []).append(i)
    for ids in by.values():
        x = np.array([ok[i] for i in ids])
        c = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= t
        for a, b in zip(*np.nonzero(np.triu(c, 1))):
            n[ids[a]] += 1
            n[ids[b]] += 1
            p, q = sorted((root(ids[a]), root(ids[b])))
            up[q] = p
    return {i: (n[i], root(i), root(i) == i) for i, _ in rows}


def got(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_estimates_bound_the_cosine():
    rng = np.random.default_rng(1)
    for dim in (3, 64, 300):
        a = rng.normal(size=(400, dim))
        b = np.concatenate([a + rng.normal(size=a.shape) * s * np.linalg.norm(a, axis=1, keepdims=True) / dim**0.5 for s in (0.05, 0.2, 0.3)])
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        ok = candidates(*encode(a), b, 0.95)
        assert ok[(a @ b.T) >= 0.95].all()
        if dim == 300:
            assert ok.mean() < 0.02
    assert plan_tables(10**6, 0.95)[0] < 200


def test_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    rows = []
    for k in range(700):
        v = base[k % 6] + rng.normal(size=16) * (0.25 if k % 6 == 1 else rng.choice([0.05, 0.3, 1.0]))
        rows.append((k, v.astype(np.float32).tolist()))
    rows += [(1000 + k, rows[1][1]) for k in range(50)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] * 16), (2004, [float("nan")] * 16), (2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [3.0])]
    df = spark.createDataFrame([(i, v, 1, b"") for i, v in rows], "vec_id long, embedding array<float>, label int, digest binary")
    assert got(linked_vectors(df)) == brute(rows)
    assert got(linked_vectors(df.where("false"))) == {}


def test_recall_on_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(linked_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))) == brute(rows)
