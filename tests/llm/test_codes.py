import hashlib
import math

import numpy as np

from echosieve.llm import codes as C
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


def brute(rows, width):
    """{position: (code, error)} and the codebooks, with Python's integers."""
    kept = sorted((i, [math.floor(4096 * x) for x in v]) for i, v in rows)
    step = width // 8
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v in kept[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(6):
        for p, book in enumerate(books):
            mine = {}
            for _, v in kept:
                mine.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            for e, xs in mine.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v in kept:
        best = [near(cut(v, p), books[p]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), min(sum(d for d, _ in best), C.LARGEST)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def got(spark, rows, schema="vec_id long, embedding array<float>, label int, code int, part string"):
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], schema).repartition(3)
    return C.compress(df).collect()


def check(spark, rows, width, schema="vec_id long, embedding array<double>, label int, code int, part string"):
    fine = [(i, v) for i, v, _ in rows if i is not None and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    want, sha = brute(fine, width)
    out = got(spark, rows, schema)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in out) == sorted(want)
    assert {r["codebooks_sha256"] for r in out} == {sha}
    sums = {}
    for r in out:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == min(sums[r["label"]], C.LARGEST) for r in out)


def test_query_equals_sql(spark):
    assert differences(spark, connect(SF), C.op13_codes, C.ORACLE, SF) == ""


def test_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(0, 0.2, 24)], int(k) % 3 if k % 5 else None) for k in range(300)]
    rows += [(1000 + k, [0.25] * 24, 7) for k in range(200)] + [(3, [0.0] * 24, 1), (3, [-0.1] * 24, 1)]
    rows += [(None, [0.1] * 24, 1), (2000, None, 1), (2001, [], 1), (2002, [0.1] * 23 + [None], 1), (2003, [float("nan")] + [0.0] * 23, 1), (2004, [float("inf")] + [0.0] * 23, 1), (2005, [0.5] * 16, 1), (2006, [0.5] * 25, None)]
    check(spark, rows, 24)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in rng.normal(0, 10.0 ** (k % 9 * 4), 16)], 1) for k in range(80)]
    check(spark, rows, 16)


def test_small_tables(spark):
    assert got(spark, []) == []
    check(spark, [(4, [1.0] * 8, None)], 8)
    check(spark, [(k, [k * 0.5] * 8, None) for k in range(9)], 8)


def test_nearest_with_bounds_equals_all_distances():
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 8, 13, 32):
        for spread in (3, 50, 4000):
            book = rng.integers(-spread, spread, (16, width))
            x = np.concatenate([rng.integers(-spread, spread, (200, width)), book, (book[:-1] + book[1:]) // 2])
            d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            index, least, taken = C.nearest(x, book)
            assert (index == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all() and taken <= d.size


def test_bounds_spare_distances_of_scattered_entries():
    rng = np.random.default_rng(6)
    book = rng.integers(-4000, 4000, (16, 8))
    x = book[rng.integers(0, 16, 5000)] + rng.integers(-300, 300, (5000, 8))
    assert C.nearest(x, book)[2] < 0.2 * x.shape[0] * 16
