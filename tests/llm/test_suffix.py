import hashlib
import random

import numpy as np

from echosieve.llm import suffix
from echosieve.llm.suffix import common_prefixes, repeated_spans, suffix_order


def brute(rows, length):
    seen = {}
    raws = {i: (t or "").encode() for i, t in rows}
    for i, b in raws.items():
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append((i, k))
    cover = {i: bytearray(len(b)) for i, b in raws.items()}
    for at in seen.values():
        if len(at) > 1:
            for i, k in at:
                cover[i][k : k + length] = b"\1" * length
    out = {}
    for i, b in raws.items():
        c = cover[i]
        spans = sum(1 for k in range(len(c)) if c[k] and (k == 0 or not c[k - 1]))
        kept = bytes(x for x, y in zip(b, c) if not y)
        out[i] = (len(b), sum(c), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(docs, **kw):
    summary, changed = repeated_spans(docs, **kw)
    out = {r["id"]: (r["n_bytes"], 0, 0, r["sha"]) for r in summary.collect()}
    for r in changed.collect():
        out[r["id"]] = (out[r["id"]][0], r["n_removed"], r["n_spans"], r["kept_sha256"])
    return out


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for text in (b"banana" * 9, b"a" * 300, bytes(rng.randrange(2) for _ in range(500)), b"\0" * 20 + b"\1\0\0", b"x"):
        t = np.frombuffer(text, np.uint8)
        sa, inverse = suffix_order(t)
        assert sa.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
        lcp = common_prefixes(t, sa, inverse, np.array([0, len(text) // 2, len(text)]), 50)
        for k in range(1, len(text)):
            a, b = text[sa[k] :], text[sa[k - 1] :]
            n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert lcp[k] == min(n, 50)


def _rows(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(n):
        own = " ".join(word() for _ in range(rng.randrange(0, 80)))
        p = rng.choice(shared)
        a = rng.randrange(0, 40)
        rows.append((i, own + p[a : a + rng.randrange(20, 200)] + " ".join(word() for _ in range(30))))
    return rows + [(n, None), (n + 1, ""), (n + 2, "z" * 900), (n + 3, rows[0][1]), (n + 4, "ab " * 300), (n + 5, "y" * 63), (n + 6, "é" * 31)]


def test_matches_brute_force(spark):
    rows = _rows(1, 150)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, n int")
    want = brute(rows, 64)
    assert got(df, length=64, gram=16) == want
    # tiny shards and parts: the merge across shards decides
    assert got(df, length=64, gram=16, shard_bytes=2000, part=3) == want
    assert got(df.where("false"), length=64, gram=16) == {}


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows, 400)
    assert suffix.GRAM * 2 <= 400
