import re

from echosieve.llm.minhash import near_duplicates


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                x = len(sets[a] & sets[b])
                if 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_matches_brute_force_on_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert got(near_duplicates(docs, width=4)) == brute(rows, 4, 80)


def test_edges_of_input(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "a b"), (6, base), (7, base.upper()), (8, base + " x"), (9, " \t\n"), (10, "b a"), (11, "x" * 200_000), (12, base.replace("w30", "q"))]
    rows += [(100 + k, base.replace(f"w{k % 50 + 3}", f"z{k}")) for k in range(400)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, id string, hub int")
    assert got(near_duplicates(df, width=4)) == brute(rows, 4, 80)
    assert got(near_duplicates(df.where("false"))) == {}
