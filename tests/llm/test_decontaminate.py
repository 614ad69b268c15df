import random

from echosieve.llm.decontaminate import common_subsequence, contaminated, op10_decontaminate, verify, words_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert common_subsequence(a, b) == lcs(a, b)


def test_exact_leaks_on_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], b" " + b" ".join(words_of(r["text"])) + b" ") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r["item_id"], b" " + b" ".join(words_of(r["text"])) + b" ") for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = {(i, j) for i, t in docs for j, q in items if q in t}
    got = {(r["doc_id"], r["item_id"]) for r in op10_decontaminate(spark, d).collect()}
    assert want <= got
    assert all(verify(words_of(dict(items)[j].decode()), words_of(dict(docs)[i].decode()), 0, 10**6)[0] >= 0.6 for i, j in got)
    assert len(got) < 1.5 * len(want) + 5


def test_paraphrases_and_edges(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    vocab = [word() for _ in range(3000)]
    item = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, item(rng.randrange(16, 70))) for k in range(20)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, want = [(1, None), (2, ""), (3, "one"), (4, "x " * 60_000)], set()
    for k in range(100, 160):
        i, w = rng.choice(items)
        w = [x if rng.random() > 0.12 else rng.choice(vocab) for x in w]
        w.insert(len(w) // 2, "indeed")
        rows.append((k, text(rng.randrange(0, 300)) + " " + ", ".join(w).upper() + ". " + text(100)))
        want.add((k, i))
    clean = [(k, text(300)) for k in range(200, 300)]
    half = [(k, text(100) + " ".join(items[k % 20][1][: len(items[k % 20][1]) // 2]) + " " + text(100)) for k in range(300, 320)]
    df = spark.createDataFrame([(*r, 5, "w") for r in rows + clean + half], "doc_id long, text string, item int, words string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, " ".join(items[0][1]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(df, bench).collect()}
    assert {(a, 0 if b == 92 else b) for a, b in got} == want
    assert {a for a, b in got if b == 92} == {a for a, b in want if b == 0}
    assert contaminated(df.where("false"), bench).count() == 0
    assert contaminated(df, bench.where("false")).count() == 0


def accepted(docs, items):
    """Every (doc, item) that verify() accepts somewhere in the whole text."""
    out = set()
    for i, t in docs:
        words = words_of(t)
        out |= {(i, j) for j, x in items if words and verify(x, words, 0, len(words))[0] >= 0.6}
    return out


def test_all_that_verify_accepts_on_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r["item_id"], words_of(r["text"])) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert {(r["doc_id"], r["item_id"]) for r in op10_decontaminate(spark, d).collect()} == accepted(docs, items)


def test_paraphrases_without_the_rarest_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(9))
    common = [word() for _ in range(200)]
    own = [rng.sample(range(22), 10) for _ in range(20)]  # the answer, the last words, stays
    items = [(k, [word() if p in own[k] else rng.choice(common) for p in range(30)]) for k in range(20)]
    text = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs = [(k, text(90) + " " + " ".join(word() if p in own[k % 20] else w for p, w in enumerate(items[k % 20][1])) + " " + text(90)) for k in range(60)]
    docs += [(k, text(250)) for k in range(100, 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(df, bench).collect()}
    assert got == accepted(docs, [(k, words_of(" ".join(x))) for k, x in items]) and {(k, k % 20) for k in range(60)} <= got


def test_items_listed_one_after_another(spark):
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    rows = sorted(((r["item_id"], r["text"]) for r in bench.collect()), key=lambda r: len(words_of(r[1])))[:60]
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    dump = spark.createDataFrame([(10**6, " ".join(t for _, t in rows)), (10**6 + 1, " ".join(t for _, t in random.Random(3).sample(rows, 60)))], "doc_id long, text string")
    found = contaminated(clean.union(dump), bench).where("doc_id >= 1000000").collect()
    got = {(r["doc_id"], r["item_id"]): r for r in found}
    want = {(d, i) for d in (10**6, 10**6 + 1) for i, _ in rows}
    assert want <= set(got)
    assert all(got[k]["share"] == 1 for k in want)


def test_item_in_a_third_of_the_documents(spark):
    d = "/root/testdata/sf0.01"
    rng = random.Random(6)
    docs = [(r["doc_id"], (r["text"] or "").split(" ")) for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    hot = bench.orderBy("item_id").first()
    rows, want = [], set()
    for k, (i, w) in enumerate(docs):
        if k % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w = [*w[:at], hot["text"], *w[at:]]
            want.add(i)
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).where(f"item_id = {hot['item_id']}").collect()}
    assert want <= set(got)
    assert all(got[i]["share"] == 1 for i in want)
    assert min(got[i]["cosine"] for i in want) > 0.45  # below this, items were once given up


def test_items_of_one_word(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "some text with Alpha, and more"), (3, "alphabet"), (4, "beta beta beta"), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha"), (8, "Beta beta"), (9, "gamma")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["share"], r["first_word"]) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 7, 1.0, 0), (2, 7, 1.0, 3), (4, 8, 1.0, 0)}
