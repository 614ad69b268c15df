import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from echosieve.llm import pii as P

#: The contract's patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(P.KINDS) for m in re.finditer(BASE[kind], text or "") if passes(kind, m.group())]
    return sorted(found)


def shown(spans):
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def read(spark, tmp_path, rows, schema="doc_id long, text string, row int, items int, kind string, start int"):
    path = str(tmp_path / f"p{random.random()}")
    spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], schema).repartition(3).write.parquet(path + "/documents.parquet")
    return P.op12_pii(spark, path).collect()


def check(rows, out):
    want = sorted(((i, hashlib.sha256(shown(base_spans(t)).encode()).hexdigest(), tuple(sum(s[1] == k for s in base_spans(t)) for k in range(4))) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["base_sha256"], (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"])) for r in out), key=str) == want
    for r in out:
        spans = [s for s in r["spans"].split(",") if s]
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), P.KINDS.index(s.split(":")[0])))
        whole = {t for i, t in rows if i == r["doc_id"]}
        if len(whole) == 1:
            assert set(shown(base_spans(whole.pop())).split(",")) - {""} <= set(spans)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(rows, P.op12_pii(spark, "/root/testdata/sf0.01").collect())


CARD = "4472194062177086"


def test_edges(spark, tmp_path):
    texts = [
        None, "", " ", "\x01\x02\x01 a@b.cd \x01 1.2.3.4", "😀😀 a.b+c@mail.example.com 😀 +1 (293) 555-9179 😀" + CARD, "a@b.c_d@e.f.g@h.i", "a@b", "@b.c", "x@y.", "é@y.com ab@é.com", "a@b.c-@d.e",
        "1.2.3.4.5.6.7.8.9", "256.1.1.1 255.255.255.255 0000000001.2.3.004 1.2.3", "99999999999999999999.1.1.1", "1.2.3.4a 1..2.3.4", f"{CARD[:4]}-{CARD[4:8]} {CARD[8:12]}-{CARD[12:]}", CARD + " " + CARD, "0" * 14, "0" * 19 + "-", "0" * 20, "1 2 3 4 5 6 7 8 9 0 1 2 3 4",
        "+1 2", "+12", "+1", "+123456789 ", "+1234567890)", "+1(2)3-4.5 6 7 8 9 0 1 2 3 4 5 x", "++1 234 567 8901+", "+1 (689) 555-1019 " + CARD, "5 a 6\n7", "1-1-" * 50,
    ]
    rows = list(enumerate(texts)) + [(None, "a@b.cd"), (None, None), (3, texts[4]), (4, texts[4]), (4, texts[4])]
    check(rows, read(spark, tmp_path, rows))


def test_random_strings(spark, tmp_path):
    rng = random.Random(7)
    pieces = ["a", "b.", "@", "1", "23", ".", "-", " ", "+", "(", ")", "_", "é", CARD, "192.168.0.1", "x@y.zz", "+1 (555) 555-5555", "\n", "[at]", "(dot)", "[.]"]
    rows = [(k, "".join(rng.choices(pieces, k=rng.randint(0, 40)))) for k in range(1500)]
    check(rows, read(spark, tmp_path, rows))


def test_very_long_texts(spark, tmp_path):
    rows = [(2, "1 " * 300_000), (3, "a.b@c.de " * 20_000), (4, "+1" + "(" * 500_000), (7, "a@" * 200_000), (8, "a@b" + ".c" * 200_000), (9, f"+1 (293) 555-9179 {CARD} 1.2.3.4 " * 5_000)]
    bare = [(20, "a" * 1_000_000), (21, "1" * 1_000_000), (22, "+" * 300_000), (23, "1." * 300_000)]  # the patterns of `re` take quadratic time on these
    out = read(spark, tmp_path, rows + bare)
    check(rows, [r for r in out if r["doc_id"] < 20])
    assert sorted((r["doc_id"], r["n_ip"], r["spans"][:9]) for r in out if r["doc_id"] >= 20) == [(20, 0, ""), (21, 0, ""), (22, 0, ""), (23, 75_000, "ip:0:7,ip")]


def test_empty_table_and_no_items(spark, tmp_path):
    assert read(spark, tmp_path, []) == []
    out = read(spark, tmp_path, [(1, "nothing here"), (2, None)])
    assert [(r["spans"], r["n_card"]) for r in out] == [("", 0)] * 2


def corpus(rng, n):
    card = lambda: (lambda d: d + str(-sum(int(c) if k % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10))("4" + "".join(rng.choices("0123456789", k=14)))
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    mail = lambda: f"{rng.choice(['ann', 'bob'])}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com"
    plain = [(k, f"the words {rng.choice([card(), phone(), mail()])} are here") for k in range(n)]
    joined = [(n + k, f"call {phone()} {card()} today") for k in range(20)]
    noise = [(n + 20 + k, f"order x{rng.randint(10**15, 10**16)}y version 4.0.{rng.randint(300, 999)}.1 ref {rng.randint(100, 999)} {rng.randint(100, 999)}") for k in range(n // 4)]
    hidden = [(2 * n + k, f"write to ann{k} [at] example [dot] com now") for k in range(20)]
    return plain, joined, noise, hidden


def test_classifier_finds_what_the_base_patterns_lose(spark, tmp_path):
    plain, joined, noise, hidden = corpus(random.Random(2), 300)
    rows = plain + joined + noise + hidden
    out = {r["doc_id"]: r["spans"] for r in read(spark, tmp_path, rows)}
    for i, t in joined:  # neither is a base span, as they run into each other
        assert base_spans(t) == [] and out[i] == f"phone:5:22,card:23:39"
    assert all(out[i] == shown(base_spans(t)) for i, t in noise)
    assert all(out[i].startswith("email:9:") for i, _ in hidden)
    assert all(out[i] == shown(base_spans(t)) for i, t in plain)


def test_em_and_classifier_equal_plain_python(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, 3]), [rng.choice([-1, 0, 1, 1]) for _ in range(5)], [rng.randint(0, 1) for _ in range(5)]) for _ in range(400)]
    items = spark.createDataFrame(rows, "kind int, votes array<int>, bits array<int>").repartition(5)
    got = {r["kind"]: r["weights"] for r in P.train(items).collect()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    for kind in (0, 1, 3):
        mine = [(v, b) for k, v, b in rows if k == kind]
        known = lambda y: [0.0 if v[P.CHECK] < 0 else u for (v, _), u in zip(mine, y)]
        y = known([sig(sum(v)) for v, _ in mine])
        for _ in range(P.EM_ROUNDS):
            n1 = sum(y)
            n0 = len(y) - n1
            rate = lambda j, c, w, n, side: (sum(u for (v, _), u in zip(mine, w) if v[j] == c) + P.PRIOR[side][c + 1]) / (n + 20)
            table = {(j, c): math.log(rate(j, c, y, n1, 0) / rate(j, c, [1 - u for u in y], n0, 1)) for j in range(5) for c in (-1, 0, 1)}
            y = known([sig(math.log((n1 + 1) / (n0 + 1)) + sum(table[j, c] for j, c in enumerate(v))) for v, _ in mine])
        data = [([*v, *b, 1], u, 1.0) for (v, b), u in zip(mine, y)] + [([s] * 5 + [0.5] * 5 + [1], (s + 1) / 2, len(mine) * 0.1) for s in (1, -1)]
        curve = [sum(n * z[j] ** 2 for z, _, n in data) * 11 / 4 + 1 for j in range(11)]
        w = [0.0] * 11
        for _ in range(P.FIT_ROUNDS):
            e = [n * (sig(sum(a * b for a, b in zip(z, w))) - u) for z, u, n in data]
            w = [w[j] - (sum(x * z[j] for x, (z, _, _) in zip(e, data)) + w[j]) / curve[j] for j in range(11)]
        assert all(abs(a - b) < 1e-6 for a, b in zip(got[kind], w))


def test_redact(spark):
    df = spark.createDataFrame([("é a@b.cd, +1 (293) 555-9179.",), ("none",), ("",)], "text string").withColumn("doc_id", F.lit(1))
    found = P.find_pii(df.withColumn("doc_id", F.length("text"))).withColumnRenamed("doc_id", "n")
    out = df.join(found, F.length("text") == F.col("n")).select(P.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert sorted(r["t"] for r in out) == ["", "none", "é [email], [phone]."]
