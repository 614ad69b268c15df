import collections
import re
import time

from pyspark.sql import functions as F

from echosieve.llm import urls
from echosieve.llm.urls import RULES, judge_urls, matching_rule, op6_urls


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url) if url is not None else None
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fit = [r for r in RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
    return max(fit, key=lambda r: len(r[0])) if fit else (None, None)


def wilson(bad, good):
    n, z2 = bad + good, 3.8416
    if not n:
        return 0
    p = bad / n
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), (z2 * (p * (1 - p) / n + z2 / (4 * n * n))) ** 0.5 / (1 + z2 / n)
    return 1 if mid - half > 0.5 else -1 if mid + half < 0.5 else 0


def brute(pages):
    """(host, path, rule, verdict) by page, templates grown by dictionaries."""
    rows = {i: (*parts(u), *rule_of(*parts(u))) for i, u in pages}
    shapes = collections.Counter((h, re.sub("[0-9]+", "#", p)) for h, p, _, _ in rows.values())
    lab = collections.defaultdict(lambda: [0, 0])
    for h, p, _, v in rows.values():
        if v:
            lab[h, re.sub("[0-9]+", "#", p)][v == "allow"] += 1
    seg = {k: re.sub("^/", "", k[1]).split("/") for k in shapes}
    temp, live, level = dict.fromkeys(shapes, ""), set(shapes), 0
    while live:
        total = collections.Counter()
        kids = collections.defaultdict(lambda: [0, 0, 0, collections.Counter()])
        for k in live:
            total[k[0], temp[k]] += shapes[k]
            x = kids[k[0], temp[k], seg[k][level]]
            x[0] += shapes[k]
            x[1] += lab[k][0]
            x[2] += lab[k][1]
            x[3]["/".join(re.sub("[^#.]+", "a", s) for s in seg[k][level + 1 :])] += shapes[k]
        sign = {}
        for (h, t, here), x in kids.items():
            if x[0] >= urls.SUPPORT and x[0] >= urls.SHARE * total[h, t]:
                main = max(x[3].items(), key=lambda y: (y[1], y[0]))
                sign[h, t, here] = ((main[0], int(main[1] / x[0] * 4 + 0.5)), wilson(x[1], x[2]))
        kinds = collections.defaultdict(list)
        for (h, t, _), (p, k) in sign.items():
            kinds[h, t, p].append(k)
        ended = set()
        for k in live:
            h, t, here = node = k[0], temp[k], seg[k][level]
            if total[h, t] < urls.SUPPORT:
                temp[k] = t + "/*" * (len(seg[k]) - level) + "/$"
                ended.add(k)
                continue
            token = "*"
            if node in sign:
                p, kind = sign[node]
                of = kinds[h, t, p]
                mixed = min(of) < 0 < max(of)
                token = repr((p, kind)) if mixed and of.count(kind) > 1 else repr(p) if not mixed and len(of) > 1 else here
            temp[k] = t + "/" + token + ("/$" if len(seg[k]) == level + 1 else "")
            if len(seg[k]) == level + 1:
                ended.add(k)
        live, level = live - ended, level + 1
    sums = collections.defaultdict(lambda: [0, 0])
    for k in shapes:
        sums[k[0], temp[k]][0] += lab[k][0]
        sums[k[0], temp[k]][1] += lab[k][1]
    out = {}
    for i, (h, p, r, v) in rows.items():
        x = sums[h, temp[h, re.sub("[0-9]+", "#", p)]]
        bad = (x[0] + urls.SMOOTHING / 2) / (sum(x) + urls.SMOOTHING) > 0.5 and sum(x) >= urls.LABELS
        out[i] = (h, p, r, v or ("block" if bad else "allow"))
    return out


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.1"
    want = brute([(r[0], r[1]) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()])
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op6_urls(spark, d).collect()}
    assert got == want


def test_labels_reach_siblings_and_deep_paths(spark):
    """Alike siblings pool their labels, differing ones stay apart, and no level is cut off."""
    deep = "/".join(f"s{k}" for k in range(12))
    rows = [(k, f"http://a.org/{w}/{k}") for k, w in enumerate(["one"] * 30 + ["two"] * 30)]  # two has no label
    rows += [(100 + k, f"http://b.org/{w}/{k}") for k, w in enumerate(["good"] * 40 + ["bad"] * 40)]
    rows += [(200 + k, f"http://c.org/{deep}/{w}/x") for k, w in enumerate(["p"] * 30 + ["q.r"] * 30)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    label = F.when(F.col("path").startswith("/one") | F.col("path").startswith("/bad") | F.col("path").contains("/q.r/"), 1).when(F.col("path").startswith("/good") | F.col("path").contains("/p/"), 0)
    got = {r["page_id"]: r for r in judge_urls(df, label).collect()}
    assert {got[k]["rejected"] for k in range(60)} == {True} and len({got[k]["template"] for k in range(60)}) == 1
    assert {got[100 + k]["rejected"] for k in range(40)} == {False} and {got[140 + k]["rejected"] for k in range(40)} == {True}
    assert {got[200 + k]["rejected"] for k in range(30)} == {False} and {got[230 + k]["rejected"] for k in range(30)} == {True}
    assert got[200]["template"].count("/") == 15


def test_long_paths_that_support_has(spark):
    """Steps follow the divisions: 25 urls of 500 segments, alike, different at every level
    or of different lengths, and branches that divide at a few levels."""
    same = "/".join(f"d{'x' * (k % 7)}" for k in range(500))
    rows = [f"http://example.com/{same}/{'abcdefghijklmnopqrstuvwxy'[k]}" for k in range(25)]
    rows += ["http://b.net/fr/" + "/".join(f"{'abcdefghijklmnopqrstuvwxy'[k]}{'x' * (j % 5)}" for j in range(500)) for k in range(25)]
    rows += ["http://c.org/q" + "/q" * (440 + 3 * k) for k in range(40)]
    rows += [f"http://d.net/{'es' if k % 2 else 'x'}/a/b/{'p' if k % 3 else 'r.s'}/c/{k % 4}/e/{'uvw'[k % 3]}" for k in range(240)]
    rows += [f"http://e.net/{'es' if k % 2 else 'fr'}/*/{'*' if k % 3 else k}/$" for k in range(120)] + ["http://f.org", "http://f.org/", "http://f.org//", "http://f.org/a//b"] * 8
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "page_id long, url string")
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    bad = F.when(verdict == "block", 1).when(verdict == "allow", 0)
    start = time.monotonic()
    assert judge_urls(df.where("page_id < 50"), bad).count() == 50
    assert time.monotonic() - start < 30
    judged = judge_urls(df, bad).withColumn("rule", rule).withColumn("v", F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["v"]) for r in judged.collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.COM"), (5, "http://a.com?x=/y"), (6, "x://y://z/q"), (7, "http://WWW.Example.com/en/1#a/b"), (8, "http://example.com/en/"), (9, "http://xexample.com/en/"), (10, "http://net/es/1"), (11, "http://h\u00c9.net/\nfr/")]
    rows += [(100 + k, f"http://s.net/{'es' if k % 3 else 'en'}/a/b/c/d/e/f/g/{k}") for k in range(90)] + [(300 + k, f"http://t.org/{w}/{k}.html") for k in range(60) for w in ("x",)] + [(400, "http://t.org/" + "y/" * 5000)]
    rows += rows[20:22]  # repeated rows give repeated rows
    df = spark.createDataFrame([(i, u, "h", 0) for i, u in rows], "page_id long, url string, host string, n int")
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    judged = judge_urls(df, F.when(verdict == "block", 1).when(verdict == "allow", 0)).withColumn("rule", rule).withColumn("v", F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")))
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["v"]) for r in judged.collect()} == brute(rows)
    assert judged.count() == len(rows)
    assert judge_urls(df.where("false"), F.lit(None).cast("int")).count() == 0
