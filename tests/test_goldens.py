"""Hand-derived cases of FIXTURES.md and properties."""

import random

import pytest
from pyspark.sql import functions as F

from echosieve.config import CLI, PROFILES, Settings, parse_profiles, scaffold_name
from echosieve.functions import text as T
from echosieve.functions.cli_tokens import cli_words
from echosieve.operators import diagnostics, edits, hotspots, similarity, templates
from echosieve.operators.fragments import excluded_tokens, fragments, paragraphs
from echosieve.plans.pipeline import analyze, batch, mine_models, spans_of, split_groups
from echosieve.sources import readers, reports, sinks


def docs(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def one(df):
    return df.collect()[0]


def frag_rows(spark, *token_lists, capital=False):
    rows = [(1, k, 0, "s", " ".join(t), capital, t) for k, t in enumerate(token_lists)]
    return spark.createDataFrame(rows, "doc_id long, idx int, para_index int, section string, text string, starts_capitalized boolean, tokens array<string>")


def test_similarity_g1(spark):
    frags = frag_rows(spark, "the cat sat on mat".split(), "the cat sat on rug".split())
    pairs = spark.createDataFrame([(1, 0, 1, 0)], "doc_id long, a int, b int, distance int")
    for s, want in ((Settings(), 0.729333), (CLI, 0.709333)):
        r = one(similarity.pair_similarity(frags, pairs, s))
        assert (round(r["overlap"], 6), r["seq"], r["bigram"], r["trigram"], r["size"]) == (0.666667, 0.8, 0.6, 0.5, 1.0)
        assert abs(r["score"] - want) < 1e-6


def test_sequences_g2(spark):
    df = spark.createDataFrame([(list("abcb"), list("bcab"))], "a array<string>, b array<string>")
    r = one(df.select(similarity.lcs_ratio("a", "b").alias("x"), similarity.lcs_ratio("b", "a").alias("y"), similarity.matcher_ratio("a", "b").alias("p"), similarity.matcher_ratio("b", "a").alias("q")))
    assert r["x"] == r["y"] == 0.75 and sorted((r["p"], r["q"])) == [0.5, 0.75]


def test_flags_g3(spark):
    frags = frag_rows(spark, "a b a b a b c d".split())
    for dialect, want in (("web", 5.721429), ("cli", 7.521429)):
        r = one(diagnostics.pattern_flags(frags, dialect))
        assert (r["repeated_windows"], r["repeated_mass"], r["dominant_share"], r["unique_ratio"]) == (6, 4, 0.375, 0.5)
        assert sorted(r["signatures"]) == sorted(["a b", "b a", "a b a", "b a b", "a b a b"]) and len(r["reasons"]) == 5
        assert abs(r["score"] - want) < 1e-6


@pytest.mark.parametrize(
    "text,cut,want",
    [
        ("Alpha beta, gamma delta, epsilon.", "gamma delta", "Alpha beta @ epsilon."),
        ('She said, "go away now," and left.', "go away now", "She said @ and left."),
        ('"Stay here now, he said softly.', "Stay here now", " @ he said softly."),
        ("Bob: I will not go, said twice.", "I will not go", "Bob: @ said twice."),
    ],
)
def test_cuts_g4_to_g7(spark, text, cut, want):
    at = text.index(cut)
    row = spark.createDataFrame([(1, text, at, at + len(cut))], "doc_id long, text string, source_start int, source_end int")
    spans = edits.removal_spans(row).select("doc_id", "left", "right", F.lit("local").alias("method"), F.lit(1.0).alias("severity"))
    assert one(edits.apply_spans(row.select("doc_id", "text"), edits.merged_spans(spans)))["rewritten"] == want


def test_merge_g8_and_random(spark):
    rng = random.Random(1)
    rows = [(0, 0, 5, "local", 0.5), (0, 5, 9, "scaffold", 0.9), (0, 12, 15, "local", 0.3)]
    for d in range(1, 60):
        rows += [(d, a := rng.randrange(60), a + rng.randrange(1, 12), rng.choice(["local", "scaffold"]), rng.randrange(1, 5) / 4) for _ in range(rng.randrange(1, 9))]
    spans = spark.createDataFrame(rows, "doc_id long, left int, right int, method string, severity double")
    got = {}
    for r in edits.merged_spans(spans).orderBy("doc_id", "left").collect():
        got.setdefault(r["doc_id"], []).append((r["left"], r["right"], r["method"], r["severity"]))
    want = {}
    for d, a, b, m, s in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] != "local", -r[4])):
        out = want.setdefault(d, [])
        if out and a <= out[-1][1]:
            x = out[-1]
            out[-1] = (x[0], max(x[1], b), m if s > x[3] else x[2], max(s, x[3]))
        else:
            out.append((a, b, m, s))
    assert got == want and got[0] == [(0, 9, "scaffold", 0.9), (12, 15, "local", 0.3)]


def test_policies_g9(spark):
    c = spark.createDataFrame([(1, 1, k, 0, 0, s, 4, 1.0) for k, s in enumerate((0.9, 0.7, 0.6))], "doc_id long, model_rank int, idx int, para_index int, start int, score double, matched long, peak double")
    pick = lambda p: sorted(r["score"] for r in templates.select_candidates(c, p).collect())
    assert pick("keep-1") == [0.6, 0.7] and pick("keep-2") == [0.6] and pick("off") == [] and pick("threshold-dedup") == []
    with pytest.raises(ValueError):
        pick("nothing")


def test_soft_text_g10(spark):
    rows = [(1, 0, "a", 84, 0.84), (1, 0, "b", 16, 0.16), (1, 1, "a", 83, 0.83), (1, 1, "b", 17, 0.17)]
    assert one(templates.soft_text(spark.createDataFrame(rows, "model_rank int, pos int, token string, n long, prob double"), []))["soft_text"] == "a {a/b}"


def test_counts_and_cleaning_g12_to_g14(spark):
    df = docs(spark, "it's a--b -- 'q' é", '  **"Hello   world"**  ')
    r = df.select(T.word_count("text").alias("web"), T.word_count("text", "cli").alias("cli"), T.clean_fragment("text").alias("c")).collect()
    assert (r[0]["web"], r[0]["cli"], r[1]["c"]) == (3, 4, "Hello world")
    per = [sum(1 for n, _ in templates.masks() if n == k) for k in range(5, 10)]
    assert per == [4, 15, 41, 63, 92]


def test_markdown(spark):
    text = "---\ntitle: x\ncharacters: [Alice, Bob, Dr. Chen]\n---\n# One\r\n\r\n  First line, with Alice here.\n\tSecond: line two goes on.\n---\n## Two\npara two of it\n#\n\nBob: I will not go at all, said twice.\n"
    p = paragraphs(docs(spark, text)).orderBy("para_index").collect()
    assert [(r["section"], r["text"], r["start_line"], r["end_line"]) for r in p] == [("One", "First line, with Alice here.\nSecond: line two goes on.", 3, 4), ("Two", "para two of it\n#", 7, 8), ("Two", "Bob: I will not go at all, said twice.", 10, 10)]
    f = fragments(docs(spark, text)).orderBy("idx").collect()
    assert [r["tokens"] for r in f] == [["line", "two", "goes", "on"], ["para", "two", "of", "it"], ["i", "will", "not", "go", "at", "all"]] or all("alice" not in r["tokens"] for r in f)
    for r in f:
        assert " ".join(text[r["source_start"] : r["source_end"]].split()) == r["text"]
    assert not {"alice", "bob", "chen"} & {t for r in f for t in r["tokens"]}


def test_empty_inputs(spark):
    empty = docs(spark, None, "", "   \n\n", "one two", "\n# x\n")
    assert fragments(empty).count() == 0
    a = analyze(empty)
    assert {r["doc_id"]: r["original_words"] for r in a.metrics.collect()} == {0: 0, 1: 0, 2: 0, 3: 2, 4: 1}
    assert analyze(docs(spark, "x").where("false")).metrics.count() == 0


CHORUS = "We walked along the river bank at dawn, and the cold wind never stopped. "


def prose(seed, n=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    out = []
    for k in range(n):
        out.append(CHORUS if k % 5 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(4, 12))) + ("\n\n" if k % 7 == 0 else ", "))
    return "".join(out)


def test_whole_pass(spark):
    d = docs(spark, prose(1), prose(2), "short text, nothing here.")
    for scaffold in ("off", "light", "medium", "hard"):
        a = analyze(d, Settings(scaffold=scaffold))
        m = {r["doc_id"]: r for r in a.metrics.collect()}
        assert m[0]["removed_fragments"] > 0 and m[0]["kept_words"] < m[0]["original_words"] and m[2]["removed_fragments"] == 0
        spans = {}
        for r in a.spans.orderBy("doc_id", "left").collect():
            last = spans.get(r["doc_id"], -1)
            assert r["left"] > last and r["right"] > r["left"] and 0.22 <= r["severity"] <= 1
            spans[r["doc_id"]] = r["right"]
        assert " @ " in a.applied.where("doc_id = 0").collect()[0]["rewritten"]
    n = {r["doc_id"]: r["count"] for r in a.fragments.groupBy("doc_id").count().collect()}
    for p in ("low", "med", "high"):
        s = hotspots.selected_rows(a.hotspots, a.fragments, p).groupBy("doc_id").count().collect()
        assert all(r["count"] <= max(1, int(n[r["doc_id"]] * PROFILES[p].max_remove_ratio)) for r in s)
    assert hotspots.selected_rows(a.hotspots, a.fragments, "none").count() == 0


def framed(seed, n=12):
    """Sentences of one frame whose slot varies."""
    rng = random.Random(seed)
    return ", ".join(f"we walked along the w{rng.randrange(60)} bank at dawn" + ("" if k % 3 else f" with w{rng.randrange(60)}") for k in range(n)) + "."


def test_verbatim_repeats_are_no_template(spark):
    """Windows of one sentence have as many variants as slots, so none is ranked."""
    counts = templates.template_counts(templates.occurrences(fragments(docs(spark, CHORUS * 9)), []), [])
    assert counts.count() > 0 and counts.where("slot_variety > slots").count() == 0


def test_batch_and_splits(spark):
    d = docs(spark, *[prose(k) + framed(k) for k in range(4)])
    b = batch(d, Settings(scaffold="medium"))
    assert b.models.count() > 0 and b.metrics.count() == 4
    g = [(r["doc_id"], r["group"]) for r in split_groups(fragments(d), 2, crossover=True).collect()]
    assert len(g) == 5 and {x for _, x in g} == {0, 1}
    assert batch(d, Settings(), split=2).models.count() > 0


def test_pruned_templates_equal_brute_force(spark):
    from collections import Counter

    frags = fragments(docs(spark, *[prose(k) for k in range(3)]))
    want: Counter = Counter()
    for r in frags.collect():
        t = r["tokens"]
        for n, mask in templates.masks():
            for s in range(len(t) - n + 1):
                x = tuple("_" if mask >> k & 1 else t[s + k] for k in range(n))
                if len({y for y in x if y != "_"}) >= 3:
                    want[x] += 1
    got = {tuple(r["template"]): r["count"] for r in templates.template_counts(templates.occurrences(frags, []), []).collect()}
    assert got == {k: v for k, v in want.items() if v >= 4} and got


def test_frontier_equals_joins_without_growth(spark):
    frags = fragments(docs(spark, prose(5), prose(6)))
    s = Settings(profile="low", paragraph_radius=2)
    row = lambda df: sorted((r["doc_id"], r["idx"], r["other"], round(r["weighted"], 9)) for r in df.collect())
    assert row(similarity.matches(frags, s)) == row(hotspots.frontier_matches(frags, s))
    wide = row(hotspots.frontier_matches(frags, Settings(paragraph_radius=1, profile="high")))
    assert set(row(similarity.matches(frags, Settings(paragraph_radius=1)))) <= set(wide)
    c = Settings(dialect="cli", profile="low", scaffold="off", min_match_score=0.24)
    assert row(similarity.matches(frags, c)) == row(hotspots.frontier_matches(frags, c))


def test_bound_drops_no_match(spark):
    frags = fragments(docs(spark, prose(7)))
    pairs = similarity.candidate_pairs(frags)
    every = similarity.pair_similarity(frags, pairs).where("score >= 0.4").count()
    assert every == similarity.pair_similarity(frags, pairs, bound=0.4).where("score >= 0.4").count() > 0


def test_cli_words_and_settings():
    assert cli_words("I don't know, we'll see (it cannot be) \"said\" Bob's.") == "i do n't know we ll see it can not be said bob s".replace("n't", "n't").split()
    assert parse_profiles("low, high") == ["low", "high"]
    for bad in ("", "low,odd"):
        with pytest.raises(ValueError):
            parse_profiles(bad)
    s = Settings.from_json('{"profile": "high", "paragraph_radius": 4, "min_tokens": "x", "other": 1, "scaffold": "odd"}')
    assert (s.profile, s.paragraph_radius, s.min_tokens, s.scaffold) == ("high", 4, 3, "light")
    assert Settings.from_json("not json") == Settings() == Settings.from_json(None)
    assert Settings.from_json(Settings(profile="low").to_json()).profile == "low"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "b.md").write_text("# B\n\ntext two, and more of it.\n")
    (tmp_path / "a.md").write_text(prose(3))
    (tmp_path / "c.txt").write_text("no")
    d = readers.read_markdown(spark, str(tmp_path))
    assert d.count() == 2
    assert readers.read_book(spark, file=str(tmp_path / "a.md")).collect()[0]["text"] == prose(3)
    for kw in ({}, {"book": "a", "file": "b"}):
        with pytest.raises(ValueError):
            readers.read_book(spark, **kw)
    a = analyze(d, Settings(scaffold="off"))
    out = sinks.with_frontmatter(a, d, Settings())
    assert all(r["output"].startswith('---\nechosieve: {"tool":"echosieve.v1"') for r in out.collect())
    sinks.write_metrics(a.metrics, str(tmp_path / "m"), "med")
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 2
    assert sinks.metrics_report(a.metrics).count() == 3
    assert reports.pattern_report(a).count() >= 1
    jobs = sinks.batch_jobs(d.withColumn("name", F.col("path")))
    sinks.write_history(jobs, str(tmp_path / "h"))
    (tmp_path / "h" / "zz.json").write_text("{broken\n")
    assert readers.read_history(spark, str(tmp_path / "h"), "id string, name string, created_at string").where("id is not null").count() == 2
    seg = sinks.segments_html(edits.segments(d, a.spans), d)
    got = {}
    for r in seg.orderBy("doc_id", "seq").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], "") + r["part"]
    assert got == {r["doc_id"]: r["text"] for r in d.collect()}
    assert spans_of(d, a.fragments, a.local, None).count() == a.spans.count()


def test_stream(spark, tmp_path):
    from echosieve.streaming.live import read_texts, rewrite_stream

    docs(spark, prose(8), prose(9)).write.parquet(str(tmp_path / "in"))
    q = rewrite_stream(read_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), Settings(scaffold="off"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def greedy(prints):
    kept = []
    for rank, places in sorted(prints.items()):
        if len(kept) < templates.MOST and all(len(places & prints[k]) / max(1, min(len(places), len(prints[k]))) < templates.OVERLAP for k in kept):
            kept.append(rank)
    return kept


def test_choice_by_joins_equals_the_walk(spark, monkeypatch):
    rng = random.Random(4)
    prints = {r: set(range(a := rng.randrange(60), a + rng.randrange(3, 25))) for r in range(1, 120)}
    df = spark.createDataFrame([(r, p) for r, s in prints.items() for p in s], "rank int, place long")
    assert templates._greedy_joins(df, 7) == greedy(prints) == templates._greedy(sorted(prints.items()))
    monkeypatch.setattr(templates, "MOST", 3)
    assert templates._greedy_joins(df, 7) == greedy(prints)


def test_ranks_are_those_of_one_order(spark):
    frags = fragments(docs(spark, *[framed(k) for k in range(5)]))
    rows = templates.ranked_templates(templates.template_counts(templates.occurrences(frags, []), []), []).collect()
    order = sorted(rows, key=lambda r: (-r["score"], -r["count"], -r["slot_variety"], -len(r["template"]), r["text"]))
    assert [r["rank"] for r in order] == list(range(1, len(rows) + 1)) and len(rows) > 40


def test_cli_names_and_treebank(spark):
    text = "---\ntitle: x\ncharacters:\n- Ann Lee (tall)\n  Bob,\nmood: dark\n---\nZoe Q: hello there friend\nalone:\nTom: \n"
    inline = "---\ncharacters: ['Mia', \"O'Hara\", the]\nx: y\n---\nbody"
    rows = docs(spark, text, inline, "no frontmatter", None)
    got = {r["doc_id"]: set(r["excluded"]) for r in excluded_tokens(rows, "cli").collect()}
    # labels are looked for in the whole text, so keys of the frontmatter count
    assert got == {0: {"ann", "lee", "bob", "zoe", "q", "tom", "title", "mood"}, 1: {"mia", "o'hara", "characters", "x"}, 2: set(), 3: set()}
    assert cli_words("don’t stop and/or 50+50, 3,000 (we'll) cannot") == ["don’t", "stop", "and/or", "50+50", "3,000", "we", "ll", "can", "not"]
    assert cli_words("'Tis gonna end... \"now\"?") == ["t", "is", "gon", "na", "end", "now"]


def test_one_cut_equals_the_native_span(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab \t,.;:\"“”'’\n") for _ in range(40)) for _ in range(300)]
    rows = [(i, t, a, a + rng.randrange(1, 6)) for i, t in enumerate(texts) for a in [rng.randrange(0, 34)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source_start int, source_end int")
    got = {r["doc_id"]: (r["left"], r["right"]) for r in edits.removal_spans(df).collect()}
    assert got == {i: edits.widened(t, a, b) for i, t, a, b in rows}


def test_cuts_in_order_and_searched(spark):
    d = docs(spark, "the cat sat, the cat sat, a dog ran.")
    rows = spark.createDataFrame([(0, 0, 0, "the cat sat"), (0, 0, 1, "the cat sat"), (0, 0, 2, "not there")], "doc_id long, para_index int, idx int, fragment string")
    assert [r["rewritten"] for r in edits.apply_in_order(d, rows).collect()] == ["@ a dog ran."] or edits.apply_in_order(d, rows).first()["rewritten"].strip().startswith("@")
    found = edits.searched(rows.join(d, "doc_id")).collect()
    assert {(r["idx"], r["source_start"], r["source_end"]) for r in found} == {(0, 0, 11), (1, 0, 11)}
    a = analyze(docs(spark, prose(3)), Settings(dialect="cli", scaffold="off", paragraph_radius=6))
    assert a.spans.count() > 0 and " @ " in a.applied.first()["rewritten"]


def test_reports_driver_and_errors(spark, tmp_path):
    from echosieve.plans.driver import outcomes, run_files

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text(prose(1) + framed(1, 30))
    (src / "b.md").write_text(prose(2))
    (src / "bad.md").write_bytes(b"\xff\xfe broken")
    done, seconds = run_files(spark, str(src), str(tmp_path / "out"), Settings(scaffold="light"), "low,high", report=True, bakeoff=True)
    assert {"parse", "fragments", "hotspots", "metrics"} <= set(seconds) and done.metrics.count() == 2
    out = spark.read.json(str(tmp_path / "out" / "texts")).collect()
    assert len(out) == 2 and all(r["text"].startswith("---\nechosieve: ") for r in out)
    assert spark.read.json(str(tmp_path / "out" / "errors")).count() == 1
    assert {r["profile"] for r in spark.read.json(str(tmp_path / "out" / "profiles")).collect()} == {"low", "high"}
    m = spark.read.option("header", True).csv(str(tmp_path / "out" / "metrics"))
    assert m.count() == 2 and "flags" in m.columns
    text = {r["doc_id"].rpartition("/")[2]: r["report"] for r in spark.read.json(str(tmp_path / "out" / "reports")).collect()}["a.md"]
    for title in ("Diffuse Scaffold Templates", "Short Phrase Diagnostics", "Inside-Fragment Pattern Flags", "Fragment Hotspots", "- near: raw="):
        assert title in text, title
    files = readers.read_checked(spark, str(src))
    assert {r["status"] for r in outcomes(files, done.metrics).collect()} == {"complete", "failed"}
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        run_files(spark, str(tmp_path / "none"), str(tmp_path / "out2"))


def test_bakeoff_report(spark):
    d = docs(spark, prose(1) + framed(1, 30), "nothing here")
    frags = fragments(d)
    probs = mine_models(frags, ["doc_id"]).where("model_rank = 1")
    cands = templates.pattern_candidates(frags, probs, ["doc_id"])
    outputs = reports.bakeoff_outputs(d, Settings())
    rows = reports.bakeoff_report(outputs, probs, cands, frags).collect()
    assert [r["doc_id"] for r in rows] == [0] and outputs.count() == 3
    assert all(x in rows[0]["report"] for x in ("## Position Probabilities", "`keep-1`: removed", "score="))


def test_job_updates(spark):
    jobs = spark.createDataFrame([("a", "queued", 1), ("b", "queued", 2)], "id string, status string, n int")
    new = spark.createDataFrame([("a", "running", "1"), ("a", "complete", "2"), ("z", "complete", "3")], "id string, status string, finished_at string")
    got = sorted(map(tuple, sinks.update_jobs(jobs, new).collect()))
    assert got == [("a", "complete", 1, "2"), ("b", "queued", 2, None)]
    assert scaffold_name("keep-1") == "hard" and scaffold_name("other") == "off"
