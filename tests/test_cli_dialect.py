from echosieve.__main__ import arguments
from echosieve.config import CLI, WEB
from echosieve.operators import diagnostics as D
from echosieve.plans import pipeline


def test_defaults_follow_the_dialect():
    web, cli = arguments(["a", "b"]), arguments(["a", "b", "--dialect", "cli"])
    assert (web.scaffold, web.paragraph_radius, web.min_match_score) == (WEB.scaffold, WEB.paragraph_radius, WEB.min_match_score) == ("light", 12, 0.2)
    assert (cli.scaffold, cli.paragraph_radius, cli.min_match_score) == (CLI.scaffold, CLI.paragraph_radius, CLI.min_match_score) == ("off", 6, 0.24)
    given = arguments(["a", "b", "--dialect", "cli", "--paragraph-radius", "9", "--min-shared-content", "2", "--max-candidates-per-token", "7"])
    assert (given.paragraph_radius, given.min_shared, given.max_candidates_per_token, given.min_tokens) == (9, 2, 7, 3)


def test_cli_compares_badness_with_scores_as_they_are(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma, delta.")], "doc_id long, text string")
    frags = spark.createDataFrame([(1, 0, 0, 16, "Alpha beta gamma"), (1, 1, 11, 16, "gamma")], "doc_id long, idx int, source_start int, source_end int, text string")
    for badness, score, method in ((0.3, 0.9, "scaffold"), (2.5, 0.9, "local"), (0.9, 0.9, "local")):
        local = spark.createDataFrame([(1, 0, badness)], "doc_id long, idx int, badness double")
        scaffold = spark.createDataFrame([(1, 1, score)], "doc_id long, idx int, score double")
        out = pipeline.spans_of(docs, frags, local, scaffold, "cli").collect()
        assert [(r["method"], r["severity"]) for r in out] == [(method, max(badness, score))]
        web = pipeline.spans_of(docs, frags, local, scaffold, "web").collect()
        assert [(r["method"], r["severity"]) for r in web] == [("local", 1.0)]  # the only ones of their method


def test_flags_of_equal_scores(spark):
    rows = [(1, 0, 0, 2.0, 0.1), (1, 1, 0, 2.0, 0.3), (1, 2, 1, 2.0, 0.1), (1, 3, 1, 3.0, 0.0), (1, 4, 1, 2.0, 0.1)]
    flags = spark.createDataFrame(rows, "doc_id long, idx int, para_index int, score double, repeat_density double")
    order = lambda dialect: [r["idx"] for r in D.top_flags(flags, 9, dialect).orderBy("place").collect()]
    assert order("web") == [3, 1, 0, 2, 4] and order("cli") == [3, 1, 4, 2, 0]


def test_words_are_counted_a_text_at_a_time():
    import tracemalloc

    import pandas as pd

    from echosieve.functions.cli_tokens import _cli_count

    texts = pd.Series(["it can't be, said w%d. " % k * 400 for k in range(60)] + [None, ""])
    tracemalloc.start()
    counts = _cli_count.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [2400] * 60 + [0, 0]
    assert peak < 2_000_000  # all 144,000 tokens at once take more than 8 MB
