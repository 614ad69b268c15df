from itertools import product

from echosieve.operators import templates as P

SCHEMA = "doc_id long, idx int, section string, tokens array<string>"


def test_windows_need_four_tokens_that_repeat(spark):
    # every pair with the first token stands 27 times, every four tokens three times at most
    rows = [(1, k, "s", ["a", *[f"{x}{i}" for i, x in enumerate(t)]]) for k, t in enumerate(product("xyz", repeat=4))]
    assert P.occurrences(spark.createDataFrame(rows, SCHEMA), []).count() == 0
    more = [(2, k, "s", ["b", "c", "d", "e", f"f{k}"]) for k in range(4)]
    got = P.occurrences(spark.createDataFrame(rows + more, SCHEMA), []).collect()
    assert {(r["doc_id"], " ".join(r["template"])) for r in got} == {(2, "b c d e _")} and len(got) == 4


def test_filters_stay_out_of_the_join_with_masks(spark):
    rows = spark.createDataFrame([(1, 0, "s", list("abcde"))], SCHEMA)
    plan = P.template_counts(P.occurrences(rows, []), [])._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x and "need#" in x]
    assert joins and not any("array_distinct" in x or "lambda" in x for x in joins)
