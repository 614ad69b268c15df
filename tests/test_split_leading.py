from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echosieve.operators import leading as L
from echosieve.operators import templates as P
from echosieve.plans.pipeline import split_groups, split_models
from tests.test_leading import frags, kept


def test_split_models_count_no_group_whole(spark, monkeypatch):
    """Five templates a group, chosen as of all the group's, whose pairs are never dealt."""
    rows = kept(frags(spark, 600, 2))
    groups = split_groups(rows, 2, True)
    scope = ["group"]
    both = kept(rows.join(groups, "doc_id"))
    occ = P.occurrences(both, scope, table=kept)
    all_ = kept(P.dedup_templates(kept(P.ranked_templates(P.template_counts(occ, scope), scope)), occ, scope))
    lead = all_.withColumn("lead", F.row_number().over(W.partitionBy("group").orderBy("rank"))).where("lead <= 5")
    want = kept(P.model_probabilities(lead, occ, scope))
    best = P.soft_text(want, scope).join(lead.select("group", "model_rank", "count"), ["group", "model_rank"])
    first = F.row_number().over(W.partitionBy("soft_text").orderBy(F.desc("count"), "group", "model_rank"))
    best = best.withColumn("first", first).where("first = 1").withColumn("number", F.row_number().over(W.orderBy(F.desc("count"), "group", "model_rank")))
    want = want.join(best.select("group", "model_rank", "number"), ["group", "model_rank"])

    scopes, starts = [], P.frequent_starts
    monkeypatch.setattr(P, "frequent_starts", lambda f, s, *more: scopes.append(s) or starts(f, s, *more))
    monkeypatch.setattr(L, "FIRST", 40)
    got = split_models(rows, 2, True, kept)
    assert scope not in scopes
    text = lambda df, n: sorted(map(str, df.select(F.col(n).alias("m"), "length", "source_count", "pos", "token", "n", "prob").collect()))
    assert text(got, "model_rank") == text(want, "number") and got.count() > 50
