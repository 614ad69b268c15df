"""The whole repetition pass over a corpus, and its batch form with a shared model.

analyze() returns a lazy DataFrame for every stage; what several stages read can be
written once with `table`, a function (DataFrame, name) -> DataFrame, for instance one
that checkpoints. Nothing loops over documents on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echosieve.config import PROFILES, Settings
from echosieve.functions.cli_tokens import cli_tokenizer
from echosieve.operators import diagnostics, edits, hotspots, templates
from echosieve.operators.fragments import fragments
from echosieve.operators.leading import leading


def _window(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


@dataclass
class Analysis:
    fragments: DataFrame
    hotspots: DataFrame
    local: DataFrame
    flags: DataFrame
    models: DataFrame | None
    candidates: DataFrame | None
    scaffold: DataFrame | None
    spans: DataFrame
    applied: DataFrame
    metrics: DataFrame


def fragment_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    return fragments(docs, settings, cli_tokenizer if settings.dialect == "cli" else None)


def mine_models(frags: DataFrame, scope: list[str], table: Callable = lambda df, name: df) -> DataFrame:
    """Model probabilities of a scope: ["doc_id"] for each document's own, [] for the corpus's."""
    if not scope:
        chosen, occ = leading(frags, table)
        return templates.model_probabilities(chosen, occ, scope)
    occ = templates.occurrences(frags, scope, table=table)
    ranked = table(templates.ranked_templates(table(templates.template_counts(occ, scope), "counts"), scope), "ranked")
    chosen = table(templates.dedup_templates(ranked, occ, scope), "chosen")
    return templates.model_probabilities(chosen, occ, scope)


def spans_of(docs: DataFrame, frags: DataFrame, local: DataFrame, scaffold: DataFrame | None, dialect: str = "web") -> DataFrame:
    """Merged spans of the local and the scaffold removals. In the cli dialect a fragment is
    cut at its first place in the text, and not at all where it doesn't stand as it is."""
    rows = local.select("doc_id", "idx", F.lit("local").alias("method"), F.col("badness").alias("score"))
    if scaffold is not None:
        rows = rows.unionByName(scaffold.select("doc_id", "idx", F.lit("scaffold").alias("method"), "score"))
    if dialect == "cli":
        rows = rows.join(frags.select("doc_id", "idx", F.col("text").alias("fragment")), ["doc_id", "idx"]).join(docs.select("doc_id", "text"), "doc_id")
        rows = edits.searched(rows).withColumn("severity", F.col("score"))  # badness and score as they are
    else:
        rows = edits.severity(rows).join(frags.select("doc_id", "idx", "source_start", "source_end"), ["doc_id", "idx"]).join(docs.select("doc_id", "text"), "doc_id")
    spans = edits.removal_spans(rows)
    return edits.merged_spans(spans.select("doc_id", "left", "right", "method", "severity"))


def analyze(docs: DataFrame, settings: Settings = Settings(), expansion_rounds: int | None = None, models: DataFrame | None = None, table: Callable = lambda df, name: df) -> Analysis:
    """docs(doc_id, text). `models` are shared model probabilities (no doc_id); without
    them every document mines its own."""
    frags = table(fragment_rows(docs, settings), "fragments")
    hot = table(hotspots.hotspots(frags, settings, expansion_rounds), "hotspots")
    local = hotspots.selected_rows(hot, frags, PROFILES[settings.profile], settings.dialect)
    flags = diagnostics.pattern_flags(frags, settings.dialect)
    candidates = scaffold = None
    if settings.policy != "off":
        scope = ["doc_id"] if models is None else []
        models = mine_models(frags, scope, table) if models is None else models
        candidates = table(templates.pattern_candidates(frags, models, scope, settings.pattern_min_score), "candidates")
        scaffold = templates.cascade(templates.select_candidates(candidates, settings.policy))
    spans = table(spans_of(docs, frags, local, scaffold, settings.dialect), "spans")
    applied = edits.apply_spans(docs, spans)
    metrics = edits.document_metrics(applied, spans, frags, hot, settings.dialect)
    return Analysis(frags, hot, local, flags, models, candidates, scaffold, spans, applied, metrics)


def batch(docs: DataFrame, settings: Settings = Settings(), split: int = 0, crossover: bool = False, table: Callable = lambda df, name: df) -> Analysis:
    """All documents with models mined from the whole corpus, or, with split of 2 or
    more, from token-balanced groups of documents."""
    frags = table(fragment_rows(docs, settings), "batch-fragments")
    models = mine_models(frags, [], table) if split < 2 else split_models(frags, split, crossover, table)
    return analyze(docs, settings, models=models, table=table)


def split_groups(frags: DataFrame, groups: int, crossover: bool = False) -> DataFrame:
    """(doc_id, group): documents in order go to the group with the fewest tokens, the
    first of equal ones; with crossover a group also gets the last of the one before.
    The order decides, so one task walks the documents; it holds a number for each group."""
    sizes = frags.groupBy("doc_id").agg(F.sum(F.size("tokens")).alias("n")).select("doc_id", "n")
    schema = f"doc_id {frags.schema['doc_id'].dataType.simpleString()}, group int"

    def walk(batches):
        totals, last = [0] * groups, [None] * groups
        for pdf in batches:
            out = []
            for doc, n in zip(pdf["doc_id"], pdf["n"]):
                g = totals.index(min(totals))
                totals[g] += n
                last[g] = doc
                out.append(g)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "group": out})
        if crossover:
            more = [(last[g - 1], g) for g in range(1, groups) if last[g - 1] is not None]
            yield pd.DataFrame(more, columns=["doc_id", "group"])

    return sizes.repartition(1).sortWithinPartitions("doc_id").mapInPandas(walk, schema)


def split_models(frags: DataFrame, groups: int, crossover: bool = False, table: Callable = lambda df, name: df, top: int = 5) -> DataFrame:
    """Model probabilities of the five leading templates of every group, the first of
    equal soft texts by count."""
    rows = frags.select("doc_id", "idx", "section", "tokens").join(split_groups(frags, groups, crossover), "doc_id")
    rows = table(rows, "split-fragments")
    scope = ["group"]
    # no later template changes which are chosen first, so no more than these are looked for
    mined = [(g, *leading(rows.where(F.col("group") == g).drop("group"), lambda df, name: table(df, f"split-{name}"), top)) for g in range(groups)]
    within = lambda df, g: df.withColumn("group", F.lit(g))
    chosen = reduce(DataFrame.unionByName, [within(c, g) for g, c, _ in mined])
    probs = reduce(DataFrame.unionByName, [within(templates.model_probabilities(c, occ, []), g) for g, c, occ in mined])
    probs = table(probs, "split-probabilities")
    soft = templates.soft_text(probs, scope).join(chosen.select("group", "model_rank", "count"), ["group", "model_rank"])
    first = F.row_number().over(_window(["soft_text"], [F.desc("count"), "group", "model_rank"]))
    soft = soft.withColumn("first", first).where("first = 1")
    number = F.row_number().over(_window([F.lit(0)], [F.desc("count"), "group", "model_rank"]))
    soft = soft.withColumn("number", number).select("group", "model_rank", "number")
    return probs.join(F.broadcast(soft), ["group", "model_rank"]).drop("group", "model_rank").withColumnRenamed("number", "model_rank")
