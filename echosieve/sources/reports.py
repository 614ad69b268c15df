"""Reports as text: what repeats in a document, and how policies compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echosieve.config import Settings
from echosieve.functions.text import snippet, word_count
from echosieve.operators import diagnostics, edits, hotspots, similarity, templates

POLICIES = ("keep-1", "keep-2", "threshold-dedup")


def _lines(rows: DataFrame, keys: list[str], order: list[Column], line: Column, name: str, sep: str = "\n") -> DataFrame:
    """(keys…, name): the lines of a group in order, joined."""
    pair = F.struct(*[c.alias(f"k{k}") for k, c in enumerate(order)], line.alias("line"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["line"]), sep).alias(name))


def _counted(rows: DataFrame, what: str, top: int, name: str) -> DataFrame:
    """(doc_id, name): a document's most frequent values of an array column with counts."""
    n = rows.select("doc_id", F.explode(what).alias("v")).groupBy("doc_id", "v").agg(F.count("*").alias("n"))
    all_of = _lines(n, ["doc_id"], [-F.col("n"), F.col("v")], F.format_string("`%s` (%d)", "v", "n"), name, "\x1f")
    return all_of.withColumn(name, F.array_join(F.slice(F.split(name, "\x1f"), 1, top), ", "))


def pattern_report(done, settings: Settings = Settings(), top: int = 40, probs: DataFrame | None = None) -> DataFrame:
    """(doc_id, report): counts, templates (of `probs`, own or shared models), phrases, reasons
    and repeated windows, flags, and hotspots with their five best matches, the worst first."""
    frags, hot, d = done.fragments, done.hotspots, settings.dialect
    probs = done.models if probs is None else probs
    parts = frags.groupBy("doc_id").agg(F.count("*").alias("n_fragments")).join(hot.groupBy("doc_id").agg(F.count("*").alias("n_hot")), "doc_id", "left")
    texts = []
    if probs is not None:
        scope = ["doc_id"] if "doc_id" in probs.columns else []
        five = templates.top_tokens(probs, scope)
        cells = _lines(five, [*scope, "model_rank", "pos"], [F.col("place")], F.format_string("`%s` (%d)", "token", "n"), "cell", ", ")
        cells = _lines(cells, [*scope, "model_rank"], [F.col("pos")], F.concat((F.col("pos") + 1).cast("string"), F.lit(": "), "cell"), "cells", "; ")
        facts = probs.groupBy(*scope, "model_rank").agg(F.max("source_count").alias("hits"), F.count("*").alias("variants"))
        rows = templates.soft_text(probs, scope).join(facts, [*scope, "model_rank"]).join(cells, [*scope, "model_rank"])
        line = F.format_string("### %d. `%s` (%d hits, %d positional variants)\n- positions: %s\n", "model_rank", "soft_text", "hits", "variants", "cells")
        texts.append(("Diffuse Scaffold Templates", _lines(rows, scope, [F.col("model_rank")], line, "templates"), "templates"))
    grams = diagnostics.phrases("tokens") if d == "web" else F.array_distinct(diagnostics.phrases("tokens"))
    phrases = hot.select("doc_id", F.explode(grams).alias("v")).groupBy("doc_id", "v").agg(F.count("*").alias("n")).where("n >= 4")
    phrases = _lines(phrases, ["doc_id"], [-F.col("n"), F.col("v")], F.format_string("`%s` (%d)", "v", "n"), "phrases", "\x1f")
    texts.append(("Short Phrase Diagnostics", phrases.withColumn("phrases", F.array_join(F.slice(F.split("phrases", "\x1f"), 1, 40 if d == "web" else 30), ", ")), "phrases"))
    texts.append(("Diagnostic Pattern Summary", _counted(done.flags, "reasons", 20, "reasons"), "reasons"))
    texts.append(("Most Repeated Windows", _counted(done.flags, "signatures", 30, "windows"), "windows"))
    shape = F.format_string("- shape: repeat=%.2f, reuse=%d, diversity=%.2f, dominant=%.2f", "repeat_density", "repeated_mass", "unique_ratio", "dominant_share")
    sample = F.when(F.size("signatures") > 0, F.concat(F.lit("\n- repeated windows: "), F.array_join(F.transform(F.slice("signatures", 1, 6), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", "))).otherwise("")
    flag = F.concat(F.format_string("### %d. `%s` (%s)\n", "place", "section", F.array_join("reasons", ", ")), shape, F.lit("\n- fragment: "), snippet("text"), sample, F.lit("\n"))
    texts.append(("Inside-Fragment Pattern Flags", _lines(diagnostics.top_flags(done.flags, top, settings.dialect), ["doc_id"], [F.col("place")], flag, "flags"), "flags"))
    worst = hotspots.top_hotspots(hot, top, d)
    # only the pairs that are shown are compared in detail
    found = hotspots.frontier_matches(frags.join(worst.select("doc_id").distinct(), "doc_id", "left_semi"), settings)
    shown = hotspots.top_matches(found.join(worst.select("doc_id", "idx"), ["doc_id", "idx"], "left_semi")).select("doc_id", "idx", "other", "place", "distance")
    pairs = similarity.pair_similarity(frags, shown.select("doc_id", F.col("idx").alias("a"), F.col("other").alias("b"), "distance").distinct(), settings).withColumnsRenamed({"a": "idx", "b": "other"})
    near = shown.drop("distance").join(pairs.select("doc_id", "idx", "other", "overlap", "seq", "bigram"), ["doc_id", "idx", "other"]).join(frags.select("doc_id", F.col("idx").alias("other"), F.col("text").alias("other_text")), ["doc_id", "other"])
    near = _lines(near, ["doc_id", "idx"], [F.col("place")], F.concat(F.format_string("- near: raw=%.2f seq=%.2f bi=%.2f: ", "overlap", "seq", "bigram"), snippet("other_text", 150)), "near")
    head = F.format_string("### %d. `%s` (%d near matches, %s)\n- shape: reusable=%d, unique=%d, reuse=%.2f\n- fragment: ", "place", "section", "match_count", "hint", "reusable", "unique", "reusable_ratio")
    worst = worst.join(near, ["doc_id", "idx"], "left")
    line = F.concat(head, snippet("text"), F.coalesce(F.concat(F.lit("\n"), "near"), F.lit("")), F.lit("\n"))
    texts.append(("Fragment Hotspots", _lines(worst, ["doc_id"], [F.col("place")], line, "hot"), "hot"))
    out = F.concat(F.format_string("# Repetition Hotspots: %s\n\n- fragments: %d\n- fragments with local near-matches: %d\n", F.col("doc_id").cast("string"), "n_fragments", F.coalesce("n_hot", F.lit(0))))
    for title, rows, name in texts:
        parts = parts.join(rows, "doc_id", "left") if "doc_id" in rows.columns else parts.join(F.broadcast(rows))  # one row
        out = F.concat(out, F.lit(f"\n## {title}\n\n"), F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit("_none_")), F.lit("\n"))
    return parts.select("doc_id", out.alias("report"))


def bakeoff_outputs(docs: DataFrame, settings: Settings, table: Callable = lambda df, name: df) -> DataFrame:
    """(doc_id, policy, rewritten, candidate_count, removed_fragments, original_words, kept_words,
    stripped_words, marker_count): every document under every policy for its leading model.
    Documents without a model give no row."""
    from echosieve.plans.pipeline import fragment_rows, mine_models, spans_of

    frags = table(fragment_rows(docs, settings), "bakeoff-fragments")
    model = table(mine_models(frags, ["doc_id"], table).where("model_rank = 1"), "bakeoff-models")
    cands = table(templates.pattern_candidates(frags, model, ["doc_id"], settings.pattern_min_score), "bakeoff-candidates")
    own = docs.join(model.select("doc_id").distinct(), "doc_id", "left_semi")
    none = frags.select("doc_id", "idx", F.lit(0.0).alias("badness")).where("false")
    counts = cands.groupBy("doc_id").agg(F.count("*").alias("candidate_count"))
    out = None
    for policy in POLICIES:
        picked = templates.select_candidates(cands, policy)
        if settings.dialect == "cli":
            rows = picked.select("doc_id", "idx").join(frags.select("doc_id", "idx", "para_index", F.col("text").alias("fragment")), ["doc_id", "idx"])
            done = edits.apply_in_order(own, rows)
        else:
            done = edits.apply_spans(own, spans_of(own, frags, none, picked))
        n = picked.groupBy("doc_id").agg(F.countDistinct("idx").alias("removed_fragments"))
        words = lambda c: word_count(c, settings.dialect)
        rows = done.join(counts, "doc_id", "left").join(n, "doc_id", "left").select("doc_id", F.lit(policy).alias("policy"), "rewritten", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.coalesce("removed_fragments", F.lit(0)).alias("removed_fragments"), words("text").alias("original_words"), words("rewritten").alias("kept_words"), F.regexp_count("rewritten", F.lit("@")).alias("marker_count"))
        rows = rows.withColumn("stripped_words", F.greatest(F.lit(0), F.col("original_words") - F.col("kept_words")))
        out = rows if out is None else out.unionByName(rows)
    return out


def bakeoff_report(outputs: DataFrame, probs: DataFrame, cands: DataFrame, frags: DataFrame) -> DataFrame:
    """(doc_id, report): the leading model with its ten likeliest tokens a position, what each
    policy removed, and the twenty best candidates."""
    own = ["doc_id"]
    ten = templates.top_tokens(probs, own, 10)
    cells = _lines(ten, ["doc_id", "pos"], [F.col("place")], F.format_string("`%s` %.2f%% (%d)", "token", F.col("prob") * 100, "n"), "cell", ", ")
    cells = _lines(cells, own, [F.col("pos")], F.concat(F.lit("- "), (F.col("pos") + 1).cast("string"), F.lit(": "), "cell"), "cells")
    model = templates.soft_text(probs, own).select("doc_id", "soft_text").join(probs.groupBy("doc_id").agg(F.max("source_count").alias("hits")), "doc_id")
    results = _lines(outputs, own, [F.col("policy")], F.format_string("- `%s`: removed %d fragments, stripped %d words, markers %d", "policy", "removed_fragments", "stripped_words", "marker_count"), "results")
    best = templates.top_candidates(cands).join(frags.select("doc_id", "idx", "section", "text"), ["doc_id", "idx"])
    best = _lines(best, own, [F.col("place")], F.concat(F.format_string("- score=%.3f, matched=%d, `%s`: ", "score", "matched", "section"), snippet("text", 180)), "best")
    rows = model.join(cells, "doc_id").join(results, "doc_id", "left").join(best, "doc_id", "left")
    return rows.select("doc_id", F.concat(F.format_string("# Pattern Bakeoff: %s\n\n- model: `%s`\n- source template hits: %d\n\n## Position Probabilities\n\n", F.col("doc_id").cast("string"), "soft_text", "hits"), "cells", F.lit("\n\n## Outputs\n\n"), F.coalesce("results", F.lit("_none_")), F.lit("\n\n## Top Candidate Examples\n\n"), F.coalesce("best", F.lit("_none_")), F.lit("\n")).alias("report"))
