"""Sinks and the rows they write: rewritten texts, metrics, reports, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echosieve.config import HISTORY_LIMIT, MODE, TOOL, Settings
from echosieve.functions.text import word_count
from echosieve.operators import edits, hotspots, templates


def export_name(name, profile: str, scaffold: str = "off") -> Column:
    """x.md becomes x.profile[.scaffold].md."""
    tail = f".{profile}" + (f".{scaffold}" if scaffold != "off" else "") + ".md"
    return F.concat(F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\.md$", ""), F.lit(tail))


def batch_jobs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, name) as queued jobs; the id holds the hash, the time and a random part."""
    sha = F.sha2("text", 256)
    made = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    job = F.concat_ws("-", F.left(sha, F.lit(12)), made, F.left(F.uuid(), F.lit(6)))
    return docs.select("doc_id", job.alias("id"), "name", F.length("text").cast("long").alias("size"), sha.alias("hash"), "text", made.alias("created_at"), F.lit("queued").alias("status"), F.lit(0.0).alias("progress"), F.lit("pending").alias("download_status"))


def update_jobs(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """jobs with the columns of updates(id, …) where an update has their id and a value;
    updates of unknown ids are ignored, and of several for one id the last by finished_at counts."""
    names = [c for c in updates.columns if c != "id"]
    if "finished_at" in names:
        updates = updates.groupBy("id").agg(*[F.max_by(c, "finished_at").alias(c) for c in names])
    new = updates.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in names])
    rows = jobs.join(new, jobs["id"] == new["_id"], "left")
    kept = [F.coalesce(F.col(f"_{c}"), jobs[c]).alias(c) if c in names else jobs[c] for c in jobs.columns]
    return rows.select(*kept, *[F.col(f"_{c}").alias(c) for c in names if c not in jobs.columns])


def history_rows(jobs: DataFrame) -> DataFrame:
    return jobs.drop("text", "rewritten", "result")


def write_history(jobs: DataFrame, path: str) -> None:
    history_rows(jobs).orderBy(F.desc("created_at")).limit(HISTORY_LIMIT).write.mode("overwrite").json(path)


def batch_totals(metrics: DataFrame) -> DataFrame:
    total = lambda c: F.sum(c).cast("long")
    rows = metrics.agg(F.count("*").alias("files"), *[total(c).alias(c) for c in ("original_words", "kept_words", "stripped_words")], total("removed_fragments").alias("removed"))
    return rows.withColumn("kept_pct", F.round(F.col("kept_words") / F.greatest(F.lit(1), F.col("original_words")) * 100, 6))


def with_frontmatter(analysis, docs: DataFrame, settings: Settings, processed_at: str | None = None) -> DataFrame:
    """(doc_id, output): the rewritten text behind a block that says how it was made;
    processed_at is now unless given."""
    m = analysis.metrics
    rows = analysis.applied.join(m, "doc_id")
    payload = F.struct(
        F.lit(TOOL).alias("tool"),
        F.lit(MODE).alias("mode"),
        F.col("doc_id").cast("string").alias("file"),
        F.sha2("text", 256).alias("input_sha256"),
        (F.lit(processed_at) if processed_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("processed_at"),
        F.lit(settings.profile).alias("local_pass"),
        F.lit(settings.scaffold).alias("scaffold_pass"),
        F.lit(settings.to_json()).alias("settings"),
        F.struct(F.col("original_words").alias("original"), F.col("kept_words").alias("kept"), F.col("stripped_words").alias("stripped")).alias("words"),
        F.struct(F.col("local_removed").alias("local"), F.col("scaffold_removed").alias("scaffold"), F.col("removed_fragments").alias("total")).alias("removals"),
    )
    return rows.select("doc_id", F.concat(F.lit("---\nechosieve: "), F.to_json(payload), F.lit("\n---\n\n"), "rewritten").alias("output"))


def write_texts(rows: DataFrame, path: str, text_col: str = "output", by: list[str] = (), most: int = 10_000) -> None:
    """Texts as JSON lines of (doc_id, text), at most so many a file, one folder for each value
    of the few-valued columns `by`; a text keeps its line ends."""
    out = rows.select("doc_id", *by, F.col(text_col).alias("text")).write.mode("overwrite").option("maxRecordsPerFile", most)
    (out.partitionBy(*by) if by else out).json(path)


def refloors(docs: DataFrame, frags: DataFrame, hot: DataFrame, profiles: list[str], dialect: str = "web") -> DataFrame:
    """(doc_id, profile, rewritten, removed_fragments, original_words, kept_words,
    stripped_words, kept_pct): every document under every profile's local removals."""
    out = None
    for name in profiles:
        picked = hotspots.selected_rows(hot, frags, name, dialect)
        rows = picked.join(frags.select("doc_id", "idx", "para_index", F.col("text").alias("fragment"), "source_start", "source_end"), ["doc_id", "idx"])
        if dialect == "cli":
            done = edits.apply_in_order(docs, rows)
        else:
            spans = edits.removal_spans(rows.drop("fragment").join(docs.select("doc_id", "text"), "doc_id"))
            graded = edits.severity(spans.withColumn("method", F.lit("local")), "badness")
            done = edits.apply_spans(docs, edits.merged_spans(graded.select("doc_id", "left", "right", "method", "severity")))
        n = picked.groupBy("doc_id").agg(F.count("*").alias("removed_fragments"))
        words = lambda c: word_count(c, dialect)
        done = done.join(n, "doc_id", "left").select("doc_id", F.lit(name).alias("profile"), "rewritten", F.coalesce("removed_fragments", F.lit(0)).alias("removed_fragments"), words("text").alias("original_words"), words("rewritten").alias("kept_words"))
        done = done.withColumn("stripped_words", F.greatest(F.lit(0), F.col("original_words") - F.col("kept_words"))).withColumn("kept_pct", F.round(F.col("kept_words") / F.greatest(F.lit(1), F.col("original_words")) * 100, 6))
        out = done if out is None else out.unionByName(done)
    return out


def write_metrics(metrics: DataFrame, path: str, profile: str | None = None, flags: DataFrame | None = None) -> None:
    """The metrics as CSV, percentages with two places; metrics of several profiles have a
    profile column. With flags, the number of a document's flagged fragments too."""
    if profile is not None:
        metrics = metrics.withColumn("profile", F.lit(profile))
    if flags is not None:
        metrics = metrics.join(flags.groupBy("doc_id").agg(F.count("*").alias("flags")), "doc_id", "left").fillna(0, ["flags"])
    more = {"local_removed": "local", "scaffold_removed": "scaffold", "fragments": "fragments", "flags": "flags"}
    rows = metrics.select(F.col("doc_id").alias("file"), "profile", "original_words", "kept_words", "stripped_words", F.format_string("%.2f", "kept_pct").alias("kept_pct"), "removed_fragments", *[F.col(c).alias(n) for c, n in more.items() if c in metrics.columns])
    rows.write.mode("overwrite").option("header", True).csv(path)


def metrics_report(metrics: DataFrame) -> DataFrame:
    """(line): the per-file lines and the totals in markdown."""
    line = F.format_string("| %s | %d | %d | %d | %.2f%% | %d |", F.col("doc_id").cast("string"), "original_words", "kept_words", "stripped_words", "kept_pct", "removed_fragments")
    total = batch_totals(metrics).select(F.format_string("| total of %d | %d | %d | %d | %.2f%% | %d |", "files", "original_words", "kept_words", "stripped_words", "kept_pct", "removed").alias("line"), F.lit(1).alias("part"))
    return metrics.select(line.alias("line"), F.lit(0).alias("part")).union(total).orderBy("part", "line").select("line")


def bakeoff(docs: DataFrame, settings: Settings, table: Callable = lambda df, name: df) -> DataFrame:
    """(doc_id, policy, removed, markers, kept_words): the corpus's leading model under
    every policy, side by side. Fragments, the model and its candidates are made once with
    `table`, as in analyze()."""
    from echosieve.plans.pipeline import fragment_rows, mine_models, spans_of

    frags = table(fragment_rows(docs, settings), "bakeoff-fragments")
    model = table(mine_models(frags, [], table).where("model_rank = 1"), "bakeoff-model")
    cands = table(templates.pattern_candidates(frags, model, [], settings.pattern_min_score), "bakeoff-candidates")
    none = frags.select("doc_id", "idx", F.lit(0.0).alias("badness")).where("false")
    out = None
    for policy in ("keep-1", "keep-2", "threshold-dedup"):
        picked = templates.select_candidates(cands, policy)
        spans = spans_of(docs, frags, none, picked)
        done = edits.apply_spans(docs, spans)
        n = picked.groupBy("doc_id").agg(F.count("*").alias("removed"))
        rows = done.join(n, "doc_id", "left").select("doc_id", F.lit(policy).alias("policy"), F.coalesce("removed", F.lit(0)).alias("removed"), F.regexp_count("rewritten", F.lit("@")).alias("markers"), word_count("rewritten").alias("kept_words"))
        out = rows if out is None else out.union(rows)
    return out


def segments_html(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, severity, part): the parts of a text for display."""
    rows = segments.join(docs.select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "seq", "kind", "severity", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("part"))
