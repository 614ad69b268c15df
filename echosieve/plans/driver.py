"""The whole pass over files: texts in, rewritten texts, metrics and reports out.

A file that can't be read as UTF-8 doesn't stop the others: it has a row of metrics with
an error. Stage times are those of the written tables, as plans are lazy until then."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.config import Settings, parse_profiles
from echosieve.plans.pipeline import Analysis, analyze, batch
from echosieve.sources import readers, reports, sinks


class Tables:
    """Writes every table once under path and times it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seconds = spark, path, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        began, at = time.time(), f"{self.path}/{len(self.seconds)}-{name}"
        df.write.mode("overwrite").parquet(at)
        self.seconds[name] = self.seconds.get(name, 0.0) + time.time() - began
        return self.spark.read.schema(df.schema).parquet(at)


def run_files(
    spark: SparkSession,
    source: str,
    out: str,
    settings: Settings = Settings(),
    profiles: str | None = None,
    shared: bool = False,
    split: int = 0,
    crossover: bool = False,
    report: bool = False,
    bakeoff: bool = False,
) -> tuple[Analysis, dict[str, float]]:
    """Rewrite every markdown file under source. Under out are texts (with frontmatter),
    metrics, tables, and, where asked for, each profile's texts, the reports and the
    bakeoff. An empty source is an error. Returns the analysis and the seconds by stage."""
    names = parse_profiles(profiles) if profiles else []
    table = Tables(spark, f"{out}/tables")
    files = table(readers.read_checked(spark, source), "parse")
    if files.isEmpty():
        raise FileNotFoundError(f"no markdown files in {source}")
    docs = files.where("error is null").select("doc_id", "text")
    done = batch(docs, settings, split, crossover, table) if shared or split >= 2 else analyze(docs, settings, table=table)
    done = replace(done, metrics=table(done.metrics, "metrics"))
    texts = sinks.with_frontmatter(done, docs, settings)
    sinks.write_texts(texts, f"{out}/texts")
    failed = files.where("error is not null").select("doc_id", "error")
    sinks.write_metrics(done.metrics, f"{out}/metrics", settings.profile, done.flags)
    failed.write.mode("overwrite").json(f"{out}/errors")
    if names:
        rows = table(sinks.refloors(docs, done.fragments, done.hotspots, names, settings.dialect), "profiles")
        sinks.write_texts(rows, f"{out}/profiles", "rewritten", ["profile"])
        sinks.write_metrics(rows, f"{out}/profile-metrics")
    if report:
        reports.pattern_report(done, settings).write.mode("overwrite").json(f"{out}/reports")
    if bakeoff:
        sinks.write_texts(reports.bakeoff_outputs(docs, settings, table), f"{out}/bakeoff", "rewritten", ["policy"])
    return done, table.seconds


def outcomes(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """(doc_id, status, error, …metrics) of every file, those that failed too."""
    rows = files.select("doc_id", "error").join(metrics, "doc_id", "left")
    return rows.withColumn("status", F.when(F.col("error").isNull(), "complete").otherwise("failed"))
