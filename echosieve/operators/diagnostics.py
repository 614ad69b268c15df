"""Diagnostics inside and across fragments: n-grams, phrases, pattern flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echosieve.functions import text as T

REASONS = ("internal-window-repeat", "token-reuse", "looped-phrasing", "low-diversity", "dominant-token")


def phrases(tokens) -> F.Column:
    """All 2-, 3- and 4-grams."""
    return F.concat(*[T.ngrams(tokens, n) for n in (2, 3, 4)])


def ngram_counts(frags: DataFrame, n: int = 3) -> DataFrame:
    return frags.select(F.explode(T.ngrams("tokens", n)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def repeated_phrases(frags: DataFrame, dialect: str = "web", least: int = 4, top: int | None = None) -> DataFrame:
    """(phrase, n) of the phrases counted `least` times: web counts repeats inside a
    fragment and cuts to 40 after the filter, cli counts a fragment once and cuts to 30 before."""
    grams = phrases("tokens") if dialect == "web" else F.array_distinct(phrases("tokens"))
    counts = frags.select(F.explode(grams).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))
    ranked = [F.desc("n"), F.asc("phrase")]
    if dialect == "web":
        return counts.where(F.col("n") >= least).orderBy(*ranked).limit(top or 40)
    return counts.orderBy(*ranked).limit(top or 30).where(F.col("n") >= least)


def _bound(value, f) -> F.Column:
    """f(value), value worked out once for all elements that f's lambdas go through."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repeated(values) -> F.Column:
    """The values that stand in an array twice or more, sorted."""
    again = lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x)))
    return _bound(F.array_sort(values), again)


def _longest_run(values) -> F.Column:
    """How often the most frequent value of an array stands in it."""
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
    longest = lambda s: _bound(begins(s), lambda b: F.array_max(F.transform(b, lambda at, k: F.coalesce(F.get(b, k + 1), F.size(s)) - at)))
    return _bound(F.array_sort(values), longest)


def pattern_metrics(frags: DataFrame) -> DataFrame:
    """Adds repeated_windows, signatures (sorted), repeated_mass, dominant_share,
    unique_ratio, repeat_density, reasons and the web score."""
    # all inside a row: no token or phrase is shuffled
    rows = frags.withColumns({"signatures": _repeated(phrases("tokens")), "_top": _longest_run(F.col("tokens")), "_distinct": F.size(F.array_distinct("tokens"))})
    rows = rows.withColumn("repeated_windows", F.size(phrases("tokens")) - F.size(F.array_distinct(phrases("tokens"))))
    size, distinct, dominant = F.size("tokens"), F.col("_distinct"), F.col("_top")
    rows = rows.withColumns(
        {
            "repeated_mass": size - distinct,
            "dominant_share": dominant / F.greatest(F.lit(1), size),
            "unique_ratio": distinct / F.greatest(F.lit(1), size),
            "repeat_density": F.col("repeated_windows") / F.greatest(F.lit(1), size - 1),
        }
    ).drop("_top", "_distinct")
    tests = (F.size("signatures") > 0, F.col("repeated_mass") >= 2, F.col("repeat_density") >= 0.12, (F.col("unique_ratio") <= 0.72) & (size >= 6), (F.col("dominant_share") >= 0.22) & (size >= 8))
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS)]))
    score = F.col("repeated_mass") * 0.7 + F.col("repeat_density") * 2.3 + (F.lit(1.0) - F.col("unique_ratio")) * 1.3 + F.col("dominant_share") * 0.8
    return rows.withColumn("reasons", reasons).withColumn("score", score)


def pattern_flags(frags: DataFrame, dialect: str = "web") -> DataFrame:
    """The fragments with a reason; cli adds a bonus for each reason."""
    rows = pattern_metrics(frags).where(F.size("reasons") > 0)
    if dialect == "cli":
        bonus = F.lit(0.0)
        for reason, value in zip(REASONS, CLI_BONUS):
            bonus = bonus + F.when(F.array_contains("reasons", reason), value).otherwise(0.0)
        rows = rows.withColumn("score", F.col("score") + bonus)
    return rows


#: What each reason adds to the cli score.
CLI_BONUS = (0.6, 0.5, 0.0, 0.4, 0.3)


def top_flags(flags: DataFrame, top: int = 20, dialect: str = "web") -> DataFrame:
    """The flags of the highest score in every document, with place from 1; of equal scores the
    denser repeats, then web's first and cli's last fragment."""
    last = [F.asc("idx")] if dialect == "web" else [F.desc("para_index"), F.desc("idx")]
    order = W.partitionBy("doc_id").orderBy(F.desc(F.round("score", 6)), F.desc(F.round("repeat_density", 9)), *last)
    return flags.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def reason_counts(flags: DataFrame) -> DataFrame:
    return flags.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def window_counts(flags: DataFrame) -> DataFrame:
    return flags.select(F.explode("signatures").alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))
