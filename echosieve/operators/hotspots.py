"""Hotspots: fragments with matches, how badly they repeat, and which to remove."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echosieve.config import PROFILES, Profile, Settings
from echosieve.operators import walk
from echosieve.operators.similarity import at_base
from echosieve.operators.units import UNIT, walk_units, walked  # noqa: F401

#: Sums of doubles depend on their order; thresholds and ranks see this many places.
PLACES = 9


def score_rows(frags: DataFrame, found: DataFrame) -> DataFrame:
    """frags that have matches, with match_count, density, badness, reusable, unique,
    reusable_ratio and hint."""
    capital = frags.select("doc_id", F.col("idx").alias("other"), F.col("starts_capitalized").alias("other_capital"))
    found = found.join(capital, ["doc_id", "other"])
    sums = found.groupBy("doc_id", "idx").agg(
        F.count("*").alias("match_count"),
        F.round(F.sum("weighted"), PLACES).alias("density"),
        F.array_distinct(F.flatten(F.collect_set("common"))).alias("seen"),
        F.min("other").alias("first"),
        F.min(F.when(F.col("other_capital"), F.col("other"))).alias("first_capital"),
    )
    sums = frags.select("doc_id", "idx", "tokens").join(sums, ["doc_id", "idx"]).withColumn("reusable", F.size(F.array_intersect(F.array_distinct("tokens"), "seen")))
    return score_sums(frags, sums.drop("tokens", "seen"))


def score_sums(frags: DataFrame, sums: DataFrame) -> DataFrame:
    """score_rows() by what the matches of a fragment come to: (doc_id, idx, match_count,
    density, reusable, first, first_capital)."""
    # counted before the join, which moves tokens only where they are asked for
    rows = frags.withColumn("_own", F.size(F.array_distinct("tokens"))).join(sums, ["doc_id", "idx"])
    rows = rows.withColumn("unique", F.col("_own") - F.col("reusable"))
    rows = rows.withColumn("reusable_ratio", F.col("reusable") / F.greatest(F.lit(1), F.col("_own"))).drop("_own")
    badness = F.col("density") * (1 + F.least(F.col("match_count"), F.lit(8)) / 4) * (0.5 + F.col("reusable_ratio"))
    earliest_capital = F.col("starts_capitalized") & (F.col("first_capital").isNull() | (F.col("idx") < F.col("first_capital")))
    hint = F.when(F.col("idx") < F.col("first"), "earliest").when(earliest_capital, "earliest-capitalized").otherwise("redundant-candidate")
    return rows.withColumn("badness", F.round(badness, PLACES)).withColumn("hint", hint).drop("first", "first_capital")


def top_matches(found: DataFrame, top: int = 5) -> DataFrame:
    """The best matches of every fragment, with place from 1."""
    order = W.partitionBy("doc_id", "idx").orderBy(F.desc("weighted"), "distance", "other")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def top_hotspots(rows: DataFrame, top: int = 40, dialect: str = "web") -> DataFrame:
    """The worst hotspots of every document, with place from 1."""
    order = W.partitionBy("doc_id").orderBy(*[F.desc(k) for k in order_keys(dialect)])
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def order_keys(dialect: str) -> tuple[str, ...]:
    return ("badness", "match_count", "idx") if dialect == "web" else ("badness", "match_count", "reusable_ratio", "para_index", "idx")


def hotspots(frags: DataFrame, settings: Settings = Settings(), expansion_rounds: int | None = None) -> DataFrame:
    """Hotspot rows. The frontier is followed to its end; expansion_rounds=0 matches within
    the base radius only. A walk gives back sums, so its matches are neither written nor
    shuffled."""
    follow = expansion_rounds != 0

    def run(pdf, settings):
        yield walk.match_sums(pdf, settings, follow)

    sums = walked(frags, settings if follow else at_base(settings), run, "idx int, match_count long, density double, reusable int, first int, first_capital int")
    return score_sums(frags, sums.withColumn("density", F.round("density", PLACES)))


def selected_rows(rows: DataFrame, frags: DataFrame, profile: Profile | str = "med", dialect: str = "web") -> DataFrame:
    """The hotspots a profile removes: (doc_id, idx, badness, rank, pick)."""
    profile = PROFILES[profile] if isinstance(profile, str) else profile
    counts = frags.groupBy("doc_id").agg(F.count("*").alias("n_frags"))
    most = F.greatest(F.lit(1), F.floor(F.col("n_frags") * F.lit(profile.max_remove_ratio)).cast("int"))
    order = W.partitionBy("doc_id").orderBy(*[F.desc(k) for k in order_keys(dialect)])
    ranked = rows.join(counts, "doc_id").withColumn("most", most).withColumn("rank", F.row_number().over(order))
    cutoff = F.coalesce(F.max(F.when(F.col("rank") == F.col("most"), F.col("badness"))).over(W.partitionBy("doc_id")), F.lit(0.0))
    ranked = ranked.withColumn("cutoff", cutoff)
    ok = (F.col("hint") == "redundant-candidate") & ((F.col("badness") >= profile.min_badness) | (F.col("badness") >= F.col("cutoff")) & (F.col("badness") >= profile.min_viable))
    ok = ok & (F.col("match_count") >= profile.min_matches) & (F.col("reusable_ratio") >= profile.min_reuse) & (F.col("unique") <= profile.max_unique)
    if not profile.allow_capitalized:
        ok = ok & ~F.col("starts_capitalized")
    pick = F.row_number().over(W.partitionBy("doc_id").orderBy("rank"))
    return ranked.where(ok).withColumn("pick", pick).where(F.col("pick") <= F.col("most")).select("doc_id", "idx", "badness", "rank", "pick")


def frontier_matches(frags: DataFrame, settings: Settings, unit: int = UNIT) -> DataFrame:
    """matches() with the frontier walk: tokens of the best matches bring in further
    candidates, at radii that double up to the growth limit, until none is new. A fragment's
    walk needs the fragments within the widest radius and no other one's walk, so every
    `unit` fragments of a document are a task's group, beside the halo they can reach."""
    return walked(frags, settings, walk.match_rows, "idx int, other int, distance int, shared int, score double, weighted double, common array<string>", unit)
