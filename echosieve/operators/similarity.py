"""Fragment pairs and their similarity.

Candidates share a token that is not too common in their document and lie within a
radius of paragraphs. candidate_pairs(), scored_pairs() and matches() meet the fragments of
a unit in place (operators/units.py), so neither postings nor pairs are shuffled; pairs are
kept once (a < b) where the metric is symmetric. pair_similarity() takes given pairs.
similar_pairs() is the join that a least score allows: on the rarest tokens alone, as many
as such a pair must share one of; it drops pairs by sizes and counts before any token list
is moved."""

from __future__ import annotations

import difflib
import functools
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from echosieve.config import WEIGHTS, Settings
from echosieve.functions import text as T
from echosieve.operators import walk
from echosieve.operators.units import walked


def token_index(frags: DataFrame) -> DataFrame:
    """(doc_id, token, idx, para_index), each token of a fragment once."""
    return frags.select("doc_id", "idx", "para_index", F.explode(F.array_distinct("tokens")).alias("token"))


def token_postings(frags: DataFrame) -> DataFrame:
    """(doc_id, token, n): how many fragments hold a token."""
    return token_index(frags).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def postings_in_rows(docs: DataFrame) -> DataFrame:
    """token_postings() of (doc_id, tokens) with all token lists of a document in its row: a
    token's places in their sorted union are counted there, without a shuffle."""
    sorted_ = F.array_sort(F.flatten(F.transform("tokens", F.array_distinct)))
    rows = docs.select("doc_id", F.explode(F.array(sorted_)).alias("t"))
    begins = F.filter(F.transform("t", lambda x, i: F.when((i == 0) | (F.get("t", i - 1) != x), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "t", F.explode(F.array(begins)).alias("b"))
    runs = F.transform("b", lambda at, k: F.struct(F.get("t", at).alias("token"), (F.coalesce(F.get("b", k + 1), F.size("t")) - at).cast("long").alias("n")))
    return rows.select("doc_id", F.inline(runs))


def candidate_pairs(frags: DataFrame, settings: Settings = Settings(), radius: int | None = None) -> DataFrame:
    """(doc_id, a, b, distance) with a < b: fragments within `radius` paragraphs that
    share a token which at most max_candidates_per_token fragments hold."""
    return walked(frags, at_base(settings, radius), walk.pairs, "a int, b int, distance int")


def scored_pairs(frags: DataFrame, settings: Settings = Settings(), radius: int | None = None) -> DataFrame:
    """candidate_pairs() with overlap, seq, bigram, trigram, size, shared, exchange and score."""
    return walked(frags, at_base(settings, radius), walk.pair_scores, "a int, b int, distance int, overlap double, seq double, bigram double, trigram double, size double, shared int, exchange boolean, score double")


def at_base(settings: Settings, radius: int | None = None) -> Settings:
    """settings without growth, within `radius` paragraphs."""
    return replace(settings, frontier_growth=1, paragraph_radius=settings.paragraph_radius if radius is None else radius)


#: Longer fragments are taken to need no more shared tokens than one of this length.
LONG = 256


def least_shared(n: int, bound: float, weights) -> int:
    """How many tokens a fragment of n tokens, all different, must share with any other one for
    a score of `bound`. With o shared, a partner of m tokens gives at most o/n of overlap,
    (o-1)/(n-1) of bigrams, (o-2)/(n-2) of trigrams and 2o/(n+m) of sequence; the sum with
    the size part is largest where m is o or n, as it is convex between and falls beyond."""
    raw, seq, two, three, size = weights
    for o in range(1, n):
        fixed = raw * o / n + two * (o - 1) / max(n - 1, 1) + three * max(o - 2, 0) / max(n - 2, 1)
        if fixed + max(seq * o / n + size, seq * 2 * o / (n + o) + size * o / n) >= bound - 1e-9:
            return o
    return max(1, n)


def similar_pairs(frags: DataFrame, settings: Settings = Settings(), radius: int | None = None, bound: float | None = None) -> DataFrame:
    """Those of candidate_pairs() that may have a score of `bound` (min_match_score), and no
    pair that has it is left out. Tokens of a document are ordered from rare to common. A
    fragment that must share k of its rare tokens is joined on all but its k - 1 commonest.
    What a pair shares is at most what its joined tokens show, what either leaves out of the
    join, and the too common tokens both hold; sizes and that count bound its score."""
    bound = settings.min_match_score if bound is None else bound
    radius = settings.paragraph_radius if radius is None else radius
    raw, seq, two, three, size = [F.lit(float(w)) for w in WEIGHTS[settings.dialect]]
    grams = lambda n: F.size(F.array_distinct(T.ngrams("tokens", n)))
    sets = frags.select("doc_id", "idx", "para_index", F.size("tokens").alias("n"), grams(2).alias("g2"), grams(3).alias("g3"), F.array_distinct("tokens").alias("set"))
    sets = sets.select("*", F.size("set").alias("d"), F.explode("set").alias("token")).drop("set")
    often = token_postings(frags).where("n > 1").withColumnRenamed("n", "df")
    rare = F.col("df") <= settings.max_candidates_per_token
    own = W.partitionBy("doc_id", "idx")
    index = sets.join(often, ["doc_id", "token"]).withColumn("place", F.row_number().over(own.orderBy("df", "token"))).withColumn("r", F.count_if(rare).over(own)).withColumn("f", F.count_if(~rare).over(own)).where(rare)
    table = F.array(*[F.lit(least_shared(n, bound, WEIGHTS[settings.dialect])) for n in range(LONG + 1)])
    least = F.when(F.col("n") == F.col("d"), F.get(table, F.least(F.col("n"), F.lit(LONG)))).otherwise(1)
    index = index.withColumn("out", F.greatest(least - F.col("f"), F.lit(1)) - 1).where(F.col("place") <= F.col("r") - F.col("out"))
    carried = ["para_index", "n", "d", "g2", "g3", "f", "out"]
    side = lambda x: index.select("doc_id", "token", F.col("idx").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in carried])
    distance = F.abs(F.col("para_index_a") - F.col("para_index_b"))
    met = side("a").join(side("b"), ["doc_id", "token"]).where((F.col("a") < F.col("b")) & (distance <= radius))
    keys = ["doc_id", "a", "b", *[f"{c}_{x}" for x in "ab" for c in carried]]
    pairs = met.groupBy(*keys).agg(F.count("*").alias("met"))
    col = {f"{c}{x}": F.col(f"{c}_{x}") for x in "ab" for c in carried}
    o = F.least(F.col("met") + col["outa"] + col["outb"] + F.least(col["fa"], col["fb"]), col["da"], col["db"])
    plain = (col["na"] == col["da"]) | (col["nb"] == col["db"])
    ratio = lambda s, x, y: s / F.greatest(x + y - s, F.lit(1))

    def common(g, less):  # shared n-grams: of a fragment without repeats at most o - less
        most = F.least(col[f"{g}a"], col[f"{g}b"])
        return ratio(F.when(plain, F.least(most, F.greatest(o - less, F.lit(0)))).otherwise(most), col[f"{g}a"], col[f"{g}b"])

    along = F.least(o + col["na"] - col["da"], o + col["nb"] - col["db"], col["na"], col["nb"])
    most = raw * ratio(o, col["da"], col["db"]) + seq * 2 * along / (col["na"] + col["nb"]) + two * common("g2", 1) + three * common("g3", 2) + size * F.least(col["na"], col["nb"]) / F.greatest(col["na"], col["nb"])
    return pairs.where(most >= bound - 1e-9).select("doc_id", "a", "b", distance.alias("distance"))


@F.pandas_udf(DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 LCS / (len a + len b), by bit-parallel rows, so long fragments cost words of bits."""

    def one(x, y):
        if len(x) == 0 or len(y) == 0:
            return 0.0
        mask: dict = {}
        for k, w in enumerate(x):
            mask[w] = mask.get(w, 0) | 1 << k
        full = (1 << len(x)) - 1
        v = full
        for w in y:
            m = mask.get(w)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return 2 * (len(x) - v.bit_count()) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio without junk; not symmetric."""
    return pd.Series([difflib.SequenceMatcher(None, list(x), list(y), autojunk=False).ratio() if len(x) and len(y) else 0.0 for x, y in zip(a, b)], dtype=float)


def pair_similarity(frags: DataFrame, pairs: DataFrame, settings: Settings = Settings(), bound: float | None = None) -> DataFrame:
    """pairs with overlap, seq, bigram, trigram, size, shared, exchange and score. With
    `bound`, pairs whose score can't reach it are dropped before their sequences are
    compared: the sequence part is at most the share of common token occurrences."""
    sets = frags.select("doc_id", "idx", "tokens", F.array_distinct("tokens").alias("set"), F.array_distinct(T.ngrams("tokens", 2)).alias("two"), F.array_distinct(T.ngrams("tokens", 3)).alias("three"))
    side = lambda n: sets.select("doc_id", F.col("idx").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("tokens", "set", "two", "three")])
    rows = pairs.join(side("a"), ["doc_id", "a"]).join(side("b"), ["doc_id", "b"])
    na, nb = F.size("tokens_a"), F.size("tokens_b")
    rows = rows.withColumns(
        {
            "shared": F.size(F.array_intersect("set_a", "set_b")),
            "overlap": T.jaccard("set_a", "set_b"),
            "bigram": T.jaccard("two_a", "two_b"),
            "trigram": T.jaccard("three_a", "three_b"),
            "size": F.lit(1.0) - F.abs(na - nb) / F.greatest(na, nb),
        }
    )
    w = [F.lit(x) for x in WEIGHTS[settings.dialect]]

    def total(seq):
        return w[0] * F.col("overlap") + w[1] * seq + w[2] * F.col("bigram") + w[3] * F.col("trigram") + w[4] * F.col("size")

    if bound is not None:
        common = lambda x, y: F.size(F.filter(f"tokens_{x}", lambda t: F.array_contains(F.col(f"set_{y}"), t)))
        most = F.least(common("a", "b"), common("b", "a")) * 2.0 / (na + nb)
        rows = rows.where(total(most) >= bound - 1e-9)
    rows = rows.withColumn("seq", (lcs_ratio if settings.dialect == "web" else matcher_ratio)("tokens_a", "tokens_b"))
    has = lambda c, t: F.array_contains(c, t)
    swap = (has("set_a", "i") & has("set_b", "you")) | (has("set_a", "you") & has("set_b", "i"))
    rows = rows.withColumn("exchange", swap & (F.col("overlap") >= 0.35)).withColumn("score", total(F.col("seq")))
    return rows.drop("two_a", "two_b", "three_a", "three_b")


def matches(frags: DataFrame, settings: Settings = Settings(), radius: int | None = None, common: bool = True) -> DataFrame:
    """(doc_id, idx, other, distance, shared, score, weighted, common), both ways; common are
    the tokens that both have, left out if not asked for."""
    schema = "idx int, other int, distance int, shared int, score double, weighted double" + ", common array<string>" * common
    return walked(frags, at_base(settings, radius), functools.partial(walk.match_rows, follow=False, common=common), schema)
