"""URL filtering by rules and by learned path templates.

Per host a tree of path templates is grown level by level over pre-aggregated shaped
paths: digits become `#` at once; a segment stays literal where it is frequent under
its parent and becomes `*` otherwise; siblings whose continuations are alike merge into
one wildcard branch unless their labels differ significantly, so labels reach siblings
without any. A branch with fewer urls than a literal needs is wildcards to its end, so
levels go on only as deep as paths are frequent. Levels that a branch walks undivided, all
its urls with one literal or none with a frequent one, are taken in one step, so steps
follow the divisions of the tree and not its depth. A template is rejected when its share of
bad labels, smoothed towards a half, is over a half and enough labels support it.
Everything is aggregation and equi-joins, so a host of any size is spread over all
tasks; a branch has at most 1 / SHARE literal segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import Scratch

#: A literal needs this many urls and share of its parent; a rejection this many labels.
SUPPORT, SHARE, LABELS, SMOOTHING = 20, 0.01, 5, 10.0
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    after = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; the first of equally long ones."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # a longer one overrides
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _class(bad: Column, good: Column) -> Column:
    """-1, 0 or 1: whether the 95 % Wilson interval of the bad share lies below, over or above a half."""
    n = bad + good
    p, z2 = bad / F.greatest(n, F.lit(1)), 3.8416
    mid = (p + z2 / (2 * F.greatest(n, F.lit(1)))) / (1 + z2 / F.greatest(n, F.lit(1)))
    half = F.sqrt(z2 * (p * (1 - p) / F.greatest(n, F.lit(1)) + z2 / (4 * F.greatest(n, F.lit(1)) ** 2))) / (1 + z2 / F.greatest(n, F.lit(1)))
    return F.when(n == 0, 0).when(mid - half > 0.5, 1).when(mid + half < 0.5, -1).otherwise(0)


def walk_undivided(live: DataFrame) -> DataFrame:
    """live(host, template, seg, n, …) with the levels taken that all urls of a branch walk
    together; adds over. seg is what is left of a path; of a branch whose urls end at
    different levels the longer ones go on until fewer than SUPPORT are left."""
    branch = ["host", "template"]
    words = live.select(*branch, "n", F.posexplode("seg").alias("at", "word"))
    words = words.groupBy(*branch, "at", "word").agg(F.sum("n").alias("n"))
    levels = words.groupBy(*branch, "at").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by("word", "n").alias("word"))
    small = F.col("total") < SUPPORT
    token = F.when(small, None).when(F.col("most") == F.col("total"), F.col("word")).when((F.col("most") < SUPPORT) | (F.col("most") < SHARE * F.col("total")), "*")
    levels = levels.select(*branch, "at", small.alias("small"), token.alias("token"))
    path = F.array_sort(F.collect_list(F.struct("at", "token", "small")))  # a level of the branch each
    ways = levels.groupBy(*branch).agg(path.alias("path"), F.min(F.when(F.col("token").isNull(), F.col("at"))).alias("stop"))
    ways = ways.withColumn("stop", F.coalesce("stop", F.size("path"))).withColumn("ends", F.coalesce(F.get("path", F.col("stop"))["small"], F.lit(False)))
    ways = ways.select(*branch, "stop", "ends", F.transform(F.slice("path", 1, F.col("stop")), lambda x: x["token"]).alias("tokens"))
    rows = live.join(ways, branch)
    size = F.size("seg")
    walked = F.concat("template", F.array_join(F.transform(F.slice("tokens", 1, F.least(size, F.col("stop"))), lambda t: F.concat(F.lit("/"), t)), ""))
    rest = F.when(size <= F.col("stop"), "/$").when(F.col("ends"), F.concat(F.expr("repeat('/*', size(seg) - stop)"), F.lit("/$"))).otherwise("")
    rows = rows.withColumn("template", F.concat(walked, rest)).withColumn("over", (size <= F.col("stop")) | F.col("ends"))
    return rows.withColumn("seg", F.slice("seg", F.col("stop") + 1, F.greatest(size, F.lit(1)))).drop("stop", "ends", "tokens")


def grow_templates(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """shapes(host, shape, n, bad, good), one row per pair; adds template. A template has a
    token per segment, a literal, `*`, or `{}` for merged siblings, and ends in `$`. A step
    takes every branch to its next division and divides it there."""
    live = shapes.withColumn("seg", F.split(F.regexp_replace("shape", "^/", ""), "/")).withColumn("template", F.lit(""))
    done = None
    while True:
        walked = scratch.save(walk_undivided(live), "walked")  # read several times below
        ended = walked.where("over").drop("seg", "over")
        done = ended if done is None else done.unionByName(ended)
        live = walked.where("not over").drop("over")
        if live.isEmpty():
            return done
        total = live.groupBy("host", "template").agg(F.sum("n").alias("total"))
        rows = live.join(total, ["host", "template"]).withColumn("here", F.get("seg", F.lit(0)))
        rest = F.transform(F.slice("seg", 2, F.greatest(F.size("seg"), F.lit(1))), lambda x: F.regexp_replace(x, "[^#.]+", "a"))
        rows = rows.withColumn("deeper", F.concat_ws("/", rest))
        node = ["host", "template", "here"]
        kids = rows.groupBy(*node, "total", "deeper").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
        kids = scratch.save(kids.groupBy(*node, "total").agg(
            *[F.sum(c).alias(c) for c in ("n", "bad", "good")],
            # continuations as quarters of the branch, the profile siblings are compared by
            F.max_by("deeper", F.struct("n", "deeper")).alias("main"),
            F.round(F.max("n") / F.sum("n") * 4).cast("int").alias("quarter"),
        ).where((F.col("n") >= SUPPORT) & (F.col("n") >= SHARE * F.col("total"))), "kids")
        kids = kids.withColumn("kind", _class(F.col("bad"), F.col("good")))
        alike = ["host", "template", "main", "quarter"]
        groups = kids.groupBy(*alike).agg(F.count("*").alias("twins"), F.min("kind").alias("least"), F.max("kind").alias("most"))
        same = kids.groupBy(*alike, "kind").agg(F.count("*").alias("same"))
        mixed = (F.col("least") < 0) & (F.col("most") > 0)
        profile = F.concat_ws(":", "main", "quarter")
        token = F.when(mixed & (F.col("same") > 1), F.concat(F.lit("{"), profile, F.lit(":"), "kind", F.lit("}"))).when(~mixed & (F.col("twins") > 1), F.concat(F.lit("{"), profile, F.lit("}"))).otherwise(F.col("here"))
        literal = kids.join(groups, alike).join(same, [*alike, "kind"]).select(*node, token.alias("token"))
        grown = rows.join(literal, node, "left").withColumn("last", F.size("seg") == 1)
        tail = F.concat(F.lit("/"), F.coalesce("token", F.lit("*")), F.when(F.col("last"), "/$").otherwise(""))
        grown = grown.withColumn("template", F.concat("template", tail)).withColumn("seg", F.slice("seg", 2, F.greatest(F.size("seg"), F.lit(1))))
        grown = grown.drop("here", "deeper", "token", "total")
        done = done.unionByName(grown.where("last").drop("seg", "last"))
        live = grown.where("not last").drop("last")


def judge_urls(pages: DataFrame, labels: Column, id_col: str = "page_id", url_col: str = "url", label: str = "urls") -> DataFrame:
    """(id_col, host, path, template, purity, rejected) of every row; `labels` is a column
    over (host, path): 1 bad, 0 good, null unknown. Null urls and urls without :// have an
    empty host and path and share a template. Repeated rows give repeated rows; other
    columns are ignored."""
    rows = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rows = rows.withColumn("label", labels).withColumn("shape", F.regexp_replace("path", "[0-9]+", "#"))
    scratch = Scratch(pages.sparkSession, label)
    shapes = scratch.save(rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good")), "shapes")
    grown = grow_templates(shapes, scratch)
    sums = grown.groupBy("host", "template").agg(F.sum("bad").alias("t_bad"), F.sum("good").alias("t_good"))
    sums = sums.withColumn("purity", (F.col("t_bad") + SMOOTHING / 2) / (F.col("t_bad") + F.col("t_good") + SMOOTHING))
    sums = sums.withColumn("rejected", (F.col("purity") > 0.5) & (F.col("t_bad") + F.col("t_good") >= LABELS))
    known = grown.select("host", "shape", "template").join(sums, ["host", "template"]).select("host", "shape", "template", "purity", "rejected")
    return rows.join(known, ["host", "shape"]).select(id_col, "host", "path", "template", "purity", "rejected")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' verdicts are the labels that templates are judged by."""
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    bad = F.when(verdict == "block", 1).when(verdict == "allow", 0)
    judged = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), bad, label="op6")
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")
