"""Gapped phrase templates: mining, ranking, de-duplication, models, scaffold choices.

A template is a window of 5 to 9 tokens with one to three wildcards after its first
token and at least three distinct fixed ones. Only templates counted LEAST times in
their scope matter, so windows are pruned before they are multiplied by wildcard masks:
a position may stay fixed only if its pair with the first token is as frequent, and any
three within the first seven only if they and the first token are."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echosieve.operators.units import packs

LENGTHS, LEAST, OVERLAP, MOST, SOFT = range(5, 10), 4, 0.72, 40, 0.84
#: Ranks whose clashes are looked at together.
BATCH = 256
#: Ranges that a corpus's templates are ranked in, and the rows that their cuts are taken from.
RANGES, SAMPLE = 128, 8192
#: Ranks whose footprints are made first, how much more ranks the next ones are, and the most that are broadcast.
LEADING, MORE, SMALL = 2048, 8, 16384


def masks() -> list[tuple[int, int]]:
    """(length, bit mask of wild positions) of every wildcard set."""
    return [(n, sum(1 << p for p in c)) for n in LENGTHS for k in range(1, min(3, max(1, n - 4)) + 1) for c in combinations(range(1, n), k)]


def wildcard_masks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(masks(), "length int, mask int")


#: Three places after a first token. Every template has its first four fixed tokens at one of them.
TRIPLES = list(combinations(range(1, 7), 3))


def _needs() -> list[tuple[int, int, int]]:
    """(length, mask, bits of the TRIPLES that a window's fixed tokens stand at)."""
    fixed = lambda n, mask: {p for p in range(1, n) if not mask >> p & 1}
    return [(n, m, sum(1 << k for k, t in enumerate(TRIPLES) if fixed(n, m).issuperset(t))) for n, m in masks()]


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """Those of rows(h, ...) whose hash is counted `least` times."""
    often = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h")
    return rows.join(often, "h", "left_semi").drop("h")


def frequent_starts(frags: DataFrame, scope: list[str], least: int = LEAST, table=lambda df, name: df) -> DataFrame:
    """(scope…, doc_id, idx, section, start, can_fix, quads, room, reach): the places where a
    template may begin, with can_fix, the gaps whose pairs with the first token are counted
    `least` times, and quads, the TRIPLES that are so with it; reach are the tokens from there,
    room is their number up to the fragment's end. Rows are met by 64-bit hashes; hashes that
    fall together only leave more places in. `table` keeps what is read twice. Within documents
    all is counted where a document lies."""
    own = list(dict.fromkeys([*scope, "doc_id"]))
    if scope == ["doc_id"]:
        return table(_starts_in_documents(frags, least), "starts")
    # by number: a place is multiplied later, so few bytes are still many rows
    parts = int(frags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.size("tokens")
    at = lambda i: F.get("tokens", i)
    rows = frags.where(n >= min(LENGTHS)).select(*own, "idx", "section", "tokens")

    def gaps(i):
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(max(LENGTHS) - 1), n - i - 1)), lambda g: F.struct(i.alias("start"), g.alias("gap"), F.xxhash64(*scope, g, at(i), at(i + g)).alias("h")))

    pairs = rows.select(*own, "idx", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), n - min(LENGTHS)), gaps))).alias("x")).select(*own, "idx", "x.*")
    pairs = _frequent(pairs, least).repartition(parts, *own, "idx")
    fixed = pairs.groupBy(*own, "idx", "start").agg(F.sum(F.expr("shiftleft(1, gap)")).cast("int").alias("can_fix"))
    fixed = fixed.where(F.bit_count(F.col("can_fix").bitwiseAND(0b1111110)) >= 3)  # or no four tokens are left
    fixed = fixed.groupBy(*own, "idx").agg(F.collect_list(F.struct("start", "can_fix")).alias("starts"))
    first = table(rows.join(fixed, [*own, "idx"]), "pair-starts")
    triples = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(sum(1 << p for p in t)).alias("bits"), *[F.lit(p).alias(x) for p, x in zip(t, "abc")]) for k, t in enumerate(TRIPLES)])

    def quads(s):
        here = F.filter(triples, lambda t: s["can_fix"].bitwiseAND(t["bits"]) == t["bits"])
        return F.transform(here, lambda t: F.struct(s["start"].alias("start"), s["can_fix"].alias("can_fix"), t["k"].alias("k"), F.xxhash64(*scope, t["k"], at(s["start"]), *[at(s["start"] + t[x]) for x in "abc"]).alias("h")))

    four = first.select(*own, "idx", F.explode(F.flatten(F.transform("starts", quads))).alias("x")).select(*own, "idx", "x.*")
    four = _frequent(four, least).repartition(parts, *own, "idx")
    held = four.groupBy(*own, "idx", "start", "can_fix").agg(F.sum(F.expr("shiftleft(1, k)")).cast("int").alias("quads"))
    held = held.groupBy(*own, "idx").agg(F.collect_list(F.struct("start", "can_fix", "quads")).alias("starts"))
    held = rows.join(held, [*own, "idx"]).select(*own, "idx", "section", "tokens", F.inline("starts"))
    held = held.withColumns({"room": n - F.col("start"), "reach": F.slice("tokens", F.col("start") + 1, F.lit(max(LENGTHS)))}).drop("tokens")
    return table(held.repartition(parts, *own, "idx", "start"), "starts")


def _starts_in_documents(frags: DataFrame, least: int) -> DataFrame:
    """frequent_starts() of every document: fragments are shuffled once, no pair or triple is."""
    parts = int(frags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = frags.schema["doc_id"].dataType.simpleString()
    rows = frags.where(F.size("tokens") >= min(LENGTHS)).select("doc_id", "idx", "section", "tokens", F.lit(0).alias("unit"))
    rows = rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "idx")

    def run(batches):
        for pdf in packs(batches):
            yield from _places(pdf, least)

    schema = f"doc_id {kind}, idx int, section string, start int, can_fix int, quads int, room int, reach array<string>"
    return rows.mapInPandas(run, schema).repartition(parts, "doc_id", "idx", "start")


def _often(key: np.ndarray, least: int) -> np.ndarray:
    """Whether each key stands in the array `least` times."""
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[back] >= least


def _places(pdf: pd.DataFrame, least: int):
    """The places of some whole documents where a template may begin."""
    size = np.array([len(t) for t in pdf["tokens"]])
    every = np.concatenate(list(pdf["tokens"]))
    word, words = pd.factorize(every)
    row = np.repeat(np.arange(len(pdf)), size)
    start = np.arange(len(every)) - (np.cumsum(size) - size)[row]
    room = size[row] - start
    doc = pd.factorize(pdf["doc_id"])[0][row]
    token = doc.astype(np.uint64) * np.uint64(len(words)) + word.astype(np.uint64)
    begins = np.flatnonzero(room >= min(LENGTHS))
    can_fix = np.zeros(len(every), int)
    for g in range(1, max(LENGTHS)):
        at = begins[room[begins] > g]
        can_fix[at[_often(_mixed(token[at], token[at + g]), least)]] |= 1 << g
    at = np.flatnonzero(np.bitwise_count(can_fix & 0b1111110) >= 3)  # or no four tokens are left
    quads = np.zeros(len(every), int)
    for k, places in enumerate(TRIPLES):
        bits = sum(1 << p for p in places)
        here = at[can_fix[at] & bits == bits]
        key = token[here]
        for p in places:
            key = _mixed(key, token[here + p])
        quads[here[_often(key, least)]] |= 1 << k
    at = np.flatnonzero(quads)
    for a in range(0, len(at), 4096):
        p = at[a : a + 4096]
        r = row[p]
        out = {"doc_id": pdf["doc_id"].to_numpy()[r], "idx": pdf["idx"].to_numpy()[r], "section": pdf["section"].to_numpy()[r], "start": start[p], "can_fix": can_fix[p], "quads": quads[p], "room": room[p]}
        yield pd.DataFrame(out | {"reach": [every[x : x + n] for x, n in zip(p.tolist(), np.minimum(room[p], max(LENGTHS)).tolist())]})


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def occurrences(frags: DataFrame, scope: list[str], least: int = LEAST, table=lambda df, name: df, places: DataFrame | None = None) -> DataFrame:
    """(scope…, doc_id, idx, start, length, mask, window, template, section) of all
    windows that can belong to a template counted `least` times in its scope. They are
    made from the kept frequent_starts(), or the same `places` found otherwise, anew wherever
    they are read, without a shuffle."""
    spark = frags.sparkSession
    own = list(dict.fromkeys([*scope, "doc_id"]))
    rows = frequent_starts(frags, scope, least, table) if places is None else places
    needs = F.broadcast(spark.createDataFrame(_needs(), "length int, mask int, need int"))  # 215 rows
    whole = F.expr("shiftleft(1, length) - 2")
    fits = (F.col("length") <= F.col("room")) & (F.col("quads").bitwiseAND(F.col("need")) == F.col("need")) & (F.col("can_fix").bitwiseOR(F.col("mask")).bitwiseAND(whole) == whole)
    # exploded: else Spark moves filters on what is made of a window into the join, before its condition
    rows = rows.join(needs, fits).select(*own, "idx", "section", "start", "length", "mask", F.explode(F.array(F.slice("reach", F.lit(1), F.col("length")))).alias("window"))
    wild = F.transform("window", lambda t, i: F.when((F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), i))) != 0, "_").otherwise(t))
    rows = rows.withColumn("template", wild).where(F.size(F.array_distinct(F.filter("template", lambda t: t != "_"))) >= 3)
    return rows.select(*own, "idx", "start", "length", "mask", "window", "template", "section")


def template_counts(occ: DataFrame, scope: list[str], least: int = LEAST) -> DataFrame:
    """(scope…, template, count, sections, slot_variety, slots) of frequent templates."""
    # tokens hold no blanks, so the text is the template; texts are quicker keys than arrays
    key = [*scope, "text"]
    occ = occ.withColumn("text", F.array_join("template", " "))
    slots = F.transform(F.filter(F.arrays_zip("template", "window"), lambda x: x["template"] == "_"), lambda x, i: F.struct(i.alias("slot"), x["window"].alias("value")))
    facts = F.concat(slots, F.array(F.struct(F.lit(-1).alias("slot"), F.col("section").alias("value"))))
    # windows are pruned already: to count them first to leave out the rest would make all of them twice
    facts = occ.select(*key, F.inline(facts)).groupBy(*key, "slot", "value").agg(F.count("*").alias("n"))
    slot = F.col("slot") >= 0
    out = facts.groupBy(*key).agg(F.sum(F.when(~slot, F.col("n"))).alias("count"), F.count_if(~slot).alias("sections"), F.count_if(slot).alias("slot_variety"), (F.max("slot") + 1).alias("slots")).where(F.col("count") >= least)
    return out.select(*scope, F.split("text", " ").alias("template"), "count", "sections", "slot_variety", "slots")


def ranked_templates(counts: DataFrame, scope: list[str]) -> DataFrame:
    """Templates whose slots vary, with score (rounded to 6 places) and rank in their scope."""
    n = F.size("template")
    score = F.col("count") * (1 + F.least(F.col("slot_variety"), F.lit(24)) / 8) * (1 + F.col("slots") / 3) * ((n - F.col("slots")) / n) * (1 + F.least(F.col("sections"), F.lit(4)) / 8)
    rows = counts.where(F.col("slot_variety") > F.col("slots")).withColumn("text", F.array_join("template", " ")).withColumn("score", F.round(score, 6))
    ties = [F.desc("count"), F.desc("slot_variety"), F.desc(F.size("template")), F.asc("text")]
    if scope:
        return rows.withColumn("rank", F.row_number().over(W.partitionBy(*scope).orderBy(F.desc("score"), *ties)))
    return _ranked_by_ranges(rows)


def _ranked_by_ranges(rows: DataFrame, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """rows with their rank by score, ties as in ranked_templates(); two ranges or more. The order is cut at
    quantiles of the `sample` rows least by a hash, so a range is a task's share even where
    most scores are equal; ranks are places in a range after the sizes of those before it.
    Cuts and sizes are scalar subqueries of at most `ranges` values. Any cuts give the same
    ranks, and these don't change when a task is run again."""
    order = F.struct((-F.col("score")).alias("s"), (-F.col("count")).alias("c"), (-F.col("slot_variety")).alias("v"), (-F.size("template")).alias("n"), "text")
    rows = rows.withColumn("order", order)
    some = rows.select("order", F.xxhash64("text").alias("h")).orderBy("h", "order").limit(sample).agg(F.array_sort(F.collect_list("order")).alias("o"))
    steps = F.sequence(F.lit(1), F.lit(ranges - 1))
    cuts = some.select(F.transform(steps, lambda i: F.get("o", F.floor(i * F.size("o") / ranges).cast("int"))).alias("cuts"))
    rows = rows.withColumn("cuts", cuts.scalar()).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("order")))).drop("cuts")
    sizes = rows.groupBy("range").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("range", "n")).alias("sizes"))
    before = lambda k: F.aggregate(F.filter("sizes", lambda x: x["range"] < k), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    above = sizes.select(F.transform(F.sequence(F.lit(0), F.lit(ranges - 1)), before).alias("above"))
    place = F.row_number().over(W.partitionBy("range").orderBy("order"))
    return rows.withColumn("rank", (F.get(above.scalar(), F.col("range")) + place).cast("int")).drop("order", "range")


def _greedy(rows) -> list:
    """Ranks kept: a template goes if 0.72 of the smaller footprint is shared with a kept one."""
    kept: list[tuple] = []
    for rank, footprint in rows:
        f = set(footprint)
        if all(len(f & g) / max(1, min(len(f), len(g))) < OVERLAP for _, g in kept):
            kept.append((rank, f))
            if len(kept) >= MOST:
                break
    return [r for r, _ in kept]


def _clashes(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b): templates of x(rank, place) whose footprints share OVERLAP of the smaller one
    with those of y."""
    size = lambda df, name: df.groupBy(F.col("rank").alias(name)).agg(F.count("*").alias(f"n_{name}"))
    both = x.select(F.col("rank").alias("a"), "place").join(y.select(F.col("rank").alias("b"), "place"), "place").where("a <> b")
    both = both.groupBy("a", "b").agg(F.count("*").alias("shared")).join(size(x, "a"), "a").join(size(y, "b"), "b")
    return both.where(F.col("shared") / F.least("n_a", "n_b") >= OVERLAP).select("a", "b")


def _shared_places(x: DataFrame) -> DataFrame:
    """(a, b, shared) with a <= b: how many places two templates of x(rank, place) both cover;
    of one and itself, its own places. Places under the same templates are counted together
    first, so a much-covered stretch of text gives its pairs once."""
    sets = x.groupBy("place").agg(F.array_sort(F.collect_set("rank")).alias("ranks")).groupBy("ranks").agg(F.count("*").alias("n"))
    both = sets.select("ranks", "n", F.explode("ranks").alias("a")).select("a", "n", F.explode("ranks").alias("b")).where("a <= b")
    return both.groupBy("a", "b").agg(F.sum("n").alias("shared"))


def _greedy_joins(prints: DataFrame, batch: int = BATCH, kept: tuple | list = (), held: DataFrame | None = None, most: int | None = None) -> list[int]:
    """_greedy over prints(rank, place) of one scope of any size, after the ranks in `kept`, all
    of them lower, whose footprints are `held`. Of the next `batch` ranks that clash with no
    kept one, only pairs with their counts meet on the driver, 32,896 at most of 256 ranks;
    footprints never do."""
    prints = prints.persist(StorageLevel.MEMORY_AND_DISK)
    free = prints.select("rank").distinct()
    if kept:
        free = free.join(_clashes(held, prints).select(F.col("b").alias("rank")), "rank", "left_anti")
    kept, most = list(kept), most or MOST
    while len(kept) < most:
        ranks = sorted(r["rank"] for r in free.orderBy("rank").limit(batch).collect())
        part = prints.where(F.col("rank").between(ranks[0], ranks[-1]) & F.col("rank").isin(ranks)) if ranks else None
        shared = {(r["a"], r["b"]): r["shared"] for r in _shared_places(part).collect()} if ranks else {}
        pairs = {(a, b) for (a, b), n in shared.items() if a < b and n / min(shared[a, a], shared[b, b]) >= OVERLAP}
        new: list[int] = []
        for r in ranks:
            if len(kept) + len(new) < most and not any((k, r) in pairs for k in new):
                new.append(r)
        kept += new
        if len(ranks) < batch:
            break
        after = prints.where(F.col("rank") > ranks[-1])
        own = prints.where(F.col("rank").isin(kept))
        gone = _clashes(own if held is None else held.union(own), after).select(F.col("b").alias("rank"))
        free = after.select("rank").distinct().join(gone, "rank", "left_anti")
    prints.unpersist()
    return kept


def _greedy_ranges(prints, last: int, first: int = LEADING, most: int | None = None) -> list[int]:
    """_greedy over ranks 1 to `last`; prints(low, high, ranks) makes the footprints of the
    ranks from low to high, or of those given. They are made of ever larger ranges until `most`
    are kept, as nothing behind the last kept one is ever asked for."""
    kept: list[int] = []
    low, high = 1, first
    while low <= last and len(kept) < (most or MOST):
        held = prints(1, low - 1, kept).persist(StorageLevel.MEMORY_AND_DISK) if kept else None
        kept = _greedy_joins(prints(low, high, None), BATCH, kept, held, most)
        if held is not None:
            held.unpersist()
        low, high = high + 1, high * MORE
    return kept


def dedup_templates(ranked: DataFrame, occ: DataFrame, scope: list[str], most: int | None = None) -> DataFrame:
    """The ranked templates that survive, at most MOST a scope, with model_rank from 1; of larger
    scopes than documents `most`, if given. Documents are walked on their own; larger scopes by
    joins on the places they cover."""
    key = [*scope, "template"]
    places = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda k: F.xxhash64("doc_id", "idx", F.col("start") + k))
    spark = ranked.sparkSession
    if scope == ["doc_id"]:
        covered = occ.join(ranked.select(*key, "rank"), key)
        prints = covered.groupBy(*scope, "rank").agg(F.array_distinct(F.flatten(F.collect_list(places))).alias("footprint"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rank")
            kept = _greedy(zip(pdf["rank"], pdf["footprint"]))
            return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]] * len(kept), "rank": kept})

        kept = prints.groupBy(*scope).applyInPandas(run, f"doc_id {ranked.schema['doc_id'].dataType.simpleString()}, rank int")
    else:
        last = [(tuple(r[c] for c in scope), r["last"]) for r in ranked.groupBy(*scope).agg(F.max("rank").alias("last")).collect()]
        rows = []
        for v, n in last:
            own = ranked.select(*key, "rank")
            for c, x in zip(scope, v):
                own = own.where(F.col(c) == F.lit(x))

            def prints(low, high, ranks, own=own):
                some = own.where(F.col("rank").between(low, high))
                some = some if ranks is None else some.where(F.col("rank").isin(ranks))
                some = F.broadcast(some) if ranks is not None or high - low < SMALL else some
                return occ.join(some, key).select("rank", F.explode(places).alias("place")).distinct()

            rows += [(*v, r) for r in _greedy_ranges(prints, n or 0, most=most)]
        fields = "".join(f"{c} {ranked.schema[c].dataType.simpleString()}, " for c in scope)
        kept = F.broadcast(spark.createDataFrame(rows, fields + "rank int"))  # MOST rows a scope
    out = ranked.join(kept, [*scope, "rank"])
    order = W.partitionBy(*scope) if scope else W.partitionBy(F.lit(0))  # MOST rows
    # cascades go by count, ties by rank
    return out.withColumn("model_rank", F.row_number().over(order.orderBy(F.desc("count"), "rank")))


def hot_tokens(counts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope…, token, n): fixed occurrences, those of two or more, over the templates counted
    twice or more (counts of least=2)."""
    fixed = counts.select(*scope, F.explode(F.filter("template", lambda t: t != "_")).alias("token"))
    return fixed.groupBy(*scope, "token").agg(F.count("*").alias("n")).where(F.col("n") >= 2)


def model_probabilities(chosen: DataFrame, occ: DataFrame, scope: list[str]) -> DataFrame:
    """(scope…, model_rank, length, source_count, pos, token, n, prob): how often a token
    stands at a position in the windows of a chosen template."""
    key = [*scope, "template"]
    rows = occ.join(chosen.select(*key, "model_rank", F.col("count").alias("source_count")), key)
    cells = rows.select(*scope, "model_rank", "length", "source_count", F.posexplode("window").alias("pos", "token"))
    counts = cells.groupBy(*scope, "model_rank", "length", "source_count", "pos", "token").agg(F.count("*").alias("n"))
    return counts.withColumn("prob", F.col("n") / F.col("source_count"))


def soft_text(probs: DataFrame, scope: list[str]) -> DataFrame:
    """(scope…, model_rank, soft_text): the top token where its share is .84, else the top three."""
    per = probs.groupBy(*scope, "model_rank", "pos").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "token", "prob"))).alias("t"))
    top = F.get("t", F.lit(0))
    cell = F.when(top["prob"] >= SOFT, top["token"]).otherwise(F.concat(F.lit("{"), F.array_join(F.transform(F.slice("t", 1, 3), lambda x: x["token"]), "/"), F.lit("}")))
    rows = per.withColumn("cell", cell).groupBy(*scope, "model_rank").agg(F.array_sort(F.collect_list(F.struct("pos", "cell"))).alias("cells"))
    return rows.select(*scope, "model_rank", F.array_join(F.transform("cells", lambda c: c["cell"]), " ").alias("soft_text"))


def top_tokens(probs: DataFrame, scope: list[str], top: int = 5) -> DataFrame:
    """The most frequent tokens of every position, ties by token, with place from 1."""
    order = W.partitionBy(*scope, "model_rank", "pos").orderBy(F.desc("n"), "token")
    return probs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def pattern_candidates(frags: DataFrame, probs: DataFrame, scope: list[str], min_score: float = 0.52) -> DataFrame:
    """(doc_id, model_rank, idx, para_index, start, score, matched, peak): the best window
    of every fragment for every model. A window is scored by the model cells its tokens
    meet. A corpus's models go to where the fragments lie; a document's own, and those of too
    many cells, meet tokens in an equi-join, so windows that meet nothing cost nothing."""
    from echosieve.operators import leading

    best = F.row_number().over(W.partitionBy("doc_id", "model_rank", "idx").orderBy(F.desc("score"), F.desc("matched"), "start"))
    if not scope:
        cells = probs.select("model_rank", "length", "pos", "token", "prob").limit(leading.CELLS + 1).toArrow()
        if cells.num_rows <= leading.CELLS:
            wins = leading.best_windows(frags, cells, min_score).withColumn("score", F.round(F.col("total") / F.col("length"), 9))
            wins = wins.where(F.col("score") >= min_score).select("doc_id", "model_rank", "idx", "para_index", "start", "score", "matched", "peak")
            return wins.withColumn("best", best).where("best = 1").drop("best")
    words = frags.select("doc_id", "idx", "para_index", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("at", "token"))
    cells = probs.select(*scope, "model_rank", "length", "pos", "token", "prob")
    hits = words.join(cells, [*scope, "token"]).withColumn("start", F.col("at") - F.col("pos"))
    hits = hits.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_tokens")))
    wins = hits.groupBy("doc_id", "model_rank", "idx", "para_index", "start", "length").agg(F.round(F.sum("prob") / F.col("length"), 9).alias("score"), F.count("*").alias("matched"), F.max("prob").alias("peak"))
    wins = wins.where((F.col("matched") >= F.greatest(F.lit(3), F.floor(F.col("length") * 0.68))) & (F.col("score") >= min_score))
    return wins.withColumn("best", best).where("best = 1").drop("best", "length")


def top_candidates(cands: DataFrame, top: int = 20) -> DataFrame:
    """The best candidates of every document, with place from 1."""
    order = W.partitionBy("doc_id").orderBy(F.desc("score"), "idx")
    return cands.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def select_candidates(cands: DataFrame, policy: str) -> DataFrame:
    """The candidates a policy removes. keep-N leaves the N best of a paragraph;
    threshold-dedup leaves the best of those over max(.58, the score at .72 of the order)."""
    best = W.partitionBy("doc_id", "model_rank", "para_index").orderBy(F.desc("score"), "idx")
    if policy == "off":
        return cands.where("false")
    if policy.startswith("keep-"):
        return cands.withColumn("place", F.row_number().over(best)).where(F.col("place") > int(policy[5:])).drop("place")
    if policy != "threshold-dedup":
        raise ValueError(f"unknown policy {policy!r}")
    model = W.partitionBy("doc_id", "model_rank")
    ranked = cands.withColumn("order", F.row_number().over(model.orderBy("score", "idx"))).withColumn("n", F.count("*").over(model))
    at = F.max(F.when(F.col("order") == F.floor(F.col("n") * 0.72) + 1, F.col("score"))).over(model)
    ranked = ranked.withColumn("threshold", F.greatest(F.lit(0.58), at)).where(F.col("score") >= F.col("threshold"))
    return ranked.withColumn("place", F.row_number().over(best)).where("place > 1").drop("place", "order", "n", "threshold")


def cascade(selected: DataFrame) -> DataFrame:
    """The first model, by model_rank, that selects a fragment has it."""
    first = F.row_number().over(W.partitionBy("doc_id", "idx").orderBy("model_rank"))
    return selected.withColumn("first", first).where("first = 1").drop("first")
