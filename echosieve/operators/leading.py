"""The leading templates of a corpus, mined without counting the rest.

A template's score is at most its count times a ceiling, so where the last of the chosen
scores more than the ceiling allows to any that is counted less than `least`, no such one
would have been ranked before it, and templates counted `least` times decide the choice.
`least` is lowered until that is so, to LEAST at most, where everything is mined."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echosieve.operators import templates as P

#: Bits of the buckets that first tokens with three more, or with one of the last two, are counted in, and of a stretch of buckets.
BITS, STRETCH = 24, 18
#: Bits of the filter of exact counts.
FILTER = 26
#: Buckets that the first `least` leaves.
FIRST = 1536
#: Ranks that are looked at together, and rows of their table of shared places that are summed together.
RANKS, ROWS = 1024, 64
#: Gaps that no three places of TRIPLES reach; they are met with the first token alone.
FAR = (7, 8)


def ceiling(sections: int) -> float:
    """The most that a template scores a count, in a corpus of so many sections."""
    shape = max((1 + k / 3) * ((n - k) / n) for n, k in {(n, m.bit_count()) for n, m in P.masks()})
    return (1 + 24 / 8) * shape * (1 + min(sections, 4) / 8)


def leading(frags: DataFrame, table, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, occ): the templates that dedup_templates() chooses of all templates of the
    corpus, `most` of them at most, and occurrences() that hold all of theirs."""
    most = most or P.MOST
    tallies = table(bucket_counts(frags), "buckets")
    top = ceiling(frags.select("section").distinct().limit(4).count())
    least = _first_least(tallies)
    while True:
        places = None if least <= P.LEAST else table(frequent_places(frags, tallies, least), "starts")
        occ = P.occurrences(frags, [], least, table, places)
        ranked = table(P.ranked_templates(table(P.template_counts(occ, [], least), "counts"), []), "ranked")
        chosen = table(chosen_templates(ranked, occ, most), "chosen")
        if least <= P.LEAST:
            return chosen, occ
        n, score = chosen.agg(F.count("*"), F.min("score")).first()
        if n == most and score > (least - 1) * top + 1e-5:  # scores are rounded to 6 places
            return chosen, occ
        lower = math.floor((score - 1e-4) / top) + 1 if n == most else least // 4
        least = max(P.LEAST, min(least - 1, lower))


def _first_least(tallies: DataFrame) -> int:
    """The least count of the FIRST buckets that are counted most, to a power of 2^(1/4)."""

    def run(batches):
        for batch in batches:
            for c in batch.column("counts").to_pylist():
                n = np.floor(np.log2(np.frombuffer(c, np.uint32)) * 4).astype(int)
                level, many = np.unique(n, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(many.astype(np.int64))], ["level", "n"])

    rows = tallies.select("counts").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    left = FIRST
    for r in rows:
        left -= r["n"]
        if left <= 0:
            return max(P.LEAST, math.floor(2 ** (r["level"] / 4)))
    return P.LEAST


def _tokens(batch: pa.RecordBatch):
    """(hashes of all tokens, number of the row of each, tokens from there to the row's end, tokens)."""
    lists = batch.column("tokens")
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    every = lists.flatten()
    d = every.dictionary_encode()
    word = pd.util.hash_array(np.array(d.dictionary.to_pylist(), object), categorize=False)[d.indices.to_numpy(zero_copy_only=False)] if len(every) else np.zeros(0, np.uint64)
    ends = np.repeat(np.cumsum(size), size)
    return word, np.repeat(np.arange(len(size)), size), ends - np.arange(len(word)), every


def _keys(word: np.ndarray, room: np.ndarray):
    """(bit, places, their hashes) for every one of TRIPLES and, numbered behind them, of FAR."""
    begins = np.flatnonzero(room >= min(P.LENGTHS))
    for k, t in enumerate([*P.TRIPLES, *[(g,) for g in FAR]]):
        at = begins[room[begins] > t[-1]]
        key = P._mixed(word[at], np.full(len(at), k, np.uint64))
        for p in t:
            key = P._mixed(key, word[at + p])
        yield k, at, key


def _long_enough(frags: DataFrame) -> DataFrame:
    return frags.select("doc_id", "idx", "section", "tokens").where(F.size("tokens") >= min(P.LENGTHS))


def bucket_counts(frags: DataFrame) -> DataFrame:
    """(stretch, buckets, counts): how many keys of the corpus fall in each bucket, those of
    LEAST or more, as packed numbers. A task counts in an array of fixed size, so what is
    shuffled grows with the tasks, which are as many as the cores, and not with the text."""
    few = max(2, frags.sparkSession.sparkContext.defaultParallelism)

    def count(batches):
        tally = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            word, _, room, _ = _tokens(batch)
            for _, _, key in _keys(word, room):
                np.add.at(tally, (key >> np.uint64(64 - BITS)).astype(np.int64), np.uint32(1))
        for s in range(1 << (BITS - STRETCH)):
            part = tally[s << STRETCH : (s + 1) << STRETCH]
            at = np.flatnonzero(part).astype(np.uint32)
            if len(at):
                yield _stretch(s, at, part[at])

    def add(t):
        tally = np.zeros(1 << STRETCH, np.uint32)
        for b, c in zip(t.column("buckets"), t.column("counts")):
            tally[np.frombuffer(b.as_buffer(), np.uint32)] += np.frombuffer(c.as_buffer(), np.uint32)
        at = np.flatnonzero(tally >= P.LEAST).astype(np.uint32)
        return pa.Table.from_batches([_stretch(t.column("stretch")[0].as_py(), at, tally[at])])

    schema = "stretch int, buckets binary, counts binary"
    return _long_enough(frags).select("tokens").coalesce(few).mapInArrow(count, schema).groupBy("stretch").applyInArrow(add, schema)


def _stretch(s: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["stretch", "buckets", "counts"])


def _often_buckets(tallies: DataFrame, least: int) -> np.ndarray:
    """Bits of the buckets counted `least` times, 2 MB in all."""
    per = 1 << STRETCH

    def run(batches):
        for batch in batches:
            for s, b, c in zip(batch.column("stretch").to_pylist(), batch.column("buckets").to_pylist(), batch.column("counts").to_pylist()):
                bits = np.zeros(per, bool)
                bits[np.frombuffer(b, np.uint32)[np.frombuffer(c, np.uint32) >= least]] = True
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["stretch", "bits"])

    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in tallies.mapInArrow(run, "stretch int, bits binary").collect():
        out[r["stretch"] * per // 8 : (r["stretch"] + 1) * per // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def frequent_places(frags: DataFrame, tallies: DataFrame, least: int) -> DataFrame:
    """frequent_starts() of the corpus by its bucket counts: only keys of buckets counted
    `least` times are shuffled to be counted themselves, then only the places that begin with
    some counted `least` times are made."""
    sc = frags.sparkSession.sparkContext
    parts = int(frags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = frags.schema["doc_id"].dataType.simpleString()
    rough = sc.broadcast(_often_buckets(tallies, least))
    low = np.uint64((1 << FILTER) - 1)
    inside = lambda key: _held(rough.value, key >> np.uint64(64 - BITS))

    def count(batches):
        held, n = [], 0
        for batch in batches:
            word, _, room, _ = _tokens(batch)
            keys = [key[inside(key)] for _, _, key in _keys(word, room)]
            held.append(np.unique(np.concatenate(keys), return_counts=True))
            n += len(held[-1][0])
            if n > 1 << 20:
                yield _summed(held)
                held, n = [], 0
        if held:
            yield _summed(held)

    keys = _long_enough(frags).select("tokens").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    fine = np.zeros((1 << FILTER) // 64, np.uint64)
    at = F.col("h").bitwiseAND((1 << FILTER) - 1)
    bits = keys.groupBy(F.shiftright(at, 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("bits")).toArrow()
    fine[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    fine = sc.broadcast(fine.view(np.uint8))
    near = sum(1 << g for g in range(1, min(FAR)))

    def places(batches):
        for batch in batches:
            word, row, room, every = _tokens(batch)
            quads, can_fix = np.zeros(len(word), np.int32), np.full(len(word), near, np.int32)
            for k, at, key in _keys(word, room):
                some = inside(key)
                at, key = at[some], key[some]
                at = at[_held(fine.value, key & low)]
                if k < len(P.TRIPLES):
                    quads[at] |= 1 << k
                else:
                    can_fix[at] |= 1 << FAR[k - len(P.TRIPLES)]
            at = np.flatnonzero(quads)
            for a in range(0, len(at), 8192):
                p = at[a : a + 8192]
                size = np.minimum(room[p], max(P.LENGTHS))
                ends = np.cumsum(size)
                reach = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), every.take(pa.array(np.arange(ends[-1]) - np.repeat(ends - size - p, size))))
                own = batch.select(["doc_id", "idx", "section"]).take(pa.array(row[p]))
                start = (p - np.searchsorted(row, row[p])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, (start, can_fix[p], quads[p], room[p].astype(np.int32))), reach], ["doc_id", "idx", "section", "start", "can_fix", "quads", "room", "reach"])

    schema = f"doc_id {kind}, idx int, section string, start int, can_fix int, quads int, room int, reach array<string>"
    return _long_enough(frags).mapInArrow(places, schema).repartition(parts, "doc_id", "idx", "start")


def _summed(held) -> pa.RecordBatch:
    key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    n = np.bincount(back, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["h", "n"])


def chosen_templates(ranked: DataFrame, occ: DataFrame, most: int) -> DataFrame:
    """dedup_templates() of a corpus: of RANKS ranks at a time and those kept before them, the
    numbers of places that each two share meet on the driver, 9 MB of them."""
    last, kept = ranked.count(), []
    for low in range(1, last + 1, RANKS):
        ids = [*kept, *range(low, min(last + 1, low + RANKS))]
        number = F.broadcast(ranked.sparkSession.createDataFrame(list(zip(ids, range(len(ids)))), "rank int, id int"))
        shared = _shared(occ, ranked.join(number, "rank").select("template", "id"), len(ids))
        size = shared.diagonal()
        new = list(range(len(kept)))
        for i in range(len(kept), len(ids)):
            if all(shared[i, k] / max(1, min(size[i], size[k])) < P.OVERLAP for k in new):
                new.append(i)
                if len(new) == most:
                    break
        kept = [ids[i] for i in new]
        if len(kept) == most:
            break
    out = ranked.join(F.broadcast(ranked.sparkSession.createDataFrame([(r,) for r in kept], "rank int")), "rank")
    return out.withColumn("model_rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("count"), "rank")))  # `most` rows


def _shared(occ: DataFrame, some: DataFrame, n: int) -> np.ndarray:
    """How many places the templates some(template, id) cover by twos. Windows that cover a
    place are of one fragment; only they are shuffled. A task holds a table of fixed size."""
    few = max(2, occ.sparkSession.sparkContext.defaultParallelism)
    rows = occ.join(F.broadcast(some), "template").select("doc_id", "idx", "start", (F.col("start") + F.col("length")).alias("end"), "id")
    rows = rows.repartition(few, "doc_id", "idx").sortWithinPartitions("doc_id", "idx", "start")

    def run(frames):
        total, held = np.zeros((n, n), np.int64), None
        for pdf in frames:
            if not len(pdf):
                continue
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            frag = (held["doc_id"].ne(held["doc_id"].shift()) | held["idx"].ne(held["idx"].shift())).to_numpy().cumsum()
            at = held["start"].iloc[-1]  # places before it are covered by no later window
            final = held["end"].to_numpy().copy()
            final[frag == frag[-1]] = np.minimum(final[frag == frag[-1]], at)
            _add_shared(total, frag, held["start"].to_numpy(), final, held["id"].to_numpy())
            held = held[(frag == frag[-1]) & (held["end"] > at).to_numpy()]
            held = held.assign(start=held["start"].clip(lower=at))
        if held is not None:
            _add_shared(total, np.zeros(len(held), int), held["start"].to_numpy(), held["end"].to_numpy(), held["id"].to_numpy())
        yield pd.DataFrame({"part": range(0, n, ROWS), "counts": [total[a : a + ROWS].tobytes() for a in range(0, n, ROWS)]})

    def add(pdf):
        sums = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [sums.tobytes()]})

    schema = "part int, counts binary"
    out = np.zeros((n, n), np.int64)
    for r in rows.mapInPandas(run, schema).groupBy("part").applyInPandas(add, schema).collect():
        out[r["part"] : r["part"] + ROWS] = np.frombuffer(r["counts"], np.int64).reshape(-1, n)
    return out


def _add_shared(total: np.ndarray, frag: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> None:
    """Adds the places from start to end of a fragment that templates share; places under the
    same templates are counted together."""
    size = np.maximum(end - start, 0)
    if not size.sum():
        return
    spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)
    place, back = np.unique((np.repeat(frag, size).astype(np.int64) << 32) | spot, return_inverse=True)
    ids = np.repeat(ids, size)
    order = np.argsort(back, kind="stable")
    back, ids = back[order], ids[order]
    for a in range(0, len(place), 8192):
        x = slice(*np.searchsorted(back, (a, a + 8192)))
        under = np.zeros((min(8192, len(place) - a), len(total)), bool)
        under[back[x] - a, ids[x]] = True
        packed = np.packbits(under, axis=1)
        _, first, n = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True, return_counts=True)
        sets = under[first].astype(np.float32)
        total += ((sets.T * n.astype(np.float32)) @ sets).astype(np.int64)


#: Cells of models that every worker holds; models of more are met by joins.
CELLS = 1 << 21


def best_windows(frags: DataFrame, cells: pa.Table, min_score: float) -> DataFrame:
    """(doc_id, idx, para_index, model_rank, start, length, total, matched, peak): the windows
    of every fragment that may be its best for a model, by cells(model_rank, length, pos, token,
    prob), scored where the fragments lie."""
    kind = frags.schema["doc_id"].dataType.simpleString()
    d = cells.column("token").combine_chunks().dictionary_encode()
    code = d.indices.to_numpy(zero_copy_only=False)
    rank, length, pos, prob = (cells.column(c).to_numpy() for c in ("model_rank", "length", "pos", "prob"))
    models = []
    for r in np.unique(rank).tolist():
        x = rank == r
        models.append((r, int(length[x][0]), code[x], pos[x].astype(np.int64), prob[x].astype(float)))
    shared = frags.sparkSession.sparkContext.broadcast((d.dictionary, models))

    def run(batches):
        words, models = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                yield from _windows(batch.slice(a, 8192), words, models, min_score)

    schema = f"doc_id {kind}, idx int, para_index int, model_rank int, start int, length int, total double, matched long, peak double"
    return frags.select("doc_id", "idx", "para_index", "tokens").mapInArrow(run, schema)


def _windows(batch: pa.RecordBatch, words: pa.Array, models: list, min_score: float):
    """Of a fragment's windows for a model only those within 1e-6 of the best sum are given."""
    lists = batch.column("tokens")
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    d = lists.flatten().dictionary_encode()
    if not len(d):
        return
    own = len(d.dictionary)
    known = pc.index_in(d.dictionary, words).to_numpy(zero_copy_only=False)
    here = np.full(len(words), -1)
    some = np.flatnonzero(~np.isnan(known.astype(float)))
    here[known[some].astype(np.int64)] = some
    word = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    room = (first + size)[row] - np.arange(len(word))
    for rank, n, code, pos, prob in models:
        if len(word) < n:
            continue
        at = here[code]
        x = at >= 0
        bits, cell = np.zeros(own, np.uint16), np.zeros((n, own))
        np.bitwise_or.at(bits, at[x], (1 << pos[x]).astype(np.uint16))
        cell[pos[x], at[x]] = prob[x]
        may = bits[word]
        matched = np.zeros(len(word) - n + 1, np.uint16)
        for p in range(n):
            matched += (may[p : p + len(matched)] >> np.uint16(p)) & np.uint16(1)
        win = np.flatnonzero((matched >= max(3, math.floor(n * 0.68))) & (room[: len(matched)] >= n))
        values = cell[np.arange(n)[:, None], word[win + np.arange(n)[:, None]]]
        total = np.zeros(len(win))
        for p in range(n):
            total += values[p]
        x = total / n >= min_score - 1e-6
        win, total, values = win[x], total[x], values[:, x]
        best = np.full(len(size), -1.0)
        np.maximum.at(best, row[win], total)
        x = total >= best[row[win]] - 1e-6
        win, total, values = win[x], total[x], values[:, x]
        if len(win):
            rows = batch.select(["doc_id", "idx", "para_index"]).take(pa.array(row[win]))
            numbers = [np.full(len(win), rank, np.int32), (win - first[row[win]]).astype(np.int32), np.full(len(win), n, np.int32), total, matched[win].astype(np.int64), values.max(axis=0)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, numbers)], ["doc_id", "idx", "para_index", "model_rank", "start", "length", "total", "matched", "peak"])
