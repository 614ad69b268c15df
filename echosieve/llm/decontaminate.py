"""Benchmark decontamination by latent semantic retrieval.

Candidates come from a bound that loses nothing: where SHARE of an item's n words occur
in order, at least SHARE n words of the span are the item's, and so many of any part of
its words as the rest can't make up for. The part is the item's rarest words in the
corpus, so that few places have enough of them. The longest common subsequence with the
item, over a span little longer than it, and the item's last words (its answer) decide.

What is found is scored by the cosine of its span with the item in a latent space over
all the benchmark's words, weighted by idf, which an item's own copies hardly lower. A
randomised block-Krylov step gives the space: the starting block S holds the benchmark's
passages and Gaussian probes, every partition adds up A'(A S) for its passages A, and
the space is spanned by the benchmark's passages and the leading singular directions of
the sum.

Texts are read twice, and once more where candidates are. All that is broadcast has
the size of a block of ITEMS benchmark rows, whatever the corpus; larger benchmarks
take several blocks."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import Scratch, grouped, keep_ids, list_views, one_row_per_id, tidy

WINDOW, ITEMS, PROBES, LATENT = 80, 256, 32, 64
SHARE, ANSWER = 0.6, 0.5
#: An item's rarest words are searched for, so many that SPARE of its words must be among them; pairs of a word and an item are held PAIRS at once.
SPARE, PAIRS = 0.15, 1 << 22
#: ASCII other than letters and digits ends words; other characters belong to them.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _frequency(vocabulary):
    """Document frequencies of the vocabulary over a task's texts; row -1 counts texts."""

    def run(batches):
        index = vocabulary.value
        df, n = np.zeros(len(index), np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                n += 1
                for w in index.keys() & set(words_of(x.as_py())):
                    df[index[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df), dtype=np.int32)), pa.array(np.append(n, df))], names=["word", "df"])

    return run


def _hits(vocabulary):
    """Places and numbers of a text's vocabulary words; texts without any are left out."""

    def run(batches):
        get = vocabulary.value.get
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids, places, words, sizes = [], [], [], []
                for i, x in zip(part.column(0).to_pylist(), part.column(1)):
                    w = np.fromiter((get(v, -1) for v in words_of(x.as_py())), np.int32)
                    at = np.flatnonzero(w >= 0)
                    if len(at):
                        ids.append(i), places.append(at.astype(np.int32)), words.append(w[at]), sizes.append(len(at))
                off = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat = [np.concatenate(v) if v else np.empty(0, np.int32) for v in (places, words)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.ListArray.from_arrays(off, pa.array(v, pa.int32())) for v in flat)], names=["id", "places", "words"])

    return run


def windows(batch: pa.RecordBatch, width: int):
    """(row, window, word) of every distinct word of every window."""
    off, places = list_views(batch.column("places"))
    _, x = list_views(batch.column("words"))
    r = np.repeat(np.arange(batch.num_rows), np.diff(off))
    w = places // width
    wide, many = int(w.max(initial=0)) + 1, int(x.max(initial=0)) + 1
    key = np.unique((r * wide + w) * many + x)
    key, x = np.divmod(key, many)
    return *np.divmod(key, wide), x


def _krylov(model):
    """A'(A S) of a task's passages, a few of them at a time as a dense matrix."""

    def run(batches):
        weights, start = model.value
        scaled = start * weights[:, None]
        total = np.zeros(start.shape, np.float64)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                r, w, x = windows(batch.slice(a, 256), WINDOW)
                if not len(r):
                    continue
                passage = np.cumsum(np.append(False, (r[1:] != r[:-1]) | (w[1:] != w[:-1])))
                cuts = np.searchsorted(passage, np.arange(0, passage[-1] + 65, 64))
                for b, e in zip(cuts, cuts[1:]):
                    at, k = np.unique(x[b:e], return_inverse=True)
                    has = np.zeros((64, len(at)), np.float32)
                    has[passage[b:e] - passage[b], k] = 1
                    total[at] += has.T @ (has @ scaled[at])
        total *= weights[:, None]
        step = 64
        blocks = [(a // step, total[a : a + step]) for a in range(0, len(total), step)]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([t.tobytes() for _, t in blocks], pa.binary())], names=["block", "sums"])

    return run


def _sum(group: pa.Table):
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("sums"))
    yield pa.RecordBatch.from_arrays([pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])


def bound(items: list[list[bytes]], index: dict, df: np.ndarray):
    """(starts, items by word, need, reach): verify() can only accept item k where at least
    need[k] words of a span of reach[k] are among those that list k."""
    lists: list[list[int]] = [[] for _ in index]
    need = np.zeros(len(items), np.int64)
    for k, x in enumerate(items):
        n, count = len(x), Counter(x)
        least = next(j for j in range(1, n + 1) if j / n >= SHARE)
        held = 0
        for w in sorted(count, key=lambda w: (df[index[w]], w)):
            if held - (n - least) >= SPARE * n and held > n - least:
                break
            lists[index[w]].append(k)
            held += count[w]
        need[k] = least - (n - held)
    starts = np.cumsum([0, *map(len, lists)])
    return starts, np.array([k for v in lists for k in v], np.uint16), need, np.array([reach_of(len(x)) for x in items])


def _anchors(limits, at, words):
    """(item, place) of every place from which on an item's reach has the words it needs."""
    starts, lists, need, reach = limits
    size = np.diff(starts)[words]
    n = int(size.sum())
    of = lists[np.arange(n) + np.repeat(starts[words] - (np.cumsum(size) - size), size)]
    order = np.argsort(of, kind="stable")
    item, place = of[order].astype(np.int64), np.repeat(at, size)[order]
    end = np.arange(n) + need[item] - 1
    ok = end < n
    end = np.minimum(end, n - 1)
    ok &= (item[end] == item) & (place[end] - place < reach[item])
    return item[ok], place[ok]


def _search(model):
    """(id, item, lo, hi): where a text has the words that an item needs, by words."""

    def run(batches):
        limits, owner = model.value
        size, reach = np.diff(limits[0]), limits[3]
        far = int(reach.max())
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                off, places = list_views(part.column("places"))
                _, words = list_views(part.column("words"))
                # texts one after another, further apart than any reach
                base = np.cumsum(np.append(0, places[off[1:] - 1].astype(np.int64) + 1 + far))
                at = np.repeat(base[:-1], np.diff(off)) + places
                rare = size[words] > 0
                at, words = at[rare], words[rare]
                pairs = np.cumsum(size[words])
                items, found, first = [], [], 0
                while first < len(at):
                    last = np.searchsorted(pairs, (pairs[first - 1] if first else 0) + PAIRS, "right")
                    last = max(last, np.searchsorted(at, at[first] + 2 * far, "right"))
                    item, place = _anchors(limits, at[first:last], words[first:last])
                    items.append(item), found.append(place)
                    if last >= len(at):
                        break
                    first = np.searchsorted(at, at[last] - far)  # a reach over the cut is whole in the next part
                if not sum(map(len, found)):
                    continue
                item, place = np.concatenate(items), np.concatenate(found)
                row = np.searchsorted(base, place, "right") - 1
                order = np.lexsort((place, item, row))
                row, item, place = row[order], item[order], place[order]
                # places within a reach of each other are one region
                new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > reach[item[1:]]))
                at = np.flatnonzero(new)
                end = np.append(at[1:], len(row)) - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row[at])), pa.array(owner[item[at]]), pa.array(place[at] - base[row[at]]), pa.array(place[end] - base[row[at]] + 1)],
                    names=["id", "item", "lo", "hi"],
                )

    return run


def reach_of(n: int) -> int:
    """Words of the span in which an item of n words is looked for."""
    return n + n // 2 + 2


def common_subsequence(item: list[bytes], span: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    mask: dict[bytes, int] = {}
    for k, w in enumerate(item):
        mask[w] = mask.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in span:
        u = v & mask.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def verify(item: list[bytes], words: list[bytes], lo: int, hi: int) -> tuple[float, int]:
    """(best share of the item's words found in order in a span half as long again, its place)
    over all spans that have the answer, the item's last quarter, too; share 0 if none has
    SHARE and the answer."""
    n = len(item)
    reach = reach_of(n)
    answer = item[-max(1, n // 4) :]
    begin = max(0, lo - reach)
    stop = max(begin + 1, min(hi + reach, len(words)) - n // 2)
    own = set(item)
    held = np.array([w in own for w in words[begin : stop + reach]], bool)
    # a span that begins with a foreign word has no more than the next one
    starts = np.flatnonzero(held[: stop - begin])
    sums = np.append(0, np.cumsum(held))
    most = sums[np.minimum(starts + reach, len(held))] - sums[starts]
    best, at = 0, 0
    for a, m in zip((starts + begin).tolist(), most.tolist()):
        if m > best and m / n >= SHARE:
            span = words[a : a + reach]
            got = common_subsequence(item, span)
            if got > best and got / n >= SHARE and common_subsequence(answer, span) >= ANSWER * len(answer):
                best, at = got, a
    return best / n, at


def _decide(items, model):
    def run(batches):
        known, (index, weights, basis, queries, owner) = items.value, model.value

        def cosine(item: int, span: list[bytes]) -> float:
            at = sorted({index[w] for w in span if w in index})
            z = weights[at] @ basis[at]
            return float(queries[owner[item]] @ z / max(np.sqrt(z @ z), 1e-12))

        for batch in batches:
            out = []
            for i, x, regions in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("regions").to_pylist()):
                words = words_of(x.as_py())
                best: dict[int, tuple] = {}
                for g in regions:
                    share, at = verify(known[g["item"]], words, g["lo"], g["hi"])
                    if share >= SHARE and (-share, at) < best.get(g["item"], (0,)):
                        best[g["item"]] = (-share, at)
                out += [(i, item, -share, at, cosine(item, words[at : at + reach_of(len(known[item]))])) for item, (share, at) in best.items()]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()))], names=["id", "item_id", "share", "first_word", "cosine"])

    return run


def _space(spark: SparkSession, hits: DataFrame, index: dict, weights: np.ndarray, passages: list[list[bytes]]):
    """(basis, query vectors) of one block of the benchmark."""
    q = np.zeros((len(index), len(passages)))
    for k, words in enumerate(passages):
        at = sorted({index[w] for w in words if w in index})
        q[at, k] = weights[at]
    q /= np.maximum(np.sqrt((q * q).sum(axis=0)), 1e-12)
    start = np.concatenate([q, np.random.default_rng(7).normal(size=(len(index), PROBES)) / math.sqrt(max(1, len(index)))], axis=1).astype(np.float32)
    shared = spark.sparkContext.broadcast((weights.astype(np.float32), start))  # vocabulary of a block x its passages
    sums = grouped(hits.mapInArrow(tidy(_krylov(shared)), "block int, sums binary"), ["block"], _sum, "block int, sums binary").collect()
    y = np.concatenate([np.frombuffer(r["sums"], np.float64) for r in sorted(sums, key=lambda r: r["block"])]).reshape(len(index), -1) if sums else np.zeros_like(start, np.float64)
    shared.unpersist()
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    lead = u[:, : LATENT][:, s[:LATENT] > 1e-9 * max(s.max(initial=0), 1e-300)]
    basis, _ = np.linalg.qr(np.concatenate([q[:, np.any(q, axis=0)], lead], axis=1))
    z = q.T @ basis
    return basis.astype(np.float32), (z / np.maximum(np.sqrt((z * z).sum(axis=1)), 1e-12)[:, None]).astype(np.float32)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", label: str = "decontaminate") -> DataFrame:
    """(id_col, item_id, share, first_word, cosine), one row per document and benchmark
    item found in it; documents without any give no row. share is the part of the
    item's words found in order, first_word the place of the span (0-based, in words).

    Words are lower-cased runs of letters and digits. Null and empty texts and items
    give nothing, an item of one word is found wherever the word is; equal items under
    several ids are all reported. Of rows that repeat an id, of either table, the one with
    the least text counts, rows without an id are left out; other columns are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, label)
    base = one_row_per_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    benchmark = one_row_per_id(benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")))
    schema = "id long, item_id long, share double, first_word long, cosine double"
    n_items = benchmark.count()
    found = None
    blocks = max(1, -(-n_items // ITEMS))
    for b in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        items = {r[0]: w for r in rows if (w := words_of(r[1]))}
        vocabulary = {w: k for k, w in enumerate(sorted({w for x in items.values() for w in x}))}
        if not vocabulary:
            continue
        shared = spark.sparkContext.broadcast(vocabulary)
        counts = base.select("text").mapInArrow(tidy(_frequency(shared)), "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
        df, n = np.zeros(len(vocabulary)), 0
        for r in counts:
            if r["word"] < 0:
                n = r["df"]
            else:
                df[r["word"]] = r["df"]
        weights = np.log((n + 1.0) / (df + 1.0)) + 1.0
        hits = scratch.save(base.mapInArrow(tidy(_hits(shared)), "id long, places array<int>, words array<int>"), "hits")
        basis, queries = _space(spark, hits, vocabulary, weights, list(items.values()))
        model = spark.sparkContext.broadcast((vocabulary, weights.astype(np.float32), basis, queries, {i: k for k, i in enumerate(items)}))
        limits = spark.sparkContext.broadcast((bound(list(items.values()), vocabulary, df), np.array(list(items), np.int64)))
        near = scratch.save(hits.mapInArrow(tidy(_search(limits)), "id long, item long, lo long, hi long"), "near")
        regions = scratch.save(near.groupBy("id").agg(F.collect_list(F.struct("item", "lo", "hi")).alias("regions")), "regions")
        texts = spark.sparkContext.broadcast(items)
        got = keep_ids(base, regions).join(regions.hint("merge"), "id").mapInArrow(tidy(_decide(texts, model)), schema)
        got = scratch.save(got, "found")
        scratch.drop(hits)
        found = got if found is None else found.union(got)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumnRenamed("id", id_col)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), label="op10")
