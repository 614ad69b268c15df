"""Circulant MinHash near-duplicate detection with exact verification.

Two permutations of a 32-bit universe make every signature coordinate: the first
scatters the shingles, the second is applied after a circular shift by k and its
minimum is coordinate k (C-MinHash). Coordinates are banded; a bucket's members are
candidates; candidates are confirmed on full shingle sets.

Cost: one pass over the texts; equal sets collapse to one representative before
banding; a bucket emits a star first, and only buckets that still hold several
components are searched further, in blocks of bounded size, without pair rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import Forest, Scratch, connected_components, grouped, keep_ids, list_views, one_row_per_id, tidy

BANDS, ROWS, BLOCK, STAR = 24, 4, 1024, 256
COORDS = BANDS * ROWS
#: A pair whose signatures agree on fewer coordinates is 4.6 standard deviations below 0.8.
AGREE = int(COORDS * (0.8 - 4.6 * (0.8 * 0.2 / COORDS) ** 0.5))
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


class WordHashes(dict):
    """64-bit hashes of words, forgotten when too many are held."""

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space; null has none."""
    if text is None:
        return []
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return [w for w in raw.translate(_UPPER).translate(_SPACES).split(b" ") if w]


def shingle_hashes(words: list[bytes], width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; shorter sequences are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width_here = min(width, len(words))
    n = len(h) - width_here + 1
    acc = np.full(n, np.uint64(width_here))
    for k in range(width_here):
        acc = (acc ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def _permute(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def signature(shingles: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Coordinate k is the minimum of the second permutation after a shift by k."""
    s = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    s = _permute(s * np.uint32(0x2545F491) + np.uint32(0x3C6EF372))  # first permutation
    out = np.empty(coords, np.uint32)
    block = max(1, 65536 // coords)
    out[:] = 0xFFFFFFFF
    shifts = np.arange(coords, dtype=np.uint32)[:, None]
    for a in range(0, len(s), block):
        part = _permute(s[None, a : a + block] - shifts)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _pieces(values: np.ndarray, lengths, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, kind))


def _sign(batches, width: int):
    cache = WordHashes()
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            ids, ns, digests, bands, sigs = part.column(0), [], [], [], []
            for text in part.column(1):
                buf = text.as_buffer() if text.is_valid else None
                s = shingle_hashes(words_of(buf.to_pybytes()) if buf is not None else [], width, cache)
                ns.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    sig = signature(s)
                    rows = sig.reshape(BANDS, ROWS)
                    bands.append([xxhash.xxh3_64_intdigest(rows[b].tobytes(), seed=b) for b in range(BANDS)])
                    sigs.append(sig.astype(np.uint8).tobytes())
                else:
                    bands.append([])
                    sigs.append(b"")
            flat = np.array([x for b in bands for x in b], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), _pieces(flat, [len(b) for b in bands], pa.int64()), pa.array(sigs, pa.binary())],
                names=["id", "n", "digest", "bands", "sig"],
            )


def _attach(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the wanted ids, and of a few others, from one more pass over the texts."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sets = [shingle_hashes(words_of(t.as_buffer().to_pybytes() if t.is_valid else None), width, cache).view(np.int64) for t in part.column(1)]
                flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), _pieces(flat, [len(s) for s in sets], pa.int64())], names=["id", "shingles"])

    return keep_ids(docs, wanted).select("id", "text").mapInArrow(tidy(run), "id long, shingles array<long>")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted distinct arrays."""
    if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _verify_stars(percent: int):
    def run(group: pa.Table):
        # one hub with the documents hung on it; the hub's own row comes with id = hub
        ids = group.column("id").to_numpy()
        hub = group.column("hub")[0].as_py()
        off, flat = list_views(group.column("shingles"))
        at = int(np.flatnonzero(ids == hub)[0])
        mine = flat[off[at] : off[at + 1]]
        ok = [i for k, i in enumerate(ids) if i != hub and alike(mine, flat[off[k] : off[k + 1]], percent)]
        yield pa.RecordBatch.from_arrays([pa.array([hub] * len(ok), pa.int64()), pa.array(ok, pa.int64())], names=["a", "b"])

    return run


def _first_shared(bands_x: np.ndarray, bands_y: np.ndarray) -> np.ndarray:
    """Index of the first equal band for every pair; BANDS where none is."""
    out = np.full((len(bands_x), len(bands_y)), BANDS, np.int16)
    for b in range(BANDS - 1, -1, -1):
        out[bands_x[:, b][:, None] == bands_y[:, b][None, :]] = b
    return out


def _agreement(sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sx), len(sy)), np.int16)
    for k in range(sx.shape[1]):
        out += sx[:, k][:, None] == sy[:, k][None, :]
    return out


def _sift(percent: int, agree: int):
    """Of one bucket's pair of blocks, the documents that have a partner worth verifying."""

    def run(group: pa.Table):
        ids = group.column("id").to_numpy()
        comp = group.column("comp").to_numpy()
        n = group.column("n").to_numpy()
        side = group.column("side").to_numpy()
        band = group.column("band")[0].as_py()
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        left = np.flatnonzero(side <= 1)
        right = np.flatnonzero(side != 1)
        ok = (comp[left][:, None] != comp[right][None, :]) & (100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :]))
        if ok.any():
            ok &= _first_shared(bands[left], bands[right]) == band
        if ok.any():
            ok &= _agreement(sigs[left], sigs[right]) >= agree
        keep = np.unique(np.concatenate([left[ok.any(axis=1)], right[ok.any(axis=0)]]))
        take = group.select(["bucket", "pair", "id", "comp", "side", "bands", "sig", "band"]).take(pa.array(keep)).combine_chunks()
        yield from take.to_batches()

    return run


def _settle(percent: int, agree: int):
    """Verify the sifted pairs of two blocks; pairs that are already joined are skipped."""

    def run(group: pa.Table):
        ids = group.column("id").to_numpy()
        comp = group.column("comp").to_numpy()
        side = group.column("side").to_numpy()
        band = group.column("band")[0].as_py()
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        off, flat = list_views(group.column("shingles"))
        left = np.flatnonzero(side <= 1)
        right = np.flatnonzero(side != 1)
        near = _agreement(sigs[left], sigs[right])
        ok = (comp[left][:, None] != comp[right][None, :]) & (near >= agree) & (_first_shared(bands[left], bands[right]) == band)
        i, j = np.nonzero(ok)
        order = np.argsort(-near[i, j], kind="stable")
        names, index = np.unique(comp, return_inverse=True)
        forest, found = Forest(len(names)), []
        for k in order:
            x, y = int(left[i[k]]), int(right[j[k]])
            if forest.root(index[x]) != forest.root(index[y]) and alike(flat[off[x] : off[x + 1]], flat[off[y] : off[y + 1]], percent):
                forest.join(index[x], index[y])
                found.append((ids[x], ids[y]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, label: str = "minhash") -> DataFrame:
    """One row per document: (id_col, n_shingles, component_id, kept).

    Words are runs of other than ASCII white space after A-Z are lower-cased; a
    document's set holds its distinct `width`-word shingles, or its whole word
    sequence when that is shorter. Documents link when 100 * intersection >=
    percent * union. Null and empty texts have n_shingles 0 and link with nothing;
    equal texts are one group. Of rows that repeat an id the one with the least text
    counts, rows without an id are left out; other columns, whatever their names, are
    ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, label)
    base = one_row_per_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    signed = scratch.save(base.mapInArrow(tidy(lambda it: _sign(it, width)), "id long, n long, digest binary, bands array<long>, sig binary"), "signed")
    reps = signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"))
    members = scratch.save(signed.join(reps.select("id"), "id", "left_semi").select("id", "n", "bands", "sig"), "reps")
    slots = members.select("id", F.posexplode("bands").alias("band", "key"))
    hubs = slots.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    slots = scratch.save(slots.join(hubs, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "band", "id", "hub"), "slots")
    # star: every member against its bucket's smallest
    stars = slots.where("id <> hub").select("hub", "id").distinct()
    about = members.select("id", "n", "sig")
    stars = (
        stars.join(about, "id")
        .join(about.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig")), "hub")
        .where(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent)
        .mapInArrow(tidy(_close(AGREE)), "hub long, id long")
    )
    stars = scratch.save(stars, "stars")
    wanted = stars.select("id").union(stars.select(F.col("hub").alias("id"))).distinct()
    sets = scratch.save(_attach(base, wanted, width), "sets")
    # a hub's star is cut into parts of bounded size, each with a copy of the hub
    parts = stars.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    hung = stars.join(parts, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")
    hung = hung.union(parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("id")))
    edges = grouped(hung.join(sets, "id"), ["hub", "part"], _verify_stars(percent), "a long, b long")
    edges = scratch.save(edges, "edges")
    comps = connected_components(scratch, edges)
    scratch.drop(sets, stars)
    # buckets that still hold several components
    slots2 = slots.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id")).select("bucket", "band", "id", "comp")
    live = slots2.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = slots2.join(live, "bucket").withColumn("part", part)
    # a block meets every block of its bucket once; side 0: both, 1: left, 2: right
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("pair", F.least("part", "other") * F.col("blocks") + F.greatest("part", "other")).withColumn("side", F.expr("case when part = other then 0 when part < other then 1 else 2 end")).select("bucket", "pair", "band", "id", "comp", "side")
    sifted = grouped(pairs.join(members, "id"), ["bucket", "pair"], _sift(percent, AGREE), "bucket long, pair int, id long, comp long, side int, bands array<long>, sig binary, band int")
    sifted = scratch.save(sifted, "sifted")
    sets = scratch.save(_attach(base, sifted.select("id").distinct(), width), "sets")
    more = scratch.save(grouped(sifted.join(sets, "id"), ["bucket", "pair"], _settle(percent, AGREE), "a long, b long"), "more")
    scratch.drop(sets, sifted, slots)
    if not more.isEmpty():
        comps = connected_components(scratch, edges.union(more))
    rep_of = signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"))
    comp_of = rep_of.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(comp_of, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _close(agree: int):
    """Keep the pairs whose signatures agree on enough coordinates."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            y = np.frombuffer(b"".join(b.column("hub_sig").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            ok = pa.array((x == y).sum(axis=1) >= agree)
            yield pa.RecordBatch.from_arrays([pc.filter(b.column("hub"), ok), pc.filter(b.column("id"), ok)], names=["hub", "id"])

    return run


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80, label="op7")
