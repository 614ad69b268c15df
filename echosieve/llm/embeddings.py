"""Near-duplicate embeddings by randomised-rotation binary codes.

A random rotation turns a unit vector o into its code x = sign(Ro) / sqrt(d), stored
with the correction factor a = <x, Ro>. For any unit vector q, <x, Rq> / a estimates
<o, q> without bias; its error is sqrt(1 - a^2) / a times the part of q across o times
the cosine of two directions, which is EPSILON / sqrt(d - 1) at most with overwhelming
probability, and sqrt(1 - t^2) at most for a pair whose cosine is t or more. Only pairs
whose upper bound reaches t are recomputed in double precision.

Which pairs are looked at is decided by sign bits of further rotations: TABLES of
them, as many as leave a pair at the threshold a chance of MISS to share none. The
bits of a table grow with the logarithm of the number of vectors, so buckets stay
small however many there are. Equal vectors are one vector with a number of copies.
Buckets are met in blocks, counts and a spanning forest leave a task, never pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import Scratch, connected_components, grouped, list_views, one_row_per_id, tidy

EPSILON, MISS, BLOCK, SEED = 5.5, 3e-5, 1024, 20


def rotation(dim: int, which: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim, which)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


_rotations: dict[tuple[int, int], np.ndarray] = {}


def _rotated(v: np.ndarray, which: int) -> np.ndarray:
    key = (v.shape[1], which)
    if key not in _rotations:
        if len(_rotations) > 600:
            _rotations.clear()
        _rotations[key] = rotation(*key)
    return v @ _rotations[key].T


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """(tables, bits): a bit of a pair at the threshold agrees with chance 1 - angle / pi."""
    bits = max(8, math.ceil(math.log2(max(2, n))) + 4)
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log(1 - share)), bits


def table_keys(v: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Keys of unit vectors, (rows, tables), from the signs of as many rotations as needed."""
    dim = v.shape[1]
    need = -(-tables * bits // dim)
    # rounded, so that a coordinate at zero has the same sign in every batch shape
    signs = np.concatenate([np.round(_rotated(v, 1 + k), 9) > 0 for k in range(need)], axis=1)[:, : tables * bits]
    packed = np.packbits(signs.reshape(len(v), tables, bits), axis=2)
    weights = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(packed.shape[2])], np.uint64)
    h = (packed.astype(np.uint64) + np.uint64(1)) * weights
    h = h.sum(axis=2) + (np.arange(tables, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(dim))[None, :]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, correction factors) of unit vectors."""
    r = _rotated(v, 0)
    return np.packbits(r > 0, axis=1), np.abs(r).sum(axis=1) / math.sqrt(v.shape[1])


def candidates(codes: np.ndarray, factor: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the upper bound of the cosine of coded rows with unit vectors reaches the threshold."""
    dim = others.shape[1]
    x = (np.unpackbits(codes, axis=1, count=dim).astype(np.float64) * 2 - 1) / math.sqrt(dim)
    estimate = (x @ _rotated(others, 0).T) / factor[:, None]
    part = min(EPSILON / math.sqrt(max(1, dim - 1)), math.sqrt(1 - threshold**2))
    error = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * part + 1e-9
    return estimate + error[:, None] >= threshold


def _read(batches):
    """(id, digest, vector) of the usable vectors: finite, without nulls, not zero."""
    for batch in batches:
        ids, digests, vectors = [], [], []
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) if x.is_valid and x.values is not None and x.values.null_count == 0 else np.empty(0)
            if len(v) and np.isfinite(v).all() and v.any():
                raw = v.tobytes()
                ids.append(i), digests.append(xxhash.xxh3_128_digest(raw)), vectors.append(raw)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["id", "digest", "vec"])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _sign(tables: int, bits: int):
    def run(batches):
        for batch in batches:
            raws = batch.column("vec").to_pylist()
            sizes = np.array([len(x) for x in raws])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                v = _unit(np.frombuffer(b"".join(raws[k] for k in at), np.float64).reshape(len(at), -1))
                codes, factor = encode(v)
                keys = table_keys(v, tables, bits)
                offsets = np.arange(len(at) + 1, dtype=np.int32) * tables
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), batch.column("copies").take(pa.array(at)), batch.column("vec").take(pa.array(at)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                    names=["id", "copies", "vec", "code", "factor", "keys"],
                )

    return run


def _meet(threshold: float):
    """Links of one bucket's pair of blocks whose first shared table this is: per vector
    the number of linked vectors (copies counted), and a spanning forest."""

    def run(group: pa.Table):
        ids = group.column("id").to_numpy()
        copies = group.column("copies").to_numpy()
        side = group.column("side").to_numpy()
        slot = group.column("slot")[0].as_py()
        v = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float64).reshape(len(ids), -1)
        unit = _unit(v)
        codes = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        factor = group.column("factor").to_numpy()
        keys = list_views(group.column("keys"))[1].reshape(len(ids), -1)
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
        ok = candidates(codes[left], factor[left], unit[right], threshold)
        ok &= ids[left][:, None] < ids[right][None, :] if side[0] == 0 else True
        i, j = np.nonzero(ok)
        i, j = left[i], right[j]
        fresh = np.ones(len(i), bool)
        for a in range(0, len(i), 65536):  # earlier tables have seen the pair
            p = slice(a, a + 65536)
            fresh[p] = (keys[i[p]] == keys[j[p]]).argmax(axis=1) == slot
        i, j = i[fresh], j[fresh]
        norm = np.sqrt((v * v).sum(axis=1))
        good = np.ones(len(i), bool)
        for a in range(0, len(i), 16384):
            p = slice(a, a + 16384)
            good[p] = np.einsum("ij,ij->i", v[i[p]], v[j[p]]) / (norm[i[p]] * norm[j[p]]) >= threshold
        i, j = i[good], j[good]
        if not len(i):
            return
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = np.arange(len(ids))
        a_out, b_out = [], []
        cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(i))):
            own = root[i[a]]
            reached = np.unique(root[j[a:b]])
            reached = reached[reached != own]
            if len(reached):
                a_out += [own] * len(reached)
                b_out += reached.tolist()
                root[np.isin(root, reached)] = own
        has = np.flatnonzero(links)
        n, m = len(has), len(a_out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[has], ids[np.array(a_out, int)]])), pa.array(np.concatenate([links[has].astype(np.int64), np.zeros(m, np.int64)])), pa.array([None] * n + ids[np.array(b_out, int)].tolist(), pa.int64())],
            names=["a", "links", "b"],
        )

    return run


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, label: str = "embeddings") -> DataFrame:
    """One row per id of vectors: (id_col, n_links, component_id, kept). Vectors of one
    length link when their cosine in double precision is at least `threshold`; null,
    empty and zero vectors and such with null or non-finite components link with
    nothing. Of rows that repeat an id the one with the least vector counts, rows without
    an id are left out; other columns are ignored; an empty table gives an empty result."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, label)
    rows = one_row_per_id(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")))
    usable = scratch.save(rows.mapInArrow(tidy(_read), "id long, digest binary, vec binary"), "usable")
    groups = usable.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    groups = scratch.save(groups, "groups")
    tables, bits = plan_tables(groups.count(), threshold)
    one = groups.select("id", "copies").join(usable.select("id", "vec"), "id")
    signed = scratch.save(one.mapInArrow(tidy(_sign(tables, bits)), "id long, copies long, vec binary, code binary, factor double, keys array<long>"), "signed")
    slots = signed.select("id", F.posexplode("keys").alias("slot", "bucket"))
    live = slots.groupBy("bucket", "slot").agg(F.count("*").alias("size")).where("size > 1").select("bucket", "slot", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = slots.join(live, ["bucket", "slot"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("bucket", (F.least("part", "other") * F.col("blocks") + F.greatest("part", "other")).alias("pair"), "slot", "id", F.expr("case when part = other then 0 when part < other then 1 else 2 end").alias("side"))
    met = scratch.save(grouped(pairs.join(signed, "id"), ["bucket", "slot", "pair"], _meet(threshold), "a long, links long, b long"), "met")
    links = met.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comps = connected_components(scratch, met.where("b is not null").select("a", "b"))
    about = groups.withColumnRenamed("id", "rep").join(links, "rep", "left").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    about = about.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    known = usable.select("id", "digest").join(about, "digest").select("id", "n", "component")
    out = rows.select("id").join(known, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label="op1")
