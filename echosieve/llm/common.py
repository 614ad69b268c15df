"""Helpers shared by the training-data operators: scratch tables, grouped
Arrow batches and distributed connected components."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_open_scopes: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = tempfile.gettempdir() + "/echosieve-scratch"
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables in the shared folder, which cut lineage and survive executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/echosieve-{label}-{uuid.uuid4().hex[:12]}"
        self.n = itertools.count()
        _open_scopes.setdefault(label, []).append(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{next(self.n)}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back with its own schema."""
        p = self.path(name)
        df.write.option("compression", "zstd").parquet(p)
        out = self.spark.read.schema(df.schema).parquet(p)
        out._scratch_path = p
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_path(self.spark, t._scratch_path)


def release(spark: SparkSession, label: str) -> None:
    """Delete the scratch tables of earlier calls whose results have been written."""
    for base in _open_scopes.pop(label, []):
        delete_path(spark, base)


def one_row_per_id(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with an id, one for each: where an id repeats, the row that is least by its
    other columns, null first. Only ids are shuffled unless some repeat."""
    rows = rows.where(F.col(id_col).isNotNull())
    again = rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    if again.isEmpty():
        return rows
    rest = [c for c in rows.columns if c != id_col]
    least = rows.join(again, id_col, "left_semi").groupBy(id_col).agg(F.min(F.struct(*rest)).alias("least")).select(id_col, "least.*")
    return rows.join(again, id_col, "left_anti").unionByName(least.select(rows.columns))


def tidy(run):
    """run(batches) for mapInArrow, after which the worker gives memory it holds unused back
    to the machine: workers are kept from stage to stage."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # not glibc

    return tidied


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def iter_groups(batches, keys: list[str]):
    """Groups of consecutive equal keys in batches sorted by them, as Arrow tables.
    Only one group and one batch are held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts, starts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def grouped(df: DataFrame, keys: list[str], func, schema: str, partitions: int | None = None) -> DataFrame:
    """func(Arrow table of one key) -> iterable of record batches. Unlike a grouped-map UDF
    the small groups of a partition share Arrow batches, so millions of groups stay cheap."""
    n = partitions or parallelism(df.sparkSession)

    def run(batches):
        for group in iter_groups(batches, keys):
            yield from func(group)

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


def list_views(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, flat values) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = column.offsets.to_numpy()  # of a slice they don't begin at 0
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a < b:
            self.up[b] = a
        else:
            self.up[a] = b
        return True


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest
    node reachable. Every round hooks each node to its smallest neighbour, jumps
    pointers to the roots and contracts the edges, all as joins of written tables,
    so neither links nor components meet on the driver and lost tasks are rerun."""
    spark = scratch.spark
    e = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        # every node's smallest neighbour or itself
        up = e.select(F.col("b").alias("node"), F.col("a").alias("up")).union(e.select(F.col("a").alias("node"), F.col("a").alias("up")))
        up = scratch.save(up.groupBy("node").agg(F.min("up").alias("up")), "hook")
        while True:  # pointer jumping; a chain shrinks by half each time
            jumped = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.node")).select("x.node", F.col("y.up").alias("up"), (F.col("y.up") != F.col("x.up")).alias("moved"))
            nxt = scratch.save(jumped, "jump")
            scratch.drop(up)
            up = nxt
            if up.where("moved").isEmpty():
                break
        roots = up.select("node", "up")
        if labels is None:
            new = roots.select("node", F.col("up").alias("component"))
        else:
            new = labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        new = scratch.save(new, "labels")
        rest = (
            e.join(roots.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a")
            .join(roots.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        rest = scratch.save(rest, "edges")
        scratch.drop(e, up, *([labels] if labels is not None else []))
        e, labels = rest, new
        if e.isEmpty():
            return labels


FILTER_BITS = 1 << 26


def keep_ids(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id is in ids, and a few others: a Bloom filter of at most
    FILTER_BITS goes to the tasks, so that texts which no later join wants aren't
    shuffled. With more ids than the filter can hold, a semi-join does it exactly."""
    n = ids.count()
    bits = 1 << 14
    while bits < 12 * n:
        bits *= 2
    if bits > FILTER_BITS:
        return rows.join(ids.select(id_col).distinct(), id_col, "left_semi")
    spots = F.explode(F.array(*[F.pmod(F.xxhash64(id_col, F.lit(k)), F.lit(bits)) for k in range(4)]))
    # as Arrow columns: a million words as Row objects would take hundreds of MB of the driver
    words = ids.select(spots.alias("spot")).groupBy((F.col("spot") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(spot, 64) as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    del words
    shared = rows.sparkSession.sparkContext.broadcast(table)
    names = rows.columns

    def run(batches):
        t = shared.value
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for k in range(4):
                spot = b.column(f"_spot{k}").to_numpy()
                ok &= (t[spot >> 6] >> (spot & 63)) & 1 == 1
            if ok.any():
                yield b.select(names).filter(pa.array(ok))

    spotted = rows.select("*", *[F.pmod(F.xxhash64(id_col, F.lit(k)), F.lit(bits)).alias(f"_spot{k}") for k in range(4)])
    return spotted.mapInArrow(tidy(run), rows.schema)
