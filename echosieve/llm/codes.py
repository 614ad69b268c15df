"""Product codes of vectors in whole numbers, with lower bounds that spare distances.

Components become integers, vectors are cut into equal parts, and every part position has
a codebook of at most ENTRIES entries, refined by rounds of assignment and means. The
nearest entry is found coarse to fine: block sums of a part and of an entry give a lower
bound of their squared distance, (difference of sums)^2 / length summed over the blocks,
plus the squared difference of the residual norms. An entry whose bound is over the exact
distance of the best guess is left out; halving the blocks tightens the bound, and what
survives gets its exact integer distance, so ties are decided exactly."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import Scratch, list_views, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that are looked at together.
ROWS = 4096
LARGEST = (1 << 63) - 1


def small(largest: float, step: int) -> bool:
    """Whether squares of sums over a part of so many components fit in 64 bits."""
    return largest * max(1, step) < 1 << 30


def integers(flat: np.ndarray, step: int) -> np.ndarray:
    """floor(SCALE * x) for parts of `step`: int64 where that is exact, else Python's integers."""
    whole = np.floor(flat.astype(np.float64) * SCALE)
    if not len(whole) or small(np.abs(whole).max(), step):
        return whole.astype(np.int64)
    return np.array([int(v) for v in whole], dtype=object)


def blocks_of(width: int) -> list[np.ndarray]:
    """Where the blocks begin, from one block to blocks of two, each step halving them."""
    out, n = [], 1
    while n == 1 or 2 * n <= width:
        out.append(np.unique(np.arange(n) * width // n))
        n *= 2
    return out


def summary(x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block sums over the roots of the block lengths, and the norm of what the block means
    leave. Both are taken from exact integers, so that no cancellation loosens them."""
    lengths = np.diff(np.append(begins, x.shape[1]))
    sums, squares = np.add.reduceat(x, begins, axis=1), np.add.reduceat(x * x, begins, axis=1)
    rest = (lengths * squares - sums * sums).astype(np.float64) / lengths
    return sums.astype(np.float64) / np.sqrt(lengths), np.sqrt(rest.sum(axis=1))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The index of the nearest row of book for every row of x, the lower of equals, its squared
    distance, and how many exact distances were taken."""
    n, k = len(x), len(book)
    if x.shape[1] == 0:
        return np.zeros(n, np.int64), np.zeros(n, x.dtype), 0
    exact = lambda i, j: ((x[i] - book[j]) ** 2).sum(axis=1)
    distance = np.full((n, k), None, object) if object in (x.dtype, book.dtype) else np.full((n, k), LARGEST)
    live, best, taken = None, None, 0
    for begins in blocks_of(x.shape[1]):
        (sx, rx), (sb, rb) = summary(x, begins), summary(book, begins)
        i, j = np.nonzero(live) if live is not None else (np.repeat(np.arange(n), k), np.tile(np.arange(k), n))
        bound = ((sx[i] - sb[j]) ** 2).sum(axis=1) + (rx[i] - rb[j]) ** 2
        # below what rounding can add
        scale = (sx**2).sum(axis=1)[i] + (sb**2).sum(axis=1)[j] + rx[i] ** 2 + rb[j] ** 2
        bound -= 1e-12 * scale
        if live is None:
            guess = bound.reshape(n, k).argmin(axis=1)
            best = exact(np.arange(n), guess)
            distance[np.arange(n), guess] = best
            taken, live = n, np.ones((n, k), bool)
            live[np.arange(n), guess] = False
            i, j, bound = (v.reshape(n, k)[live] for v in (i, j, bound))
        live[i, j] = bound <= best[i].astype(np.float64) * (1 + 1e-12)
    i, j = np.nonzero(live)
    distance[i, j] = exact(i, j)
    if distance.dtype == object:
        known = [[(v, c) for c, v in enumerate(row) if v is not None] for row in distance]
        least = [min(row) for row in known]
        return np.array([c for _, c in least], np.int64), np.array([v for v, _ in least], object), taken + len(i)
    index = distance.argmin(axis=1)
    return index, distance[np.arange(n), index], taken + len(i)


def _slices(batches, width: int):
    """(record batch, integer matrix) of so many rows at a time; the last column is the vector."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, integers(list_views(part.column(part.num_columns - 1))[1], width // PARTS).reshape(part.num_rows, width)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Rows with an id and a vector without null or non-finite components, whose length is
    the commonest one (the longest of equals) that PARTS divides; and that length."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine & (F.size(v) % PARTS == 0))
    widths = rows.groupBy(F.size(v).alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = widths[0]["w"] if widths else 0
    return rows.where(F.size(v) == width), width


def _refine(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after a round: every entry is the floored mean of the parts it is nearest to.
    A task adds up its rows; a group of the final sum has one row a task."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # PARTS x ENTRIES entries at most
    step = width // PARTS

    def run(batches):
        sums = {}
        for _, x in _slices(batches, width):
            for p, book in enumerate(shared.value):
                part = x[:, p * step : (p + 1) * step]
                index = nearest(part, book)[0]
                for e in np.unique(index):
                    mine = part[index == e]
                    n, total = sums.get((p, int(e)), (0, 0))
                    sums[p, int(e)] = (n + len(mine), total + mine.sum(axis=0).astype(object))
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_pydict({"part": pa.array([k[0] for k in keys], pa.int32()), "entry": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([sums[k][0] for k in keys], pa.int64()), "total": pa.array([[str(v) for v in sums[k][1]] for k in keys], pa.list_(pa.string()))})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].sum())
        total = [sum(int(v) for v in column) for column in zip(*group["total"])]
        return pd.DataFrame({"part": [key[0]], "entry": [key[1]], "mean": [[str(t // n) for t in total]]})

    per_task = rows.mapInArrow(tidy(run), "part int, entry int, n long, total array<string>")
    out = [b.copy() for b in books]
    for r in per_task.groupBy("part", "entry").applyInPandas(add, "part int, entry int, mean array<string>").collect():
        mean = [int(v) for v in r["mean"]]
        if out[r["part"]].dtype != object and not small(max(map(abs, mean)), step):
            out[r["part"]] = out[r["part"]].astype(object)
        out[r["part"]][r["entry"]] = mean
    return out


def train(rows: DataFrame, width: int, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook a part from rows of usable(): first the parts of the ENTRIES rows with the
    smallest ids (of equal ids the smaller vector), then so many rounds over all rows."""
    first = rows.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v")).orderBy("i", "v").limit(ENTRIES).collect()
    seeds = integers(np.array([x for r in first for x in r["v"]]), width // PARTS).reshape(len(first), width)
    books = [b.copy() for b in np.split(seeds, PARTS, axis=1)]
    if not first:
        return books
    only = rows.select(F.col(vector_col).alias("v"))
    for _ in range(rounds):
        books = _refine(only, books, width)
    return books


def encode(rows: DataFrame, books: list[np.ndarray], width: int, vector_col: str = "embedding") -> DataFrame:
    """rows with code, two hex digits a part, error, the summed squared distances (the
    largest long where it is more), and n_exact, the distances that were taken for it."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    step = width // PARTS
    rest = [f for f in rows.schema if f.name != vector_col]

    def run(batches):
        for batch, x in _slices(batches, width):
            codes, error, taken = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), object), 0
            for p, book in enumerate(shared.value):
                index, d, n = nearest(x[:, p * step : (p + 1) * step], book)
                codes[:, p], error, taken = index, error + d.astype(object), taken + n
            made = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(int(e), LARGEST) for e in error], pa.int64()), pa.array(np.full(len(x), taken / max(1, len(x))))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*[f.name for f in rest], "code", "error", "n_exact"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["code string", "error long", "n_exact double"])
    return rows.select(*[f"`{f.name}`" for f in rest], f"`{vector_col}`").mapInArrow(tidy(run), schema)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: str = "codes") -> DataFrame:
    """(id_col, label_col, code, error, label_error, codebooks_sha256, n_exact) of every usable
    row; see usable() for what is left out. Rows that share an id all count and are all
    coded. With fewer rows than ENTRIES, codebooks have as many entries as rows. Errors
    of a label, and the sum over it, stop at the largest long. Columns not named are
    ignored, and an empty table gives no rows."""
    scratch = Scratch(vectors.sparkSession, label)
    rows, width = usable(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")), "id", "vector")
    books = train(rows, width, "id", "vector")
    coded = scratch.save(encode(rows, books, width, "vector"), "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "n_exact")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label="op13")
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same by taking every distance."""
    ctes = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS (SELECT vec_id, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS x FROM kept, range({PARTS}) r(p))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES})",
        "book0 AS (SELECT p, e, x AS c FROM parts JOIN first USING (vec_id))",
    ]
    near = "SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, parts.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN book{k} b ON b.p = parts.p) GROUP BY vec_id, p"
    for k in range(ROUNDS):
        ctes.append(f"near{k} AS ({near.format(k=k)})")
        ctes.append(f"sums{k} AS (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{k} JOIN parts USING (vec_id, p), unnest(range(1, len(x) + 1)) u(i) GROUP BY p, e, i)")
        ctes.append(f"book{k + 1} AS (SELECT p, e, coalesce(m, c) AS c FROM book{k} LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sums{k} GROUP BY p, e) USING (p, e))")
    ctes.append(f"near{ROUNDS} AS ({near.format(k=ROUNDS)})")
    ctes.append(f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} JOIN kept USING (vec_id) GROUP BY vec_id, label)")
    return f"WITH {', '.join(c.replace(' AS (', ' AS MATERIALIZED (', 1) for c in ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded"


ORACLE = _sql()
