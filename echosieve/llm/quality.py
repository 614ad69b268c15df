"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its potential is a sum of weights of its own binned
features and of those of its neighbours, and neighbouring labels have transition
weights. Training lines carry their document's label. A document's evidence is the
length-weighted mean of its lines' forward-backward log odds and marginals, which a
two-weight logistic fit turns into the score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import tidy

BINS, SAMPLE = 10, 16_000
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\r\x0b\x0c"
_ENDS = b".?!"
FEATURES = ("length", "words", "upper", "lower", "digits", "symbols", "word length", "distinct words", "commonest symbol", "doubled symbols", "long words", "sentence ends", "line repeats", "capital words", "spoiled words")


def line_features(line: bytes, repeats: float) -> list[float]:
    n = len(line)
    if not n:
        return [0.0] * 12 + [repeats, 0.0, 0.0]
    upper = n - len(line.translate(None, _UPPER))
    lower = n - len(line.translate(None, _LOWER))
    digits = n - len(line.translate(None, _DIGIT))
    rest = line.translate(None, _UPPER + _LOWER + _DIGIT + _SPACE)
    words = line.split()
    w = len(words)
    distinct = set(words)
    symbols = set(rest)
    common = max((rest.count(bytes([c])) for c in symbols), default=0)
    doubled = sum(rest.count(bytes([c, c])) for c in symbols)
    ends = sum(line.count(bytes([c])) for c in _ENDS)
    long_words = sum(len(x) > 20 for x in distinct)
    capital = sum(x[:1].isupper() for x in distinct)
    spoiled = sum(len(x) > 1 and not (x[-1] >= 97 or 65 <= x[-1] <= 90) and not (x[-2] >= 97 or 65 <= x[-2] <= 90) for x in distinct)
    d = max(1, len(distinct))
    return [float(np.log1p(n)), float(np.log1p(w)), upper / n, lower / n, digits / n, len(rest) / n, n / max(1, w), len(distinct) / max(1, w) * (1 + np.log1p(w)), common / n, doubled / n, long_words / d, ends / max(1, w), repeats, capital / d, spoiled / d]


def text_lines(text) -> list[bytes]:
    """Lines of a text; null and empty ones have one empty line."""
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def features(text) -> tuple[np.ndarray, np.ndarray]:
    """(features of the lines, their weights: bytes plus one)."""
    lines = text_lines(text)
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    known: dict[bytes, list[float]] = {}
    for x, k in seen.items():
        known[x] = line_features(x, float(np.log(k)) if x else 0.0)
    return np.array([known[x] for x in lines], np.float32), np.array([len(x) + 1.0 for x in lines])


def _collect_features(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            got = [features(x.as_py()) for x in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f, _ in got], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in got], pa.binary()), part.column(1)], names=["f", "w", "label"])


@dataclass
class Crf:
    edges: np.ndarray  # (features, BINS - 1)
    own: np.ndarray  # log odds of good by feature and bin
    before: np.ndarray
    after: np.ndarray
    stay: np.ndarray  # 2 x 2
    bias: float
    scale: tuple[float, float, float]

    def bins(self, f: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, f[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def evidence(self, f: np.ndarray, w: np.ndarray) -> tuple[float, float]:
        """Length-weighted means of the marginal of good and of its clipped log odds."""
        unary = _potentials(self.own, self.before, self.after, self.bias, self.bins(f), np.array([0, len(f)]))
        p = np.clip(_marginals(unary, self.stay, np.array([0, len(f)]))[0], 1e-6, 1 - 1e-6)
        share = w / w.sum()
        return float(share @ p), float(share @ np.log(p / (1 - p)))

    def score(self, text) -> float:
        p, odds = self.evidence(*features(text))
        a, b, c = self.scale
        return float(1 / (1 + np.exp(-np.clip(a * (p - 0.5) + b * odds + c, -500, 500))))


def _potentials(own, before, after, bias, bins, offsets):
    """Log potential of good against bad for every line of the documents between offsets."""
    k = np.arange(bins.shape[1])
    left = before[k, bins].sum(axis=1)
    right = after[k, bins].sum(axis=1)
    u = own[k, bins].sum(axis=1) + bias
    first = np.zeros(len(bins), bool)
    first[offsets[:-1]] = True
    last = np.zeros(len(bins), bool)
    last[offsets[1:] - 1] = True
    u[1:] += np.where(first[1:], 0.0, left[:-1])
    u[:-1] += np.where(last[:-1], 0.0, right[1:])
    return u


def _marginals(unary, stay, offsets):
    """Forward-backward of all documents side by side, longest first: the marginals of
    good, and the expected transitions summed over all lines."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    start = offsets[:-1][order]
    sizes = sizes[order]
    n = len(unary)
    psi = np.stack([np.ones(n), np.exp(np.clip(unary, -60, 60))], 1)
    t = np.exp(stay)
    fwd, bwd = np.empty((n, 2)), np.empty((n, 2))
    alive = [int(np.searchsorted(-sizes, -k, "left")) for k in range(int(sizes[0]) if len(sizes) else 0)]
    for k, m in enumerate(alive):  # m documents have a line k
        at = start[:m] + k
        v = psi[at] if k == 0 else (fwd[at - 1] @ t) * psi[at]
        fwd[at] = v / v.sum(axis=1, keepdims=True)
    for k in range(len(alive) - 1, -1, -1):
        m = alive[k]
        at = start[:m] + k
        more = alive[k + 1] if k + 1 < len(alive) else 0
        v = np.ones((m, 2))
        if more:
            v[:more] = (bwd[at[:more] + 1] * psi[at[:more] + 1]) @ t.T
        bwd[at] = v / v.sum(axis=1, keepdims=True)
    post = fwd * bwd
    post /= post.sum(axis=1, keepdims=True)
    inner = np.ones(n, bool)
    inner[offsets[:-1]] = False
    here = np.flatnonzero(inner)
    pair = fwd[here - 1][:, :, None] * t[None] * (bwd[here] * psi[here])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return post[:, 1], pair.sum(axis=0)


def fit(rows, rounds: int = 120, rate: float = 0.08, decay: float = 2e-4) -> Crf | None:
    """Gradient ascent (Adam) on the conditional likelihood of the lines' labels; rows
    are (features, weights, label). Every document counts once, however long."""
    if not rows:
        return None
    f = np.concatenate([r[0] for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(rows)), sizes)
    y = np.array([r[2] for r in rows], float)
    weight = 1.0 / np.sqrt(sizes)[doc]
    k = f.shape[1]
    edges = np.stack([np.quantile(f[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(k)])
    model = Crf(edges, np.zeros((k, BINS)), np.zeros((k, BINS)), np.zeros((k, BINS)), np.zeros((2, 2)), 0.0, (1.0, 1.0, 0.0))
    bins = model.bins(f)
    flat = (bins + np.arange(k) * BINS).ravel()
    first = np.zeros(len(f), bool)
    first[offsets[:-1]] = True
    last = np.zeros(len(f), bool)
    last[offsets[1:] - 1] = True
    seen_pairs = np.zeros((2, 2))
    for c in (0, 1):
        seen_pairs[c, c] = (y[doc][~first] == c).sum()
    theta = np.zeros(3 * k * BINS + 5)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)

    def parts(v):
        a = k * BINS
        return v[:a].reshape(k, BINS), v[a : 2 * a].reshape(k, BINS), v[2 * a : 3 * a].reshape(k, BINS), v[3 * a : 3 * a + 4].reshape(2, 2), v[-1]

    total = weight.sum()
    for r in range(1, rounds + 1):
        own, before, after, stay, bias = parts(theta)
        p, pairs = _marginals(_potentials(own, before, after, bias, bins, offsets), stay, offsets)
        e = (y[doc] - p) * weight
        nxt = np.append(np.where(first[1:], 0.0, e[1:]), 0.0)  # error of the line after
        prv = np.insert(np.where(last[:-1], 0.0, e[:-1]), 0, 0.0)
        g = np.concatenate([np.bincount(flat, np.repeat(x, k), k * BINS) for x in (e, nxt, prv)] + [(seen_pairs - pairs).ravel() * total / max(1, len(f)), [e.sum()]]) / total - decay * theta
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-9)
    model.own, model.before, model.after, model.stay, model.bias = (np.array(x) if np.ndim(x) else float(x) for x in parts(theta))
    seen = np.array([model.evidence(a, w) for a, w, _ in rows])
    x = np.column_stack([seen[:, 0] - 0.5, seen[:, 1], np.ones(len(y))])
    beta = np.zeros(3)
    for _ in range(60):  # Newton with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * beta)
        beta = beta + np.clip(step, -2, 2)
    model.scale = tuple(float(b) for b in beta)
    return model


def train(labelled: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """Fit on labelled(id, text, label) with labels 0 and 1; about `sample` rows at
    most, chosen by a hash of the id, and all of them where there are fewer."""
    n = labelled.count()
    unit = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    got = labelled.where(unit < sample / max(1, n)).select("text", F.col("label").cast("int").alias("label")).mapInArrow(tidy(_collect_features), "f binary, w binary, label int").collect()
    return fit([(np.frombuffer(r["f"], np.float32).reshape(-1, len(FEATURES)), np.frombuffer(r["w"], np.float32).astype(float), r["label"]) for r in got])


def score_quality(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row: the calibrated probability of label 1 of its whole
    text. Null and empty texts are scored as one empty line; without a model all score
    0.5. Repeated rows give repeated rows; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few KB

    def run(batches):
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(x.as_py()) if m else 0.5 for x in batch.column(1)], pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "id long, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Crf | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m is None or m.score(x.as_py()) >= least for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, label) of the labelled rows a label may be learned from. A document
    with differing labels is left out."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other").select(F.col("doc_id").alias("labelled_id"), "label")
    return docs.where(~held_out).select("doc_id", "text").join(known, F.col("doc_id") == F.col("labelled_id")).select(F.col("doc_id").alias("id"), "text", "label")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(learnable(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return score_quality(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
