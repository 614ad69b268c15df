"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams, their term frequency (share of a text's n-grams
of that order) times the inverse document frequency over all learnable rows. Weights
are trained by follow-the-regularised-leader with elastic-net penalties on a bounded,
documented sample of labelled rows; a temperature fitted on a held-back part of the
sample calibrates the probabilities. A prediction is a mean of table look-ups over
all n-grams of the whole text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import tidy

BUCKETS, ORDERS, PER_LANGUAGE = 1 << 16, (1, 2, 3), 2000
#: N-grams are looked at in runs of so many characters, so memory doesn't follow the text.
RUN = 1 << 18


def gram_buckets(text: str):
    """Bucket arrays of a text's n-grams, a run of characters and an order at a time.
    Letters are lower-cased, digits are one class; a space stands at either end."""
    whole = " " + text.lower() + " "
    for a in range(0, len(whole), RUN):
        piece = whole[a : a + RUN + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass")
        c = np.frombuffer(piece, np.uint32).astype(np.uint64)
        c[(c >= 48) & (c <= 57)] = 48
        for n in ORDERS:
            m = min(RUN, len(c) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n))
            for k in range(n):
                h = (h ^ c[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            yield n, (h & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # inverse document frequency times weight, (BUCKETS, languages)
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total = {n: np.zeros(len(self.languages)) for n in ORDERS}
        count = dict.fromkeys(ORDERS, 0)
        for n, idx in gram_buckets(text):
            total[n] += self.table[idx].sum(axis=0, dtype=np.float64)
            count[n] += len(idx)
        return self.bias + sum(total[n] / max(1, count[n]) for n in ORDERS)

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(z))
        return self.languages[k], float(p[k] / p.sum())


def _frequencies(batches):
    """Document frequencies of the buckets over the rows of a task, and their number in row -1."""
    df, seen = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for x in batch.column(0):
            mark = np.zeros(BUCKETS, bool)
            for _, idx in gram_buckets(x.as_py()):
                mark[idx] = True
            df += mark
            seen += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS, dtype=np.int32)), pa.array(np.concatenate([[seen], df]))], names=["bucket", "n"])


def _sparse(batches):
    """Buckets and term frequencies of every text."""
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            where, values = [], []
            for x in part.column(1):
                tf, count = np.zeros(BUCKETS), dict.fromkeys(ORDERS, 0)
                per = {n: np.zeros(BUCKETS) for n in ORDERS}
                for n, idx in gram_buckets(x.as_py()):
                    per[n] += np.bincount(idx, minlength=BUCKETS)
                    count[n] += len(idx)
                for n in ORDERS:
                    tf += per[n] / max(1, count[n])
                f = np.flatnonzero(tf)
                where.append(f.astype(np.uint16).tobytes())
                values.append(tf[f].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(where, pa.binary()), pa.array(values, pa.binary())], names=["lang", "idx", "tf"])


def ftrl(samples, idf: np.ndarray, k: int, epochs: int = 3, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05):
    """Per-coordinate follow-the-regularised-leader over samples of (buckets, tf, class)."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) > l1, w, 0.0)

    for epoch in range(epochs):
        for s in np.random.default_rng(epoch).permutation(len(samples)):
            idx, tf, y = samples[s]
            i = np.append(idx, BUCKETS)
            x = np.append(tf * idf[idx], 1.0)
            w = weights(i)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on labelled(id, text, lang), all rows with non-null text and lang. Document
    frequencies cover all of them; weights use about per_language rows of every
    language (all, where there are fewer), chosen by a hash of the id."""
    found = labelled.groupBy("lang").count().collect()  # one row a language
    if not found:
        return None
    languages = sorted(r["lang"] for r in found)
    rows = labelled.select("text").mapInArrow(tidy(_frequencies), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(BUCKETS), 0
    for r in rows:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    unit = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    keep = F.lit(False)
    for r in found:
        keep = keep | ((F.col("lang") == r["lang"]) & (unit < per_language / r["count"]))
    sample = labelled.where(keep).select("lang", "text").mapInArrow(tidy(_sparse), "lang string, idx binary, tf binary").collect()
    code = {x: k for k, x in enumerate(languages)}
    sample = [(np.frombuffer(r["idx"], np.uint16).astype(np.int64), np.frombuffer(r["tf"], np.float32).astype(np.float64), code[r["lang"]]) for r in sample]
    # a fifth is held back for the temperature, unless there is too little to learn from
    fit, back = ([s for k, s in enumerate(sample) if k % 5], sample[::5]) if len(sample) >= 50 else (sample, sample)
    weights, bias = ftrl(fit, idf, len(languages))
    z = np.array([bias + (tf * idf[idx]) @ weights[idx] for idx, tf, _ in back])
    y = np.array([s[2] for s in back])

    def loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    temperature = min(np.geomspace(0.02, 20, 400), key=loss) if len(y) else 1.0
    return Model(languages, (idf[:, None] * weights).astype(np.float32), bias, float(temperature))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row; `und` with score 0 where the text is null
    or has no letter, or no language was learned. Repeated rows give repeated rows;
    other columns are ignored."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the corpus

    def run(batches):
        m = shared.value
        for batch in batches:
            got = [m.predict(t.as_py()) if m and ok.as_py() else ("und", 0.0) for t, ok in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "lang_pred", "score"])

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), letter.alias("letter"))
    return rows.mapInArrow(tidy(run), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    learn = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = train(learn.select(F.col("doc_id").alias("id"), "text", "lang"))
    return identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
