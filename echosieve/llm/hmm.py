"""Hidden Markov language model with exact sequence likelihoods.

Tokens are counted over all training texts. The most frequent words are symbols of
the model; any other word is the symbol of its ending's class times its share of
that class, so every text, known or not, has a probability. Baum-Welch runs over all
training texts: every partition adds up expected counts, partitions meet in a sum
of bounded size, and the driver holds nothing but the model. The scaled forward
recursion then gives each whole text's exact likelihood.

Counts of all distinct tokens stay a distributed table. The LEXICON most frequent
ones are broadcast (a bound in rows, whatever the corpus); the rest of a text's
words meet their counts in a join."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import Scratch, grouped, tidy
from echosieve.llm.minhash import words_of

LEXICON, SYMBOLS, CLASSES, STATES, BLOCK = 200_000, 16_384, 256, 8, 512
#: Rounds of Baum-Welch at most, and the gain in log10 likelihood a token that ends them.
ROUNDS, GAIN = 6, 1e-4
#: Tokens of the unigram that every state has emitted beforehand.
PRIOR = 2000.0
#: Tokens a task sorts by text length, and tokens whose messages it holds at once.
HELD, CELLS = 4_000_000, 600_000
END = b""  # no word is empty


def _class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _count(batches):
    """Token counts of a task's texts, sent on whenever many words are held."""
    held: Counter[bytes] = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])
        held.clear()
        return out

    for batch in batches:
        for x in batch.column(0):
            held.update(words_of(x.as_buffer().to_pybytes() if x.is_valid else None))
            if len(held) > 400_000:
                yield flush()
        held[END] += batch.num_rows
    if held:
        yield flush()


@dataclass
class Lexicon:
    total: int  # N
    distinct: int  # V
    index: dict[bytes, int]
    symbol: np.ndarray
    base: np.ndarray  # log10 of the smoothed unigram
    within: np.ndarray  # log10 of the share in the symbol
    class_size: np.ndarray  # log10 of tokens + kinds + 1 of a class's words

    def __post_init__(self):
        # with a last entry for words outside, whose place is -1
        self.symbol_or_0, self.base_or_0, self.within_or_0 = (np.append(x, x.dtype.type(0)) for x in (self.symbol, self.base, self.within))

    @property
    def symbols(self) -> int:
        return CLASSES + SYMBOLS


def build_lexicon(counts: DataFrame) -> Lexicon:
    """From the counts table (token, c, class): totals, and the most frequent tokens."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count that keeps the lexicon within its bound; counts of 4096 or more share octaves
    level = F.when(F.col("c") < 4096, F.col("c")).otherwise((F.floor(F.log2("c") * 64) + 4096 - 768).cast("long"))
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("level")).collect()
    floor, held = None, 0
    for r in levels:
        held += r["n"]
        if held > LEXICON:
            break
        floor = r["c"]
    top = [] if floor is None else sorted(((r["c"], bytes(r["token"])) for r in counts.where(F.col("c") >= floor).select("token", "c").collect()), key=lambda x: (-x[0], x[1]))
    words = [w for _, w in top]
    c = np.array([x for x, _ in top], np.float64)
    symbol = np.array([CLASSES + k if k < SYMBOLS else _class(w) for k, w in enumerate(words)], np.int64)
    own = words[:SYMBOLS]
    size = np.ones(CLASSES)
    for r in counts.groupBy("class").agg((F.sum("c") + F.count("*")).alias("n")).collect():
        size[r["class"]] += r["n"]
    for k, w in enumerate(own):
        size[_class(w)] -= c[k] + 1
    size = np.log10(size)
    within = np.where(symbol >= CLASSES, 0.0, np.log10(c + 1) - size[np.minimum(symbol, CLASSES - 1)]) if len(c) else c
    return Lexicon(int(total), int(distinct), {w: k for k, w in enumerate(words)}, symbol, np.log10((c + 1) / (total + distinct + 1)), within, size)


def _encode(lexicon):
    """Symbols of every text, its sums over the lexicon's words, and its other words with their numbers."""

    def run(batches):
        lex = lexicon.value
        get = lex.index.get
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                words, sizes = [], []
                for x in part.column(1):
                    own = words_of(x.as_buffer().to_pybytes() if x.is_valid else None)
                    words += own
                    words.append(END)
                    sizes.append(len(own) + 1)
                sizes = np.array(sizes)
                first = np.cumsum(sizes) - sizes
                idx = np.fromiter(map(get, words, itertools.repeat(-1)), np.int64, len(words))
                known = idx >= 0
                sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), lex.base_or_0[idx], lex.within_or_0[idx])]
                s = lex.symbol_or_0[idx]
                rest: list[dict[bytes, int]] = [{} for _ in sizes]
                missing = np.flatnonzero(~known)
                for k, i in zip(missing.tolist(), (np.searchsorted(first, missing, "right") - 1).tolist()):
                    w = words[k]
                    s[k] = _class(w)
                    rest[i][w] = rest[i].get(w, 0) + 1
                raw = s.astype(np.uint16)
                syms = [raw[a:b].tobytes() for a, b in zip(first.tolist(), (first + sizes).tolist())]
                rest_at = np.cumsum([0, *map(len, rest)]).astype(np.int32)
                flat = [pa.array([w for r in rest for w in r], pa.binary()), pa.array([c for r in rest for c in r.values()], pa.int64())]
                rest_list = pa.ListArray.from_arrays(pa.array(rest_at), pa.StructArray.from_arrays(flat, ["token", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(sizes, pa.int64()), *map(pa.array, sums), pa.array(syms, pa.binary()), rest_list],
                    names=["id", "train", "row", "n_tokens", "known", "base", "within", "syms", "rest"],
                )

    return run


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    def forward(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihoods, all sequences side by side, longest first."""
        sizes = np.array([len(s) for s in sequences])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.concatenate([sequences[k] for k in order])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        total, scale = np.zeros(len(sizes)), np.ones(len(sizes))
        v = self.start[None, :] * self.emit[flat[begin]]
        for k in range(sizes[0]):
            m = alive[k]
            if k:
                v = (v[:m] @ self.move) * self.emit[flat[begin[:m] + k]]
            t = v.sum(axis=1)
            v = v / t[:, None]
            scale[:m] *= t
            if k % 8 == 7:  # one step multiplies by over 1e-30, so eight stay within doubles
                total += np.log10(scale)
                scale[:] = 1.0
        total += np.log10(scale)
        out = np.empty(len(sizes))
        out[order] = total
        return out

    def _forward(self, flat, first, alive, a: int, b: int, before, back_move, emit):
        """Messages of the steps a to b as columns, lane after lane and step after step:
        (symbols, emissions, messages, where each step's begin, the last messages, log10 of
        what was scaled away)."""
        steps = alive[a:b]
        at = np.concatenate([[0], np.cumsum(steps)])
        lane = np.arange(at[-1]) - np.repeat(at[:-1], steps)
        symbols = flat[first[lane] + np.repeat(np.arange(a, b), steps)]
        e = np.stack([row[symbols] for row in emit])
        fwd, v, scales = e.copy(), before, []
        ends = np.append(alive, 0)[a + 1 : b + 1].tolist()
        start = self.start.astype(np.float32)[:, None]
        places = at.tolist()
        for k, stay in enumerate(ends):
            p, q = places[k], places[k + 1]
            x = fwd[:, p:q]
            x *= start if v is None else back_move @ v[:, : q - p]
            if k % 2:  # two steps stay far within single precision
                t = x.sum(axis=0)
                x /= t
                scales.append(t)
            elif stay < q - p:
                scales.append(x[:, stay:].sum(axis=0))
            v = x
        gain = float(np.log10(np.concatenate(scales)).sum(dtype=np.float64)) if scales else 0.0
        return symbols, e, fwd, at, v, gain

    def expect(self, sequences: list[np.ndarray], emit_counts: np.ndarray, move_counts: np.ndarray, start_counts: np.ndarray) -> float:
        """Add the expected counts of whole sequences, longest first, and give their log10
        likelihood. Time runs in blocks of about CELLS tokens: a forward pass keeps the
        messages between them, then every block is redone from the last to the first."""
        sizes = np.array([len(x) for x in sequences])
        first = np.cumsum(sizes) - sizes
        flat = np.concatenate(sequences)
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        block = np.cumsum(alive) // CELLS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(alive)]
        move, emit = self.move.astype(np.float32), np.ascontiguousarray(self.emit.T.astype(np.float32))
        back_move = np.ascontiguousarray(move.T)
        blocks, enters = list(zip(cuts, cuts[1:])), [None]
        for a, b in blocks[:-1]:
            enters.append(self._forward(flat, first, alive, a, b, enters[-1], back_move, emit)[4].copy())
        back, pairs, total = np.ones((STATES, len(sizes)), np.float32), np.zeros((STATES, STATES)), 0.0
        while blocks:
            (a, b), enter = blocks.pop(), enters.pop()
            symbols, e, fwd, at, _, gain = self._forward(flat, first, alive, a, b, enter, back_move, emit)
            total += gain
            steps, places = alive[a:b], at.tolist()
            bwd = np.empty_like(fwd)
            for k in range(b - a - 1, -1, -1):
                p, q = places[k], places[k + 1]
                x = back[:, : q - p]
                bwd[:, p:q] = x
                x = move @ (x * e[:, p:q])
                if k % 2:
                    x /= x.sum(axis=0)
                back[:, : q - p] = x
            # pairs of states: the message that left the step before, and this step's emission and future
            e *= bwd
            before = fwd[:, np.arange(at[1], at[-1]) - np.repeat(steps[:-1], steps[1:])]
            for left, right in ((before, e[:, at[1] :]), *([(enter[:, : steps[0]], e[:, : steps[0]])] if enter is not None else [])):
                norm = ((back_move @ left) * right).sum(axis=0)
                pairs += (left / norm) @ right.T
            bwd *= fwd
            bwd /= bwd.sum(axis=0)
            for k in range(STATES):
                emit_counts[:, k] += np.bincount(symbols, bwd[k], len(emit_counts))
            if enter is None:
                start_counts += bwd[:, : steps[0]].sum(axis=1)
        move_counts += pairs * self.move
        return total


def first_guess(unigram: np.ndarray, seed: int = 11) -> Hmm:
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.gamma(4.0, 0.25, (len(unigram), STATES))
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Hmm(np.full(STATES, 1.0 / STATES), move, emit / emit.sum(axis=0))


def _expectation(model):
    """Expected counts of a task's training texts, whole and side by side with others of
    about their length: blocks of symbols, and -1 for the rest with the log10 likelihood."""

    def run(batches):
        hmm = model.value
        symbols = len(hmm.emit)
        emit, move, start, total = np.zeros((symbols, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES), 0.0
        held: list[np.ndarray] = []
        size = 0

        def work() -> float:
            held.sort(key=len, reverse=True)
            gain = hmm.expect(held, emit, move, start)
            held.clear()
            return gain

        for batch in batches:
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_buffer().to_pybytes(), np.uint16))
                size += len(held[-1])
                if size >= HELD:
                    total += work()
                    size = 0
        if held:
            total += work()
        blocks = range(0, symbols, BLOCK)
        keys = [a // BLOCK for a in blocks] + [-1]
        data = [emit[a : a + BLOCK].tobytes() for a in blocks] + [np.concatenate([move.ravel(), start, [total]]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["block", "counts"])

    return run


def _add(group: pa.Table):
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("counts"))
    yield pa.RecordBatch.from_arrays([pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])


def baum_welch(spark: SparkSession, encoded: DataFrame, unigram: np.ndarray, tokens: int, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """The model, and the training texts' log10 likelihood under the model that every round
    began with. Expectation runs over all training rows of encoded, maximisation on the
    driver; rounds end when a token's likelihood gains less than GAIN."""
    hmm, path = first_guess(unigram), []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(hmm)  # symbols x states doubles, whatever the corpus
        parts = encoded.where("train").select("syms").mapInArrow(tidy(_expectation(shared)), "block int, counts binary")
        rows = {r["block"]: np.frombuffer(r["counts"], np.float64) for r in grouped(parts, ["block"], _add, "block int, counts binary").collect()}
        shared.unpersist()
        if not rows:
            break
        rest = rows.pop(-1)
        path.append(float(rest[-1]))
        if len(path) > 1 and path[-1] - path[-2] < GAIN * max(1, tokens):
            break  # the round's counts would hardly move the model
        emit = np.concatenate([rows[k] for k in sorted(rows)]).reshape(-1, STATES)
        move, start = rest[: STATES**2].reshape(STATES, STATES), rest[STATES**2 : -1]
        emit = emit + PRIOR * unigram[:, None]
        hmm = Hmm((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return hmm, path


def _score(model):
    def run(batches):
        hmm = model.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                got = hmm.forward([np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64) for x in part.column("syms")])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(got)], names=["row", "hmm"])

    return run


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label: str = "hmm") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) of every row; `train`
    is a boolean column, and rows where it is not true are not learned from.

    Words are runs of other than ASCII white space after A-Z are lower-cased, then one
    end, so null and empty texts are one token. The scores are log10 probabilities:
    base_score of the add-one unigram, score of the hidden Markov model. With nothing
    to learn from, every token is unknown. Repeated rows give repeated rows, a null id is
    kept, and other columns are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, label)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = rows.where("train").select("text").mapInArrow(tidy(_count), "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))
    ending = F.crc32(F.expr(f"substring(token, greatest(length(token) - 2, 1), 3)"))
    counts = scratch.save(counts.withColumn("class", F.pmod(ending, F.lit(CLASSES)).cast("int")), "counts")
    lex = build_lexicon(counts)
    shared = spark.sparkContext.broadcast(lex)  # LEXICON words at most
    # `row` tells rows of one id apart; it is fixed once the table is written
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    encoded = rows.mapInArrow(tidy(_encode(shared)), "id long, train boolean, row long, n_tokens long, known long, base double, within double, syms binary, rest array<struct<token:binary,n:long>>")
    encoded = scratch.save(encoded, "encoded")
    unigram = np.zeros(lex.symbols)
    unigram[:CLASSES] = 10.0**lex.class_size
    c = 10.0**lex.base * (lex.total + lex.distinct + 1)
    own = lex.symbol >= CLASSES
    unigram[lex.symbol[own]] = c[own]
    unigram = np.maximum(unigram, 1e-3)
    model = spark.sparkContext.broadcast(baum_welch(spark, encoded, unigram / unigram.sum(), lex.total)[0])
    hmm = encoded.select("row", "syms").mapInArrow(tidy(_score(model)), "row long, hmm double")
    # words outside the lexicon meet their counts
    rest = encoded.select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.n").join(counts.select("token", "c", "class"), "token", "left")
    sizes = F.array(*[F.lit(float(x)) for x in lex.class_size])
    kind = F.coalesce("class", F.pmod(ending, F.lit(CLASSES)).cast("int"))
    more = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("n") * (more - float(np.log10(lex.total + lex.distinct + 1)))).alias("rest_base"),
        F.sum(F.col("n") * (more - F.element_at(sizes, kind + 1))).alias("rest_within"),
    )
    sums = encoded.select("row", "id", "n_tokens", "known", "base", "within")
    out = sums.join(hmm, "row").join(rest, "row", "left")
    zero = F.lit(0)
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", zero)).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", zero)).alias("base_score"),
        (F.col("hmm") + F.col("within") + F.coalesce("rest_within", zero)).alias("score"),
    )


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    out = score_texts(docs, ~held_out, label="op9")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
