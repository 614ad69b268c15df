"""Byte-level BPE as DuckDB recursive queries, one engine per Python worker.

Texts are cut by the vocabulary's pattern. Of the words of a slice of texts those
not yet known go to DuckDB as token-position rows; a recursive query joins neighbours
with the merge table and contracts each word's leftmost pair of minimum rank until
none is left; ordered aggregation gives the ids and, joined with the vocabulary, the
decoded bytes. A text's ids are its words' ids one after another, and so its bytes; of
words that decode to themselves only the ids are remembered. Long words are contracted
as overlapping blocks, which are joined where they agree."""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import tidy

#: Texts and bytes of text answered at a time, and words remembered by each of two generations.
SLICE, SLICE_BYTES, GENERATION = 2048, 1_000_000, 100_000
#: Bytes of the words contracted at a time; longer words than LONG go as blocks.
FRESH, LONG = 250_000, 64
#: Bytes of a block, a new one every STRIDE; blocks grown over WIDE go alone, STEPS rows at a time.
BLOCK, STRIDE, WIDE, STEPS = 128, 64, 1024, 1_000_000

# A row is a token, its place in its word, and the token that follows it (-1 at the end).
# A round contracts every word's leftmost pair of minimum rank: the pair's second row
# becomes the merged token, its first row goes, and the row before it learns its new
# neighbour. Words without a pair are settled and don't go on.
_CONTRACT = """
WITH RECURSIVE step(word, pos, tok, nxt, live) AS (
    SELECT word, pos, tok, nxt, true FROM fresh
    UNION ALL
    (WITH best AS (
        SELECT word, min((merged::BIGINT << 20) | pos) AS b
        FROM step JOIN merges ON pair = ((tok::BIGINT << 32) | nxt) WHERE live GROUP BY word
    ), chosen AS (
        SELECT word, (b >> 20)::INTEGER AS merged, (b & 1048575)::INTEGER AS at FROM best
    )
    SELECT s.word, CASE WHEN s.pos > c.at THEN s.pos - 1 ELSE s.pos END,
           CASE WHEN s.pos = c.at + 1 THEN c.merged ELSE s.tok END,
           CASE WHEN s.pos = c.at - 1 THEN c.merged ELSE s.nxt END, c.at IS NOT NULL
    FROM step s LEFT JOIN chosen c USING (word)
    WHERE s.live AND (c.at IS NULL OR s.pos <> c.at))
)
SELECT list({'word': s.word, 'id': s.tok, 'piece': v.piece} ORDER BY (s.word::BIGINT << 20) | s.pos) AS toks
FROM step s JOIN vocabulary v ON v.id = s.tok WHERE NOT s.live
"""

# One wide block. All its pairs of the minimum rank contract in a round, leftmost first
# and never overlapping, up to the first whose merged token makes a pair of a smaller
# rank with a neighbour, which would have to go before the next.
_CONTRACT_LONG = """
WITH RECURSIVE step(round, pos, tok, live) AS (
    SELECT 0, pos, tok, true FROM fresh
    UNION ALL
    (WITH p AS (
        SELECT round, tok, lag(tok) OVER w AS prev, lead(tok) OVER w AS nxt, lead(tok, 2) OVER w AS after, row_number() OVER w AS k
        FROM step WHERE live AND round < $rounds WINDOW w AS (ORDER BY pos)
    ), c AS (
        SELECT p.*, m.merged, min(m.merged) OVER () AS best FROM p JOIN merges m ON m.pair = ((p.tok::BIGINT << 32) | p.nxt)
    ), b AS (
        SELECT *, k - row_number() OVER (ORDER BY k) AS island FROM c WHERE merged = best
    ), q AS (
        SELECT *, row_number() OVER (PARTITION BY island ORDER BY k) AS nth FROM b
    ), apart AS (
        SELECT *, lag(k) OVER (ORDER BY k) AS last FROM q WHERE nth % 2 = 1
    ), o AS (
        SELECT k, a.merged, l.merged < a.merged OR r.merged < a.merged AS stirs
        FROM apart a LEFT JOIN merges l ON l.pair = ((CASE WHEN last = k - 2 THEN a.merged ELSE prev END::BIGINT << 32) | a.merged)
               LEFT JOIN merges r ON r.pair = ((a.merged::BIGINT << 32) | after)
    ), chosen AS (
        SELECT k, merged FROM o WHERE k <= coalesce((SELECT min(k) FROM o WHERE stirs), k)
    )
    SELECT p.round + 1, p.k::INTEGER, coalesce(h.merged, p.tok), (SELECT count(*) > 0 FROM chosen)
    FROM p LEFT JOIN chosen h ON h.k = p.k LEFT JOIN chosen g ON g.k = p.k - 1
    WHERE g.k IS NULL)
)
SELECT pos, tok, live FROM step WHERE NOT live OR round = $rounds ORDER BY pos
"""

_DECODE = "SELECT f.word, list(v.piece ORDER BY f.pos) AS pieces FROM fresh f JOIN vocabulary v ON v.id = f.tok GROUP BY f.word ORDER BY f.word"


class Coder:
    """Encodes and decodes words with the ranks of a .tiktoken file."""

    def __init__(self, ranks_path: str, pattern: str, generation: int = GENERATION):
        import duckdb

        self.split = splitter(pattern)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}
        self.generation = generation
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of an id
        self.length[list(ranks.values())] = [len(t) for t in ranks]
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b), merged.append(rank)
        merges = pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int32())})
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array(list(ranks), pa.binary())})
        # in memory only: what a query holds is bounded by FRESH and STEPS
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.known: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}  # what words decode to that don't decode to themselves

    def _learn(self, words: list[str]) -> None:
        part, size, long, room = [], 0, [], 0
        for w in words:
            if len(w) * 4 > LONG and len(w.encode()) > LONG:
                long.append(w)
                room += len(w)
                if room >= FRESH:
                    self._long(long)
                    long, room = [], 0
                continue
            part.append(w)
            size += len(w)
            if size >= FRESH:
                self._short(part)
                part, size = [], 0
        if part:
            self._short(part)
        if long:
            self._long(long)

    def _contract(self, tok: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
        """Where the tokens of every span of tok end, and (word, id, piece) of the tokens."""
        n = ends - starts
        word = np.repeat(np.arange(len(n), dtype=np.int32), n)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        tok = tok[starts[word] + pos]
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[np.cumsum(n) - 1] = -1
        toks = self._run(_CONTRACT, pa.table({"word": word, "pos": pos, "tok": tok, "nxt": nxt})).column("toks").combine_chunks()
        toks = (toks.chunk(0) if isinstance(toks, pa.ChunkedArray) else toks).flatten()
        return np.cumsum(np.bincount(toks.field(0).to_numpy(), minlength=len(n))), toks

    def _short(self, words: list[str]) -> None:
        raw = pa.array(words, pa.string())
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[: len(words) + 1]
        tok = self.byte_ids[np.frombuffer(raw.buffers()[2], np.uint8)[: offsets[-1]]]
        of, toks = self._contract(tok, offsets[:-1], offsets[1:])
        of = pa.array(np.append(0, of).astype(np.int32))
        self.known.update(zip(words, pc.binary_join(pa.ListArray.from_arrays(of, toks.field(1).cast(pa.string())), " ").to_pylist()))
        decoded = pc.binary_join(pa.ListArray.from_arrays(of, toks.field(2)), b"")
        for k in np.flatnonzero(pc.not_equal(decoded, raw.cast(pa.binary())).to_numpy(zero_copy_only=False)).tolist():
            self.odd[words[k]] = decoded[k].as_py()

    def _long(self, words: list[str]) -> None:
        raws = [w.encode() for w in words]
        ids = self._blocks(raws)
        word = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
        flat = np.concatenate(ids)
        pieces = self._run(_DECODE, pa.table({"word": word, "pos": np.arange(len(flat), dtype=np.int32), "tok": flat})).column("pieces")
        for w, raw, own, decoded in zip(words, raws, ids, pieces):
            self.known[w] = " ".join(map(str, own.tolist()))
            decoded = b"".join(decoded.as_py())
            if decoded != raw:
                self.odd[w] = decoded

    def _blocks(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of every word, from blocks contracted as words of their own. Neighbours
        are joined at a token that both have at the same place, so any two tokens that
        follow each other in the result do so in a block. That makes the result exact: until
        a first contraction across the end of one of its tokens the word's tokens grow as
        in the block that has both sides, where that contraction would have come too.
        Neighbours that share no token become one block, with as much beside them as they
        had grown already, and are contracted anew."""
        tok = self.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
        spans, at = [], 0  # word, start, end
        for k, raw in enumerate(raws):
            end = at + len(raw)
            spans += [(k, s, min(s + BLOCK, end)) for s in range(at, max(end - STRIDE, at + 1), STRIDE)]
            at = end
        keys: dict[tuple, np.ndarray] = {}  # of a span: start << 32 | id of its tokens
        while True:
            self._contract_spans(tok, [s for s in spans if s not in keys], keys)
            joints, merge = [], np.zeros(len(spans), bool)
            for j, (a, b) in enumerate(pairwise(spans)):
                joints.append(-1)
                if a[0] == b[0]:
                    left, right = keys[a], keys[b]
                    same = np.intersect1d(left[np.searchsorted(left, b[1] << 32) :], right[: np.searchsorted(right, a[2] << 32)], assume_unique=True)
                    if same.size:
                        joints[-1] = int(same[0])
                    else:
                        grown = (a[2] - a[1] + b[2] - b[1]) // BLOCK - 2
                        merge[max(0, j - max(0, grown)) : j + max(0, grown) + 1] = True
            if not merge.any():
                break
            wider = [spans[0]]
            for j, s in enumerate(spans[1:]):
                if merge[j] and s[0] == wider[-1][0]:
                    wider[-1] = (s[0], wider[-1][1], s[2])
                else:
                    wider.append(s)
            kept = set(wider)
            spans, keys = wider, {s: x for s, x in keys.items() if s in kept}
        out, after = [[] for _ in raws], -1
        for s, joint in zip(spans, [*joints, -1]):
            own = keys[s]
            own = own[np.searchsorted(own, after, "right") : np.searchsorted(own, joint, "right") if joint >= 0 else None]
            out[s[0]].append((own & 0xFFFFFFFF).astype(np.int32))
            after = joint
        return [np.concatenate(x) for x in out]

    def _contract_spans(self, tok: np.ndarray, spans: list[tuple], keys: dict) -> None:
        part, size = [], 0
        for k, s in enumerate(spans):
            if s[2] - s[1] > WIDE:
                ids = self._whole(tok[s[1] : s[2]])
                n = self.length[ids]
                keys[s] = (s[1] + np.cumsum(n) - n) << 32 | ids
            else:
                part.append(s)
                size += s[2] - s[1]
            if part and (size >= FRESH or k == len(spans) - 1):
                of, toks = self._contract(tok, np.array([x[1] for x in part]), np.array([x[2] for x in part]))
                ids = toks.field(1).to_numpy().astype(np.int64)
                for x, own in zip(part, np.split(ids, of[:-1])):
                    n = self.length[own]
                    keys[x] = (x[1] + np.cumsum(n) - n) << 32 | own
                part, size = [], 0

    def _whole(self, tok: np.ndarray) -> np.ndarray:
        while True:
            fresh = pa.table({"pos": np.arange(len(tok), dtype=np.int32), "tok": tok})
            out = self._run(_CONTRACT_LONG, fresh, {"rounds": max(1, STEPS // len(tok))})
            tok = out.column("tok").to_numpy()
            if not out.column("live")[0].as_py():
                return tok.astype(np.int64)

    def _run(self, sql: str, fresh: pa.Table, values: dict | None = None) -> pa.Table:
        self.db.register("fresh", fresh)
        out = self.db.execute(sql, values).to_arrow_table() if values else self.db.sql(sql).to_arrow_table()
        self.db.unregister("fresh")
        return out

    def encode(self, words: pa.StringArray) -> tuple[pa.StringArray, pa.BinaryArray]:
        """The ids of every word and what they decode to; words not seen for two
        generations are forgotten."""
        if len(self.known) > self.generation:
            self.old, self.known = self.known, {}
        distinct = words.dictionary_encode()
        kinds = distinct.dictionary.to_pylist()
        fresh = []
        for w in kinds:
            if w not in self.known:
                ids = self.old.get(w)
                if ids is None:
                    fresh.append(w)
                else:
                    self.known[w] = ids
        if fresh:
            self._learn(fresh)
        ids = pa.array([self.known[w] for w in kinds], pa.string()).take(distinct.indices)
        if not self.odd:
            return ids, words.cast(pa.binary())
        return ids, pa.array([self.odd.get(w) or w.encode() for w in kinds], pa.binary()).take(distinct.indices)


def splitter(pattern: str):
    """findall of the pattern. Latin-1 texts take the standard library's engine, which is
    faster, with the Unicode classes spelled out, if the pattern has no other escapes."""
    import regex

    every = regex.compile(pattern).findall
    escapes = re.findall(r"\\(?:p\{\w+\}|.)", pattern, re.S)
    if set(escapes) - {r"\p{L}", r"\p{N}", r"\s", r"\S"} or re.search(r"\(\?[^!=]", pattern):
        return every
    spelled = {e: "".join(re.escape(chr(c)) for c in range(256) if regex.fullmatch(e.lower() if e == r"\S" else e, chr(c))) for e in set(escapes)}
    parts, inside = [], False
    for x in re.findall(r"\\(?:p\{\w+\}|.)|.", pattern, re.S):
        if x in spelled:
            if inside and x == r"\S":
                return every
            parts.append(spelled[x] if inside else f"[{'^' if x == r'\S' else ''}{spelled[x]}]")
        else:
            inside = x == "[" or inside and x != "]"
            parts.append(x)
    latin = re.compile("".join(parts)).findall

    def split(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return every(text)
        return latin(text)

    return split


_coders: dict[tuple, Coder] = {}


def coder(ranks_path: str, pattern: str) -> Coder:
    key = (ranks_path, pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(*key)
    return _coders[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids, decoded, ids_sha256, decoded_sha256) of every row; ids is
    the decimal ids joined by one space and decoded the UTF-8 bytes, both null unless `keep`.
    Null and empty texts have no tokens, '' and b''. Special tokens are ordinary text.
    Repeated rows give repeated rows; other columns are ignored. The file must be
    readable under the same path by every executor, as an installed package is."""

    def answer(c: Coder, ids: list, words: list[str], ends: list[int]) -> pa.RecordBatch:
        offsets = pa.array([0, *ends], pa.int32())
        tokens, decoded = c.encode(pa.array(words, pa.string()))
        tokens = pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")
        decoded = pc.binary_join(pa.ListArray.from_arrays(offsets, decoded), b"")
        n = pc.if_else(pc.equal(tokens, ""), 0, pc.add(pc.count_substring(tokens, " "), 1)).cast(pa.int64())
        shas = (pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column]) for column in (tokens, decoded))
        gone = pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), n, *((tokens, decoded) if keep else gone), *shas], names=["id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    def run(batches):
        c = coder(ranks_path, pattern)
        for batch in batches:
            ids, words, ends, size = [], [], [], 0
            for i, x in zip(batch.column(0), batch.column(1)):
                text = x.as_py() or ""
                ids.append(i.as_py())
                words += c.split(text)
                ends.append(len(words))
                size += len(text)
                if size >= SLICE_BYTES or len(ids) == SLICE:
                    yield answer(c, ids, words, ends)
                    ids, words, ends, size = [], [], [], 0
            if ids:
                yield answer(c, ids, words, ends)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "id long, n_tokens long, ids string, decoded binary, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=False).drop("ids", "decoded")
