"""Exact removal of repeated byte strings with per-shard suffix arrays.

A byte goes when it lies in a string of `length` bytes that also starts elsewhere.
The search runs in four steps, none of which compares all texts with all texts.

1. Winnowing picks anchors: a GRAM-byte hash that is the minimum of a run of
   consecutive hashes. Equal strings of `length` bytes pick the same anchors, so a
   repeat is always seen at an anchor both of its places share. Around an anchor
   lies its context: all bytes that a string holding the anchor can reach.
2. Contexts that occur twice as a whole are covered as a whole, by counting.
3. Anchors with several different contexts are looked at by quarters, ranges of places
   where strings start. Contexts alike around all strings of a quarter are counted
   again; those that only share its core go to shards of bounded size. Each shard
   sorts the suffixes of its contexts by Larsson-Sadakane refinement, takes Kasai's
   common prefixes, and covers the strings that occur twice in it.
4. An anchor with more contexts than a shard holds is spread over several; each
   writes the sorted digests of its strings, cut into ranges, and a merge of one
   range finds by binary search those that another shard holds too.

Only occurrences of repeated anchors meet the texts again."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import Scratch, grouped, keep_ids, one_row_per_id, parallelism, tidy

GRAM, SHARD_BYTES, PART, QUARTERS, SALTS, BATCH_BYTES, SCAN_BYTES = 128, 1_000_000, 4096, 4, 64, 1 << 22, 1 << 15


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all `gram`-byte strings (a power of two), by doubling."""
    h = data.astype(np.uint64)
    h += np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    size = 1
    while size < gram:
        nxt = h[:-size] * np.uint64(0xD6E8FEB86659FD93 + 2 * size)
        nxt += h[size:]
        nxt ^= nxt >> np.uint64(32)
        h, size = nxt, size * 2
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, width: int, op, fill) -> np.ndarray:
    """op over every window of `width`, by block prefixes and suffixes."""
    n = len(x)
    pad = -n % width
    full = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, width)
    left = op.accumulate(full, axis=1).ravel()
    right = op.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, texts) of the grams that are the minimum of some window; all
    ties. data holds texts of these sizes one after another; no window crosses their ends."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    h = _gram_hashes(data, gram)
    width = length - gram + 1
    low = _sliding(h, width, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    ends = np.cumsum(sizes)
    for end in ends[:-1].tolist():
        low[max(0, end - length + 1) : end] = 0
    # the largest of the minima of the windows that hold a gram
    edge = np.zeros(width - 1, np.uint64)
    high = _sliding(np.concatenate([edge, low, edge]), width, np.maximum, np.uint64(0))
    at = np.flatnonzero(high == h)
    owner = np.searchsorted(ends, at, "right")
    inside = at + gram <= ends[owner]  # a hash may be 0
    at, owner = at[inside], owner[inside]
    return at, h[at], owner


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal disjoint runs; touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([new[1:], [True]])]


def _raw(scalar) -> bytes:
    return scalar.as_buffer().to_pybytes() if scalar.is_valid else b""


def _scan(length: int, gram: int):
    """Per text its size and digest, the runs repeated inside it, and its distinct (anchor, context)s.
    Short texts are looked at together."""
    reach = length - gram

    def several(raws: list[bytes]) -> tuple:
        joined = b"".join(raws)
        sizes = np.array([len(x) for x in raws], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        at, fp, owner = anchors(np.frombuffer(joined, np.uint8), sizes, length, gram)
        lo = np.maximum(at - reach, begins[owner])
        hi = np.minimum(at + gram + reach, ends[owner])
        ctx = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(lo.tolist(), hi.tolist())), np.uint64, len(at))
        ctx ^= (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key = fp * np.uint64(0xD6E8FEB86659FD93) + ctx
        order = np.lexsort((key, owner))
        new = np.ones(len(at), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(at)))
        first = order[head]
        twice = order[np.repeat(count > 1, count)]
        inner = [b""] * len(raws)
        for k in np.unique(owner[twice]).tolist():
            own = twice[owner[twice] == k]
            inner[k] = np.stack(merged(lo[own] - begins[k], hi[own] - begins[k]), 1).astype(np.int64).tobytes()
        return np.bincount(owner[first], minlength=len(raws)), inner, fp[first].view(np.int64), ctx[first].view(np.int64), (at - begins[owner])[first], (count > 1).astype(np.int8)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                raws = [_raw(x) for x in part.column(1)]
                group = np.cumsum([len(x) for x in raws]) // SCAN_BYTES
                cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(raws)]
                n, inner, *flat = zip(*(several(raws[i:j]) for i, j in zip(cuts, cuts[1:])))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(n))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), t)) for x, t in zip(flat, (pa.int64(), pa.int64(), pa.int64(), pa.int8()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in raws], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raws]), pa.array([x for y in inner for x in y], pa.binary()), *lists],
                    names=["id", "n_bytes", "sha", "inner", "fp", "ctx", "at", "many"],
                )

    return run


def quarters(length: int, gram: int) -> list[tuple[int, int, int, int]]:
    """The places before an anchor where a string may start, in QUARTERS equally long
    ranges: (first place, width, bytes before and after the anchor in all its strings)."""
    reach = length - gram
    width = -(-(reach + 1) // QUARTERS)
    first = sorted({min(width * q, reach + 1 - width) for q in range(QUARTERS)})
    return [(b, width, b, reach - (b + width - 1)) for b in first]


def _quarter(piece: bytes, before: int, gram: int, part: tuple) -> tuple[bytes, bytes, bytes] | None:
    """(bytes before, core, bytes after) of one quarter: strings that start in it hold the
    core and width - 1 bytes around it. None where the text ends inside the core."""
    _, width, left, right = part
    a, b = before - left, before + gram + right
    if a < 0 or b > len(piece):
        return None
    return piece[max(0, a - width + 1) : a], piece[a:b], piece[b : b + width - 1]


def _cut(length: int, gram: int):
    """The bytes of the wanted contexts of one text, and for every quarter hashes of its
    core and of what is around it."""
    reach = length - gram
    ranges = quarters(length, gram)

    def run(batches):
        for batch in batches:
            wants = batch.column("wants")
            ids = batch.column("id").to_numpy()
            ends = np.cumsum(wants.value_lengths().to_numpy())
            fps, ctxs, ats = (wants.flatten().field(k).to_numpy() for k in ("fp", "ctx", "at"))
            begun = row = 0
            while row < batch.num_rows:
                pieces, before, owner, n, qs, keys, exts = [], [], [], [], [], [], []
                held = 0
                while row < batch.num_rows and held < BATCH_BYTES:
                    raw = _raw(batch.column("text")[row])
                    for at in ats[begun + len(pieces) : ends[row]].tolist():
                        lo = max(0, at - reach)
                        piece = raw[lo : at + gram + reach]
                        k = len(qs)
                        for q, part in enumerate(ranges):
                            if got := _quarter(piece, at - lo, gram, part):
                                x, core, y = got
                                qs.append(q)
                                keys.append(xxhash.xxh3_64_intdigest(core, seed=q + 1))
                                exts.append(xxhash.xxh3_64_intdigest(x + y, seed=len(x) + 1))
                        n.append(len(qs) - k)
                        pieces.append(piece)
                        before.append(at - lo)
                        owner.append(row)
                        held += len(piece)
                    row += 1
                now = slice(begun, begun + len(pieces))
                begun += len(pieces)
                hashed = pa.StructArray.from_arrays([pa.array(qs, pa.int32()), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, exts)]], names=["q", "key", "ext"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                before = np.array(before, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps[now]), pa.array(ctxs[now]), pa.array(before), pa.array(pieces, pa.binary()), pa.array(ids[np.array(owner, np.int64)]), pa.array(ats[now] - before), pa.ListArray.from_arrays(offsets, hashed)],
                    names=["fp", "ctx", "before", "bytes", "id", "from", "quarters"],
                )

    return run


def _order(first: np.ndarray, second: np.ndarray, most: int) -> np.ndarray:
    """Order of the pairs, both below `most`; packed with their places where 64 bits hold
    them, as numbers are sorted several times faster than indexes."""
    bits, places = (most - 1).bit_length(), (len(first) - 1).bit_length()
    if 2 * bits + places > 63:
        return np.argsort(first * np.int64(most) + second)
    packed = (first << (bits + places)) | (second << places) | np.arange(len(first))
    packed.sort()
    return packed & ((1 << places) - 1)


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) by Larsson-Sadakane: groups of equal prefixes are
    refined by the ranks of the suffixes one prefix further on, and settled suffixes
    are not touched again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    sa = np.argsort(key)
    k_sorted = key[sa]
    # a suffix that ends inside the key ranks before those that go on with zeros
    for k in range(max(0, n - 7), n):
        a, b = np.searchsorted(k_sorted, key[k], "left"), np.searchsorted(k_sorted, key[k], "right")
        if b - a > 1:
            sa[a:b] = sa[a:b][np.argsort(np.minimum(n - sa[a:b], 8), kind="stable")]
    tail = np.minimum(n - sa, 8)
    new = np.ones(n, bool)
    new[1:] = (k_sorted[1:] != k_sorted[:-1]) | (tail[1:] != tail[:-1])
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = head
    h = 8
    while True:
        last = np.append(new[1:], True)
        loose = np.flatnonzero(~(new & last))
        if not len(loose):
            break
        s = sa[loose]
        ahead = s + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[s]
        order = _order(group, second, n + 1)
        s, group, second = s[order], group[order], second[order]
        sa[loose] = s
        fresh = np.ones(len(loose), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        new[loose] = fresh
        rank[s] = np.maximum.accumulate(np.where(fresh, loose, 0))
        h *= 2
    inverse = np.empty(n, np.int64)
    inverse[sa] = np.arange(n)
    return sa, inverse


def common_prefixes(text: np.ndarray, sa: np.ndarray, inverse: np.ndarray, offsets: np.ndarray, cap: int) -> np.ndarray:
    """Kasai: for each place of sa the prefix shared with its predecessor, up to cap.
    The walks over the contexts of a shard run side by side, each keeping its own
    length, which falls by one at most from a byte to the next."""
    n = len(text)
    lcp = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(n + 1, np.uint64)
    for k in range(8):
        words[:n] |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    pos, end = offsets[:-1].astype(np.int64).copy(), offsets[1:].astype(np.int64)
    live = np.flatnonzero(pos < end)
    h = np.zeros(len(pos), np.int64)
    while len(live):
        i = pos[live]
        place = inverse[i]
        j = sa[np.maximum(place - 1, 0)]
        hl = h[live]
        a, b = i + hl, j + hl
        room = np.minimum(n - np.maximum(a, b), cap - hl)
        room[place == 0] = 0
        inside = room > 0
        diff = words[np.where(inside, a, 0)] ^ words[np.where(inside, b, 0)]
        low = diff & (~diff + np.uint64(1))
        same = np.where(diff == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
        step = np.minimum(same, np.maximum(room, 0))
        hl = hl + step
        done = (step < 8) | (room <= 8)
        lcp[place[done]] = np.where(place[done] > 0, hl[done], 0)
        h[live] = np.where(done, np.maximum(hl - 1, 0), hl)
        pos[live[done]] += 1
        live = live[pos[live] < end[live]]
    return lcp


def _several(run: np.ndarray, docs: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """For each of n runs whether it holds more than one place of the texts."""
    out = np.zeros(n, bool)
    if not len(run):
        return out
    if (run[1:] < run[:-1]).any():
        order = np.argsort(run)
        run, docs, places = run[order], docs[order], places[order]
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    for x in (docs, places):
        out[run[first]] |= np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first)
    return out


def _shard(length: int, gram: int):
    """Cover what repeats among the contexts of a shard; publish the strings of the
    anchors that other shards hold too. A quarter's strings differ only around its core,
    so its text has the core's 8-byte hash in the core's place."""
    ranges = quarters(length, gram)
    need = ranges[0][1] - 1 + 8

    def run(group: pa.Table):
        fps, ctxs = group.column("fp").to_numpy(), group.column("ctx").to_numpy()
        parts, docs, origin, ahead = (group.column(k).to_numpy() for k in ("parts", "id", "from", "before"))
        shard = group.column("shard")[0].as_py()
        pieces = [x.as_buffer().to_pybytes() for x in group.column("bytes")]
        segs, row, rel = [], [], []  # of every segment: its row, and its first byte's place from the anchor
        for k, wanted in enumerate(group.column("wanted").to_pylist()):
            for q in wanted:
                x, core, y = _quarter(pieces[k], int(ahead[k]), gram, ranges[q])
                segs.append(x + xxhash.xxh3_64_digest(core, seed=q + 1) + y)
                row.append(k)
                rel.append(-ranges[q][2] - len(x))
        row, rel = np.array(row), np.array(rel)
        sizes = np.array([len(x) for x in segs], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        text = np.frombuffer(b"".join(segs), np.uint8)
        sa, inverse = suffix_order(text)
        lcp = common_prefixes(text, sa, inverse, offsets, need)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(text)) - offsets[:-1][owner]
        # a string starts at the core's hash at the latest
        starts_ok = (offsets[1:][owner] - np.arange(len(text)) >= need) & (sizes[owner] - inside >= need) & (inside <= -(rel[owner] + np.array([ranges[q][2] for w in group.column("wanted").to_pylist() for q in w])[owner]))
        at_text = origin[row][owner] + ahead[row][owner] + rel[owner] + inside
        run_id = np.cumsum(lcp < need)
        valid = starts_ok[sa]
        v = sa[valid]
        several = _several(run_id[valid], docs[row[owner[v]]], at_text[v], run_id[-1] + 1 if len(run_id) else 1)
        at = np.sort(sa[valid & several[run_id]])
        names = ["kind", "fp", "ctx", "lo", "hi", "range", "digests", "ctxs", "starts", "ids", "places"]
        if len(at):
            own = owner[at]
            begin = rel[own] + inside[at]
            new = np.ones(len(at), bool)
            new[1:] = (own[1:] != own[:-1]) | (at[1:] - at[:-1] > length)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            m = len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), pa.array(fps[row[own[first]]]), pa.array(ctxs[row[own[first]]]), pa.array(begin[first].astype(np.int32)), pa.array((begin[last] + length).astype(np.int32)), pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.binary())] * 5],
                names=names,
            )
        if (parts > 1).any():
            starts = np.flatnonzero(starts_ok & (parts[row[owner]] > 1))
            raw = text.tobytes()
            digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + need]) for a in starts.tolist()), np.uint64, len(starts))
            k = row[owner[starts]]
            span = ((digest >> np.uint64(40)) % parts[k].astype(np.uint64)).astype(np.int32)
            order = np.lexsort((digest, span, fps[k]))
            starts, k, digest, span = starts[order], k[order], digest[order], span[order]
            f = fps[k]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (span[1:] != span[:-1])
            cuts = np.append(np.flatnonzero(new), len(f))
            begin = (rel[owner[starts]] + inside[starts]).astype(np.int32)
            c, ids, places = ctxs[k], docs[k], at_text[starts]
            for a, b in zip(cuts, cuts[1:]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([1], pa.int32()), pa.array([f[a]], pa.int64()), pa.array([shard], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([span[a]], pa.int32()), *[pa.array([x[a:b].tobytes()], pa.binary()) for x in (digest, c, begin, ids, places)]],
                    names=names,
                )

    return run


def _merge(length: int):
    """One digest range of one anchor: strings of a shard found in another by binary search."""

    def run(group: pa.Table):
        fp = group.column("fp")[0].as_py()
        kinds = {"digests": np.uint64, "ctxs": np.int64, "starts": np.int32, "ids": np.int64, "places": np.int64}
        rows = list(zip(*([np.frombuffer(x.as_buffer(), t) for x in group.column(k)] for k, t in kinds.items())))
        values, which = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        several = values[_several(which, np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows]), len(values))]
        for d, c, s, _, _ in rows:
            spot = np.searchsorted(several, d)
            hit = np.flatnonzero(np.append(several, 0)[spot] == d) if len(several) else []
            if not len(hit):
                continue
            order = np.lexsort((s[hit], c[hit]))
            cc, ss = c[hit][order], s[hit][order]
            new = np.ones(len(cc), bool)
            new[1:] = (cc[1:] != cc[:-1]) | (ss[1:] - ss[:-1] > length)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(cc)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), fp)), pa.array(cc[first]), pa.array(ss[first]), pa.array(ss[last] + np.int32(length))], names=["fp", "ctx", "lo", "hi"])

    return run


def _strip(batches):
    for batch in batches:
        row = 0
        while row < batch.num_rows:
            begun, held = row, 0
            removed, counts, digests, rests, texts, los, his = [], [], [], [], [], [], []
            while row < batch.num_rows and held < BATCH_BYTES:
                raw = _raw(batch.column("text")[row])
                spans = np.frombuffer(_raw(batch.column("inner")[row]), np.int64).reshape(-1, 2)
                more = batch.column("spans")[row]
                if more.is_valid:
                    spans = np.concatenate([spans, np.stack([more.values.field(k).to_numpy() for k in ("lo", "hi")], 1)])
                s, e = merged(spans[:, 0], spans[:, 1])
                cuts = [0, *np.stack([s, e], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                removed.append(len(raw) - len(kept))
                counts.append(len(s))
                digests.append(hashlib.sha256(kept).hexdigest())
                rests.append(kept)
                texts.append(kept.decode("utf-8", "ignore"))
                los.append(s)
                his.append(e)
                held += len(raw)
                row += 1
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (los, his)], names=["lo", "hi"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(begun, row - begun), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests), pa.array(rests, pa.binary()), pa.array(texts), pa.ListArray.from_arrays(offsets, flat)],
                names=["id", "n_removed", "n_spans", "kept_sha256", "kept", "text", "spans"],
            )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = GRAM, label: str = "suffix", shard_bytes: int = SHARD_BYTES, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(summary, changed): summary has (id, n_bytes, sha) for every row of docs; changed
    has (id, n_removed, n_spans, kept_sha256, kept, text, spans) for the rows that lose
    bytes; text is kept without the halves of characters a cut may leave.

    Texts are UTF-8 bytes; null and empty ones have none and lose none. Equal texts
    of `length` bytes or more are removed whole, in every row. Of rows that repeat an id the
    one with the least text counts, rows without an id are left out; other columns are
    ignored; an empty table gives empty results. length must be at least
    twice `gram`, a power of two."""
    spark = docs.sparkSession
    scratch = Scratch(spark, label)
    base = one_row_per_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    scanned = base.mapInArrow(tidy(_scan(length, gram)), "id long, n_bytes long, sha string, inner binary, fp array<long>, ctx array<long>, at array<long>, many array<byte>")
    scanned = scratch.save(scanned, "scanned")
    seen = scanned.select("id", F.explode(F.arrays_zip("fp", "ctx", "at", "many")).alias("x")).select("id", "x.fp", "x.ctx", "x.at", "x.many")
    # a row lists a context once, so the least id has one place; plain columns are aggregated by hash
    contexts = seen.groupBy("fp", "ctx").agg(F.sum(F.col("many") + 1).alias("n"), F.min("id").alias("id"), F.min_by("at", "id").alias("at"))
    contexts = contexts.withColumn("salt", F.pmod("ctx", F.lit(SALTS)).cast("int"))
    # an anchor's totals go back to its contexts salt by salt, as one anchor may have any number of them
    by_salt = contexts.groupBy("fp", "salt").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    per_anchor = by_salt.groupBy("fp").agg(F.sum("n").alias("total"), F.sum("kinds").alias("kinds"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")).where("total > 1")
    per_anchor = per_anchor.select("fp", "kinds", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)).alias("salt"))
    contexts = scratch.save(contexts.join(per_anchor, ["fp", "salt"]).select("fp", "ctx", "n", "kinds", "id", "at"), "contexts")
    # different contexts of one anchor: shards of suffix arrays
    mixed = contexts.where("kinds > 1")
    wants = scratch.save(mixed.groupBy("id").agg(F.collect_list(F.struct("fp", "ctx", "at")).alias("wants")), "wants")
    pieces = keep_ids(base, wants).join(wants, "id").mapInArrow(tidy(_cut(length, gram)), "fp long, ctx long, before int, bytes binary, id long, from long, quarters array<struct<q:int,key:long,ext:long>>")
    pieces = scratch.save(pieces, "pieces")
    # contexts alike around a quarter's core repeat all its strings; others that share
    # the core may repeat some, which their suffixes tell
    keyed = pieces.select("fp", "ctx", F.explode("quarters").alias("x")).select("fp", "ctx", "x.q", "x.key", "x.ext")
    kinds = scratch.save(keyed.groupBy("fp", "q", "key", "ext").agg(F.count("*").alias("n"), F.min("ctx").alias("ctx")), "kinds")
    shared = kinds.groupBy("fp", "q", "key").agg(F.count("*").alias("k")).where("k > 1").select("fp", "q", "key")
    live = kinds.join(shared, ["fp", "q", "key"]).groupBy("fp", "ctx").agg(F.array_sort(F.collect_set("q")).alias("wanted"))
    live = scratch.save(live, "live")
    ranges = quarters(length, gram)
    table = F.array(*[F.struct(F.lit(-(b + w - 1)).alias("lo"), F.lit(length - b).alias("hi")) for b, w, _, _ in ranges])
    alike = keyed.join(kinds.where("n > 1").select("fp", "q", "key", "ext"), ["fp", "q", "key", "ext"]).select("fp", "ctx", F.element_at(table, F.col("q") + 1).alias("s")).select("fp", "ctx", "s.lo", "s.hi")
    size, n = live.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0)), F.count("*")).first()
    few = 2 * n < pieces.count()  # else a filter would pass nearly all pieces through Python for nothing
    shards = max(parallelism(spark), size * (2 * ranges[0][1] + 6) // shard_bytes + 1)
    live = live.withColumn("salt", F.pmod("ctx", F.lit(SALTS)).cast("int"))
    parts = live.groupBy("fp", "salt").agg(F.count("*").alias("n")).groupBy("fp").agg(F.ceil(F.sum("n") / part).cast("int").alias("parts"), F.collect_list("salt").alias("salts"))
    live = live.join(parts.select("fp", "parts", F.explode("salts").alias("salt")), ["fp", "salt"]).drop("salt")
    pieces = pieces.drop("quarters")
    if few:
        pieces = keep_ids(pieces, live, "ctx")
    pieces = pieces.join(live, ["fp", "ctx"])
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("fp", F.pmod(F.col("ctx"), F.col("parts"))), F.lit(shards)))
    found = scratch.save(grouped(pieces, ["shard"], _shard(length, gram), "kind int, fp long, ctx long, lo int, hi int, range int, digests binary, ctxs binary, starts binary, ids binary, places binary"), "found")
    across = grouped(found.where("kind = 1").select("fp", "range", "digests", "ctxs", "starts", "ids", "places"), ["fp", "range"], _merge(length), "fp long, ctx long, lo int, hi int")
    whole = contexts.where("n > 1").select("fp", "ctx", F.lit(-(length - gram)).alias("lo"), F.lit(length).alias("hi"))
    verdicts = whole.union(alike).union(found.where("kind = 0").select("fp", "ctx", "lo", "hi")).union(across)
    # all strings of a context hold its anchor, so what they cover is one run
    verdicts = verdicts.groupBy("fp", "ctx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    hits = seen.where("many = 0").select("id", "fp", "ctx", "at").join(verdicts, ["fp", "ctx"])
    hits = hits.groupBy("id").agg(F.collect_list(F.struct(F.greatest(F.col("at") + F.col("lo"), F.lit(0)).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))).alias("spans"))
    local = scanned.select("id", "inner", "n_bytes")
    touched = local.join(hits, "id", "left").where("spans is not null or length(inner) > 0")
    touched = touched.withColumn("spans", F.transform("spans", lambda x: F.struct(x["lo"].alias("lo"), F.least(x["hi"], F.col("n_bytes")).alias("hi"))))
    touched = scratch.save(touched.drop("n_bytes"), "touched")
    changed = keep_ids(base, touched).join(touched, "id").mapInArrow(tidy(_strip), "id long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string, spans array<struct<lo:long,hi:long>>")
    return scanned.select("id", "n_bytes", "sha"), changed


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, changed = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), label="op4")
    changed = changed.select("id", "n_removed", "n_spans", "kept_sha256")
    return summary.join(changed, "id", "left").select(
        F.col("id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )
