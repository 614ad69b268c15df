"""Pairs, matches and frontier walks of one long unit or several short ones, over arrays.

Tokens become numbers, other ones in every unit. A block of fragments is met with all others
by counting over postings, pairs that a bound on the score leaves are compared together, and
only the fragments that the base radius doesn't settle are walked one by one. Memory follows
the unit and the block, and what is found is given back block by block."""

from __future__ import annotations

import difflib
import functools

import numpy as np
import pandas as pd

from echosieve.config import WEIGHTS, Settings

#: Cells and postings that a block of fragments may take, and pairs compared at a time.
CELLS, PAIRS = 1 << 21, 1 << 16


class Sets:
    """Distinct values of rows, and the rows of each value."""

    def __init__(self, row: np.ndarray, value: np.ndarray, n: int):
        self.values, value = np.unique(value, return_inverse=True)
        k = max(1, len(self.values))
        key = np.unique(row * k + value)
        self.n, self.row, self.value = n, key // k, key % k
        self.size = np.bincount(self.row, minlength=n)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.posting = self.row[np.argsort(self.value, kind="stable")]
        self.often = np.bincount(self.value, minlength=k)
        self.begin = np.concatenate([[0], np.cumsum(self.often)])

    def meet(self, lo: int, hi: int, keep: np.ndarray | None = None):
        """(cell, entry): for rows lo to hi, row by row and value by value, the cells
        (row - lo) * n + other of all rows that hold the value too."""
        entry = np.arange(self.at[lo], self.at[hi])
        if keep is not None:
            entry = entry[keep[self.value[entry]]]
        long = self.often[self.value[entry]]
        first = np.repeat(self.begin[self.value[entry]] - (np.cumsum(long) - long), long)
        other = self.posting[first + np.arange(len(first))]
        return np.repeat((self.row[entry] - lo) * self.n, long) + other, np.repeat(entry, long)

    def shared(self, lo: int, hi: int, keep: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.meet(lo, hi, keep)[0], minlength=(hi - lo) * self.n)


def lcs_lengths(flat: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of rows a and b, by bit-parallel rows over
    all pairs of like widths; the bits are those of the shorter row."""
    size = np.diff(at)
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    out = np.zeros(len(a), int)
    order = np.lexsort((size[b], np.searchsorted([8, 16, 32, 64], size[a])))
    for kind, width in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)):
        mine = order[(size[a[order]] <= width) & (size[a[order]] > (0 if width == 8 else width // 2))]
        for s in range(0, len(mine), PAIRS):
            p = mine[s : s + PAIRS]
            la, lb = size[a[p]], size[b[p]]
            place = np.arange(width)
            x = np.where(place < la[:, None], flat[np.minimum(at[a[p]][:, None] + place, len(flat) - 1)], -1)
            v = full = (~np.zeros(len(p), kind)) >> (width - la).astype(kind)
            for k in range(lb.max(initial=0)):
                far = np.searchsorted(lb, k, side="right")  # pairs ascend by lb
                y = flat[at[b[p[far:]]] + k]
                m = np.packbits(x[far:] == y[:, None], axis=1, bitorder="little").view(kind)[:, 0]
                w = v[far:]
                u = w & m
                v = np.concatenate([v[:far], (w + u) | (w - u)])
            out[p] = la - np.bitwise_count(v & full)
    for p in np.flatnonzero(size[a] > 64):
        x, y = flat[at[a[p]] : at[a[p] + 1]].tolist(), flat[at[b[p]] : at[b[p] + 1]].tolist()
        mask: dict = {}
        for k, t in enumerate(x):
            mask[t] = mask.get(t, 0) | 1 << k
        full = v = (1 << len(x)) - 1
        for t in y:
            u = v & mask.get(t, 0)
            v = ((v + u) | (v - u)) & full
        out[p] = len(x) - v.bit_count()
    return out


class Unit:
    """Rows (doc_id, unit, idx, para_index, tokens, often, whole, walks) of units, in the order
    of these, without the frontier where follow is false."""

    def __init__(self, pdf: pd.DataFrame, settings: Settings, follow: bool = True):
        self.settings, self.n, self.follow = settings, len(pdf), follow
        self.doc, self.idx, self.para, self.walks = pdf["doc_id"].to_numpy(), pdf["idx"].to_numpy(), pdf["para_index"].to_numpy().astype(int), pdf["walks"].to_numpy()
        new = (pdf["doc_id"].ne(pdf["doc_id"].shift()) | pdf["unit"].ne(pdf["unit"].shift())).to_numpy()
        self.unit = np.cumsum(new) - 1
        self.size = np.array([len(t) for t in pdf["tokens"]], int)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        word, words = pd.factorize(np.concatenate([np.asarray(t, object) for t in pdf["tokens"]]))
        row, w = np.repeat(np.arange(self.n), self.size), max(1, len(words))
        keys, self.flat = np.unique(self.unit[row] * w + word, return_inverse=True)
        v = len(keys)
        self.row, self.v = row, v
        self.one = Sets(row, self.flat, self.n)
        whole = pdf["whole"].to_numpy().astype(bool)[new]
        self.rare = ~whole[keys // w] | (self.one.often[:v] <= settings.max_candidates_per_token)
        place = {t: k for k, t in enumerate(words)}
        for u, often in zip(self.unit.tolist(), pdf["often"]):
            if often is not None and len(often):
                self.rare[np.searchsorted(keys, [u * w + place[t] for t in often])] = False
        self.i, self.you = [np.bincount(row[word == place.get(t, -1)], minlength=self.n) > 0 for t in ("i", "you")]
        self.lists = None
        if follow or settings.dialect != "web":
            flat = self.flat.tolist()
            self.lists = [flat[a:b] for a, b in zip(self.at.tolist(), self.at[1:].tolist())]
        self.begin, self.is_rare = self.one.begin.tolist(), self.rare.tolist()

    @functools.cached_property
    def two(self) -> Sets:
        at = np.flatnonzero(self.row[:-1] == self.row[1:])
        return Sets(self.row[at], self.flat[at] * self.v + self.flat[at + 1], self.n)

    @functools.cached_property
    def three(self) -> Sets:
        at = np.flatnonzero(self.row[:-2] == self.row[2:])
        number = np.searchsorted(self.two.values, self.flat[at] * self.v + self.flat[at + 1])
        return Sets(self.row[at], number * self.v + self.flat[at + 2], self.n)

    def blocks(self):
        """Ranges of rows whose cells and postings stay within CELLS, one row at least."""
        cost = np.bincount(self.one.row, self.one.often[self.one.value], self.n) + self.n
        lo = 0
        while lo < self.n:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(cost[lo : lo + CELLS]), CELLS)))
            if self.walks[lo:hi].any():
                yield lo, min(hi, self.n)
            lo = hi

    def candidates(self, lo: int, hi: int) -> dict[str, np.ndarray]:
        """The pairs of rows lo to hi with rows in reach that may have the least score; in the
        web dialect they are scored too."""
        s = self.settings
        raw, seq, bi, tri, near = WEIGHTS[s.dialect]
        c, two, most, at_hand = self.met(lo, hi)
        i, j, shared = c["i"], c["j"], c["shared"]
        bound = raw * c["overlap"] + bi * c["bigram"] + tri * c["trigram"] + near * c["size"] + seq * 2 * most / c["both"]
        ok = ((shared >= s.min_shared) | (two > 0)) & (bound >= s.min_match_score - 1e-9)
        c["base"] = at_hand & (c["distance"] <= s.paragraph_radius * min(1, s.growth))
        c = {k: x[ok] for k, x in c.items()}
        if s.dialect == "web":
            return self.scored(c, 2 * lcs_lengths(self.flat, self.at, c["i"], c["j"]) / c["both"])
        return c | {"score": np.full(len(c["i"]), np.nan), "weighted": np.zeros(len(c["i"]))}

    def near(self, lo: int, hi: int, upward: bool = False):
        """(i, j, distance, shared, at_hand) of the pairs of rows lo to hi with rows in reach, of
        those with i < j if upward; at_hand where they share a token that is not too common.
        Without the frontier only such pairs are given."""
        s, n = self.settings, self.n
        shared = self.one.shared(lo, hi)
        rare = shared if self.rare.all() else self.one.shared(lo, hi, self.rare)
        cell = np.flatnonzero(rare) if not self.follow else np.flatnonzero(shared) if s.min_shared > 0 else np.arange((hi - lo) * n)
        i, j = cell // n + lo, cell % n
        distance = np.abs(self.para[i] - self.para[j])
        ok = self.walks[i] & (i < j if upward else i != j) & (distance <= s.paragraph_radius * max(1, s.growth)) & (self.unit[i] == self.unit[j])
        cell = cell[ok]
        return cell, i[ok], j[ok], distance[ok], shared[cell], rare[cell] > 0

    def met(self, lo: int, hi: int, upward: bool = False):
        """near() with the parts of the score but for sequences; also the shared bigrams, the
        most that can be common in order, and at_hand."""
        cell, i, j, distance, shared, at_hand = self.near(lo, hi, upward)
        jac = lambda both, sets: both / np.maximum(sets.size[i] + sets.size[j] - both, 1)
        two = self.two.shared(lo, hi)[cell]
        overlap, bigram, trigram = jac(shared, self.one), jac(two, self.two), jac(self.three.shared(lo, hi)[cell], self.three)
        size = 1 - np.abs(self.size[i] - self.size[j]) / np.maximum(self.size[i], self.size[j])
        # what is common in order is at most the shared tokens with their repeats
        most = np.minimum(np.minimum(shared + self.size[i] - self.one.size[i], shared + self.size[j] - self.one.size[j]), np.minimum(self.size[i], self.size[j])) * (shared > 0)
        swap = (self.i[i] & self.you[j] | self.you[i] & self.i[j]) & (overlap >= 0.35)
        return dict(i=i, j=j, distance=distance, shared=shared, swap=swap, overlap=overlap, bigram=bigram, trigram=trigram, size=size, both=self.size[i] + self.size[j]), two, most, at_hand

    def scored(self, c: dict, ratio: np.ndarray) -> dict:
        raw, seq, bi, tri, near = WEIGHTS[self.settings.dialect]
        score = raw * c["overlap"] + seq * ratio + bi * c["bigram"] + tri * c["trigram"] + near * c["size"]
        return c | {"score": score, "weighted": np.maximum(0.0, score - np.where(c["swap"], 0.12, 0.0)) / (1 + c["distance"])}

    def compare(self, c: dict, which: np.ndarray) -> None:
        """In the cli dialect, whose ratio takes long, the pairs that a walk has come to."""
        if self.settings.dialect == "web":
            return
        which = which[np.isnan(c["score"][which])]
        done = self.scored({k: x[which] for k, x in c.items()}, self.matcher_ratios(c["i"][which], c["j"][which]))
        c["score"][which], c["weighted"][which] = done["score"], done["weighted"]

    def matcher_ratios(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.array([difflib.SequenceMatcher(None, self.lists[a], self.lists[b], autojunk=False).ratio() for a, b in zip(i, j)], float)

    def walk(self, c: dict) -> np.ndarray:
        """Which of candidates c the walks of their rows find."""
        least = self.settings.min_match_score
        reached = c["base"].copy()
        self.compare(c, np.flatnonzero(reached))
        found = reached & (c["score"] >= least)
        left = ~reached & ~(c["score"] < least)  # nan: not compared yet
        rows, first = np.unique(c["i"], return_index=True)
        ends = np.append(first[1:], len(c["i"]))
        open_ = np.logical_or.reduceat(left, first) & np.logical_or.reduceat(found, first) if len(rows) else []
        for k in np.flatnonzero(open_):
            self._follow(int(rows[k]), c, slice(first[k], ends[k]), reached, found)
        return found

    def _follow(self, i: int, c: dict, own: slice, reached: np.ndarray, found: np.ndarray) -> None:
        """The rounds of one row beyond its base radius, until nothing is new or all is met."""
        s, least = self.settings, self.settings.min_match_score
        # views: what is written here is written for the block
        others, distance, score, weighted, came, got = [x[own] for x in (c["j"], c["distance"], c["score"], c["weighted"], reached, found)]
        away = np.abs(self.para - self.para[i])
        frontier = set(self.lists[i])
        order = None
        boost = 1
        while not (came | (score < least)).all():  # nan: not compared yet
            if order is None or s.dialect != "web":
                order = np.lexsort((others, distance, -weighted))
            ranked = others[order[got[order]][: 4 * boost]]
            bridge: dict = {}
            for j in ranked.tolist():
                for t in self.lists[j]:
                    if t not in frontier:
                        bridge[t] = None
                if len(bridge) >= 4 * boost:
                    break
            if not bridge:
                return
            met = np.zeros(self.n, bool)
            for t in bridge:
                if self.is_rare[t]:
                    met[self.one.posting[self.begin[t] : self.begin[t + 1]]] = True
            met &= away <= s.paragraph_radius * min(boost, s.growth)
            met[i] = False
            met[others[got]] = False
            if not met.any():
                return
            frontier.update(bridge)
            boost *= 2
            new = np.flatnonzero(met[others] & ~came)
            self.compare(c, own.start + new)
            came[new] = True
            got[new] = score[new] >= least

    def found(self):
        """Blocks (lo, hi, matches) of the walks that find any."""
        for lo, hi in self.blocks():
            c = self.candidates(lo, hi)
            keep = self.walk(c)
            if keep.any():
                yield lo, hi, {k: c[k][keep] for k in ("i", "j", "distance", "shared", "score", "weighted")}


def pairs(pdf: pd.DataFrame, settings: Settings):
    """(doc_id, a, b, distance), a < b, of the pairs that meet within the base radius."""
    unit = Unit(pdf, settings, follow=False)
    for lo, hi in unit.blocks():
        _, i, j, distance, _, _ = unit.near(lo, hi, upward=True)
        if len(i):
            yield pd.DataFrame({"doc_id": unit.doc[i], "a": unit.idx[i], "b": unit.idx[j], "distance": distance})


def pair_scores(pdf: pd.DataFrame, settings: Settings):
    """pairs() with all parts of their score."""
    unit = Unit(pdf, settings, follow=False)
    for lo, hi in unit.blocks():
        c, *_ = unit.met(lo, hi, upward=True)
        if not len(c["i"]):
            continue
        seq = 2 * lcs_lengths(unit.flat, unit.at, c["i"], c["j"]) / c["both"] if settings.dialect == "web" else unit.matcher_ratios(c["i"], c["j"])
        c = unit.scored(c, seq)
        yield pd.DataFrame({"doc_id": unit.doc[c["i"]], "a": unit.idx[c["i"]], "b": unit.idx[c["j"]], "seq": seq, "exchange": c["swap"], **{k: c[k] for k in ("distance", "overlap", "bigram", "trigram", "size", "shared", "score")}})


def match_rows(pdf: pd.DataFrame, settings: Settings, follow: bool = True, common: bool = True):
    """The matches of the rows of units, with the tokens both have if common."""
    unit = Unit(pdf, settings, follow)
    sets = [set(t) for t in pdf["tokens"]] if common else []
    for _, _, c in unit.found():
        out = {"doc_id": unit.doc[c["i"]], "idx": unit.idx[c["i"]], "other": unit.idx[c["j"]], **{k: c[k] for k in ("distance", "shared", "score", "weighted")}}
        if common:
            out["common"] = [list(sets[a] & sets[b]) for a, b in zip(c["i"].tolist(), c["j"].tolist())]
        yield pd.DataFrame(out)


def match_sums(pdf: pd.DataFrame, settings: Settings, follow: bool = True) -> pd.DataFrame:
    """What the matches of the rows of units come to, a row for each fragment that has any."""
    unit = Unit(pdf, settings, follow)
    capital = pdf["starts_capitalized"].to_numpy().astype(bool)
    parts = []
    for lo, hi, c in unit.found():
        r, m = c["i"] - lo, hi - lo
        count = np.bincount(r, minlength=m)
        density = np.bincount(r, c["weighted"], m)
        # the tokens of a row that one of its matches holds
        mark = np.zeros((hi - lo) * unit.n, bool)
        mark[r * unit.n + c["j"]] = True
        cell, entry = unit.one.meet(lo, hi)
        hit = np.unique(entry[mark[cell]])
        reusable = np.bincount(unit.one.row[hit] - lo, minlength=m)
        first, first_capital = np.full(m, unit.n), np.full(m, unit.n)
        np.minimum.at(first, r, c["j"])
        np.minimum.at(first_capital, r[capital[c["j"]]], c["j"][capital[c["j"]]])
        k = np.flatnonzero(count)
        some = first_capital[k] < unit.n
        by_capital = pd.array(np.where(some, unit.idx[np.minimum(first_capital[k], unit.n - 1)], 0), "Int64")
        by_capital[~some] = pd.NA
        parts.append(pd.DataFrame({"doc_id": unit.doc[lo + k], "idx": unit.idx[lo + k], "match_count": count[k], "density": density[k], "reusable": reusable[k], "first": unit.idx[first[k]], "first_capital": by_capital}))
    columns = ["doc_id", "idx", "match_count", "density", "reusable", "first", "first_capital"]
    return pd.concat(parts) if parts else pd.DataFrame(columns=columns)
