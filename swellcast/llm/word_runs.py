"""Runs of repeated words in documents, found in a Re-Pair grammar of their word ids.

All documents of a slice share one grammar. In each round the pairs of neighbouring symbols are
counted; a pair that outranks (by count) both pairs it overlaps is replaced by a nonterminal, all its
places at once, leftmost first where it overlaps itself, as long as two places are left. Rounds end
when no pair is replaced any more. What remains of a document is joined in a balanced tree, so every
stretch of words lies across the inner boundary of exactly one node that holds it whole.

A nonterminal is looked at once, at its first place: for each period up to a quarter of its length the
words next to the boundary, then hashes of the blocks beside it, tell whether a run can cross; the run's
ends follow from common-extension searches over prefix hashes. Runs found are carried to all places
that derive from the nonterminal, extended there to their full length, and equal intervals are merged
with their smallest period. Every run is verified word by word; should a hash ever have lied, the
document is searched again without hashes.

A run is a stretch with smallest period q and at least max(MIN_LENGTH, POWER * q) words that no
neighbouring word extends.

Defined results: words are split at the six ASCII white-space characters; null, empty and blank texts
have no words and no runs; repeated rows are treated one by one; a null id counts as the empty id text;
an empty table gives an empty result; other columns are ignored. Texts are processed whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from swellcast.llm import common

POWER = 4
MIN_LENGTH = 6
#: Boundary and period pairs looked at in one go, which bounds the memory of long documents.
AT_ONCE = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)


# -- grammar ------------------------------------------------------------------------------------------
class Grammar:
    """Nodes over flat word ids: boundaries to look at, and all places of the nonterminals.

    ``low``, ``mid``, ``high``: the first place of each node and its inner boundary, as word numbers.
    ``places``: where node i occurs, ``places[first[i] : first[i + 1]]``; tree nodes occur once.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        symbol, start = words.astype(np.int64), np.arange(len(words), dtype=np.int64)
        stop, fresh = start + 1, np.ones(len(words), bool)
        own, low, mid, high, where = [], [], [], [], []
        made, top = 0, int(words.max()) + 1 if len(words) else 0
        while len(symbol) > 1:
            chosen, rule = self._round(symbol, doc[start], fresh, top + made)
            if not len(chosen):
                break
            kinds, first, rule = np.unique(rule, return_index=True, return_inverse=True)
            own.append(made + rule)
            where.append(start[chosen])
            low.append(start[chosen[first]])
            mid.append(stop[chosen[first]])
            high.append(stop[chosen[first] + 1])
            symbol[chosen], stop[chosen] = top + made + rule, stop[chosen + 1]
            made += len(kinds)
            # A pair can only become frequent anew where a symbol is new.
            fresh[:] = False
            fresh[chosen] = True
            stay = np.ones(len(symbol), bool)
            stay[chosen + 1] = False
            symbol, start, stop, fresh = symbol[stay], start[stay], stop[stay], fresh[stay] | self._open[stay]
        while len(start) > 1:
            same = doc[start[1:]] == doc[start[:-1]]
            head = np.r_[0, np.flatnonzero(~same) + 1]
            rank = np.arange(len(start)) - np.repeat(head, np.diff(np.r_[head, len(start)]))
            left = np.flatnonzero((rank[:-1] % 2 == 0) & same)
            if not len(left):
                break
            own.append(made + np.arange(len(left)))
            where.append(start[left])
            low.append(start[left])
            mid.append(stop[left])
            high.append(stop[left + 1])
            made += len(left)
            stop[left] = stop[left + 1]
            stay = np.ones(len(start), bool)
            stay[left + 1] = False
            start, stop = start[stay], stop[stay]
        empty = [np.zeros(0, np.int64)]
        self.low, self.mid, self.high = (np.concatenate(x or empty) for x in (low, mid, high))
        own, where = np.concatenate(own or empty), np.concatenate(where or empty)
        self.places = where[np.argsort(own, kind="stable")]
        self.first = np.r_[0, np.cumsum(np.bincount(own, minlength=made))]

    def _round(self, symbol: np.ndarray, doc: np.ndarray, fresh: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places to replace and their pair numbers; ``_open`` marks symbols whose pairs may still repeat."""
        self._open = np.zeros(len(symbol), bool)
        at = np.flatnonzero((doc[1:] == doc[:-1]) & (fresh[1:] | fresh[:-1]))
        key, pair = np.unique(symbol[at] * top + symbol[at + 1], return_inverse=True)
        often = np.bincount(pair, minlength=len(key))
        keep = often[pair] > 1
        at, pair = at[keep], pair[keep]
        if not len(at):
            return at, pair
        rank = np.empty(len(key), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(key))
        best = np.full(len(symbol) + 1, len(key), np.int64)  # by place; shifted by one
        best[at + 1] = rank[pair]
        mine, before, after = best[at + 1], best[at], best[at + 2] if len(symbol) > 1 else best[at]
        win = (mine <= before) & (mine <= after)
        at_w, pair_w = at[win], pair[win]
        if len(at_w):
            # Of a chain of overlapping places of one pair (equal words) every second one, from the left.
            head = np.r_[True, (np.diff(at_w) != 1) | (np.diff(pair_w) != 0)]
            begin = np.maximum.accumulate(np.where(head, np.arange(len(at_w)), 0))
            odd = (np.arange(len(at_w)) - begin) % 2 == 0
            at_w, pair_w = at_w[odd], pair_w[odd]
            enough = np.bincount(pair_w, minlength=len(key))[pair_w] > 1
            at_w, pair_w = at_w[enough], pair_w[enough]
        if len(at_w):
            self._open[at] = True
            self._open[at + 1] = True
        return at_w, pair_w


# -- equal stretches -----------------------------------------------------------------------------------
class Stretches:
    """Equality of stretches by prefix hashes, and how far two stretches agree within a document."""

    def __init__(self, words: np.ndarray):
        value = common.mix64(words.astype(np.uint64) + np.uint64(1))
        with np.errstate(over="ignore"):
            power = np.full(len(words) + 1, _BASE, np.uint64)
            power[0] = 1
            self.power = np.multiply.accumulate(power)
            # H(i) = sum of value[j] * base^j for j < i: equal stretches agree after a shift of the base.
            self.sums = np.r_[np.uint64(0), np.cumsum(value * self.power[:-1], dtype=np.uint64)]

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from a and from b > a agree."""
        with np.errstate(over="ignore"):
            return (self.sums[a + n] - self.sums[a]) * self.power[b - a] == self.sums[b + n] - self.sums[b]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from a and from b on, at most ``most``."""
        good, bad = np.zeros(len(a), np.int64), most + 1
        while (bad - good > 1).any():
            half = (good + bad) // 2
            same = self.equal(a, b, half)
            good, bad = np.where(same, half, good), np.where(same, bad, half)
        return good

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree before a and before b, at most ``most``."""
        good, bad = np.zeros(len(a), np.int64), most + 1
        while (bad - good > 1).any():
            half = (good + bad) // 2
            same = self.equal(a - half, b - half, half)
            good, bad = np.where(same, half, good), np.where(same, bad, half)
        return good

    def grow(self, at: np.ndarray, period: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest stretch [start, end) within [low, high) with the period around a block that repeats at ``at``."""
        end = at + period + self.forward(at, at + period, high - at - period)
        return at - self.backward(at, at + period, at - low), end


def _crossing(words: np.ndarray, same: Stretches, low, mid, high) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of stretches across each boundary, cut at the node's ends, long enough for a run."""
    out = []
    # A run holds at least 2 periods on one side of the boundary, and 4 in all.
    right = np.minimum((high - mid) // 2, (high - low) // POWER)
    left = np.minimum((mid - low) // 2, (high - low) // POWER)
    for most, ahead in ((right, True), (left, False)):
        ends = np.cumsum(most)
        begin = 0
        while begin < len(most):
            base = ends[begin - 1] if begin else 0
            stop = max(int(np.searchsorted(ends, base + AT_ONCE, side="right")), begin + 1)
            size = most[begin:stop]
            node = np.repeat(np.arange(begin, stop), size)
            period = common.ranges(np.ones(len(size), np.int64), size)
            at = mid[node]
            near = words[at] == words[at + period] if ahead else words[at - 1] == words[at - 1 - period]
            node, period, at = node[near], period[near], at[near]
            at = at if ahead else at - 2 * period
            near = same.equal(at, at + period, period)
            node, period, at = node[near], period[near], at[near]
            s, e = same.grow(at, period, low[node], high[node])
            near = e - s >= np.maximum(MIN_LENGTH, POWER * period)
            out.append((node[near], s[near], e[near], period[near]))
            begin = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal intervals once, with their smallest period, by start, then period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.r_[True, (np.diff(start) != 0) | (np.diff(end) != 0)][: len(start)]
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def plain_runs(words: list[int] | np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of one document, period by period: exact, and quadratic in its length."""
    words = np.asarray(words)
    starts, ends, periods = [], [], []
    for q in range(1, len(words) // POWER + 1):
        edge = np.diff(np.r_[0, (words[q:] == words[:-q]).astype(np.int8), 0])
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
        long = e - s >= max(MIN_LENGTH, POWER * q)
        starts += s[long].tolist()
        ends += e[long].tolist()
        periods += [q] * int(long.sum())
    found = _smallest(*(np.array(x, np.int64) for x in (starts, ends, periods)))
    return list(zip(*(x.tolist() for x in found), strict=True))


def runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of documents laid end to end, ``counts`` words each."""
    doc = np.repeat(np.arange(len(counts)), counts)
    stops = np.cumsum(counts)
    grammar, same = Grammar(words, doc), Stretches(words)
    node, s, e, q = _crossing(words, same, grammar.low, grammar.mid, grammar.high)
    # To all places of the nonterminal, and there to the full length within the document.
    times = grammar.first[node + 1] - grammar.first[node]
    shift = grammar.places[common.ranges(grammar.first[node], times)] - np.repeat(grammar.low[node], times)
    s, q = np.repeat(s, times) + shift, np.repeat(q, times)
    s, e = same.grow(s, q, (stops - counts)[doc[s]], stops[doc[s]])
    s, e, q = _smallest(s, e, q)
    lied = np.zeros(len(counts), bool)
    for begin in range(0, len(s), 1 << 12):
        part = slice(begin, begin + (1 << 12))
        size = e[part] - s[part] - q[part]
        at = common.ranges(s[part], size)
        wrong = words[at] != words[at + np.repeat(q[part], size)]
        lied[doc[at[wrong]]] = True
    if lied.any():
        keep = ~lied[doc[s]]
        again = [(s[keep], e[keep], q[keep])]
        for d in np.flatnonzero(lied):
            base = stops[d] - counts[d]
            again.append(tuple(np.array(x, np.int64) for x in zip(
                *((a + base, b + base, p) for a, b, p in plain_runs(words[base : stops[d]])), strict=True)) or again[0])
        s, e, q = _smallest(*(np.concatenate(x) for x in zip(*again, strict=True)))
    return s, e, q


# -- documents -----------------------------------------------------------------------------------------
def words_of(text: str) -> list[bytes]:
    """Words between the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail, for the tenth of the documents that the id's checksum picks."""
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head, piece = words[:a], words[a : a + p]
    return head + (piece * -(-(n - a) // p))[: n - a]


def best_of(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run (start, length, period) with the greatest length / period; ties: smallest start, then period."""
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return best


def _found(altered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = defaultdict(count().__next__)
        for batch, texts in common.slices(batches):
            if len(number) > 1_000_000:
                number = defaultdict(count().__next__)
            ids = batch.column("doc_id").to_pylist()
            per_doc = [repeated_tail(i, words_of(t)) if altered else words_of(t) for i, t in zip(ids, texts, strict=True)]
            counts = np.fromiter(map(len, per_doc), np.int64, len(per_doc))
            flat = np.fromiter((number[w] for ws in per_doc for w in ws), np.int64, int(counts.sum()))
            _, flat = np.unique(flat, return_inverse=True)
            s, e, q = runs(flat, counts)
            base = np.cumsum(counts) - counts
            edges = np.searchsorted(s, np.r_[base, counts.sum()])
            rows = []
            for d, words in enumerate(per_doc):
                part = slice(edges[d], edges[d + 1])
                own = list(zip((s[part] - base[d]).tolist(), (e[part] - s[part]).tolist(), q[part].tolist(), strict=True))
                if own:
                    drop = np.zeros(len(words) + 1, np.int32)
                    np.add.at(drop, [a + p for a, _, p in own], 1)
                    np.add.at(drop, [a + length for a, length, _ in own], -1)
                    words = [w for w, gone in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not gone]
                best = best_of(own)
                rows.append((
                    ids[d], len(own), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in own).encode()).hexdigest(),
                    hashlib.sha256(b" ".join(words)).hexdigest(), [{"start": a, "length": b, "period": c} for a, b, c in own]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _TYPES.values(), strict=True)], list(_TYPES))

    return run


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_TYPES = {
    "doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(),
    "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": pa.list_(_RUN),
}
_SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>")


def word_runs(docs: DataFrame, altered: bool = False) -> DataFrame:
    """Per document its runs, the strongest one, and digests of the runs and of the collapsed text.

    ``altered`` gives a tenth of the documents the periodic tail of :func:`repeated_tail` first.
    """
    return common.id_text(docs).mapInArrow(_found(altered), _SCHEMA)


def op12_word_runs(spark, sf_dir: str) -> DataFrame:
    return word_runs(common.table(spark, sf_dir, "documents"), altered=True)
