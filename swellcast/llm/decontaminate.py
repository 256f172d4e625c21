"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of digits, ASCII letters (lower-cased) and everything outside ASCII. The items' words
build a generalised suffix automaton; every state that spells a window (``window`` consecutive item
words, or a whole shorter item) carries the items it comes from. Training words stream through the
automaton, which knows at each word the longest item passage that ends there; each window state on
its suffix path marks its words as hit and names its items. Only stretches whose adjacent word pairs
all occur in items are walked: outside them no window can match.

The items are cut into blocks of bounded size (long items into overlapping pieces, so no window is
lost), one automaton per block is built on the executors, and ``BLOCKS_AT_ONCE`` of them at a time
are broadcast, at most about 20 MB each. More blocks take further passes over the documents, with
the hits so far stored beside them.

Cleaning removes hit spans of more than ``max_span`` words and drops a document whose hit share
exceeds ``max_coverage``.

Defined results: null or empty texts have no words and no hits; items without words are ignored;
items of one id count once; a null item id marks words but is not reported; repeated rows are
treated one by one; an empty benchmark hits nothing; other columns are handed on or ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellcast.llm import common

WINDOW = 10
BLOCK_BYTES = 600_000
PIECE_WORDS = 20_000
BLOCKS_AT_ONCE = 4
#: ASCII upper case to lower case; other ASCII but digits and letters to a space; bytes above ASCII stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word-id sequences with the windows of their items."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        rows = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for item, ws in pieces if ws]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ids in rows:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        #: state -> {window length: items}
        self.windows: dict[int, dict[int, set[str]]] = {}
        for item, ids in rows:
            size = min(window, len(ids))
            state, held = 0, 0
            for c in ids:
                state, held = self.next[state][c], held + 1
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                held = min(held, size)
                if held == size:
                    own = self.windows.setdefault(state, {}).setdefault(size, set())
                    if item is not None:
                        own.add(item)
        self.shortest = min((k for own in self.windows.values() for k in own), default=0)
        #: nearest state up the suffix path, itself included, that spells a window
        self.up = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.up[s] = s if s in self.windows else self.up[self.link[s]]
        pairs = {(a, b) for _, ids in rows for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(a * len(self.vocabulary) + b for a, b in pairs) + [2**62], np.int64)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def stretches(self, ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """[begin, end) word ranges inside one document that could hold a window."""
        if not self.shortest or not len(ids):
            return []
        if self.shortest == 1:
            good, reach = ids >= 0, 0
        else:
            both = (ids[1:] >= 0) & (ids[:-1] >= 0) & (doc[1:] == doc[:-1])
            at = np.flatnonzero(both)
            key = ids[at] * len(self.vocabulary) + ids[at + 1]
            good = np.zeros(len(both), bool)
            good[at] = self.pairs[np.searchsorted(self.pairs, key)] == key
            reach = 1
        edge = np.diff(np.r_[0, good.astype(np.int8), 0])
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + reach
        long = end - begin >= self.shortest
        return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))

    def walk(self, ids: list[int], base: int, doc: list[int], hit: np.ndarray, items: list[set[str]]) -> None:
        """Stream one stretch; ``hit`` and ``items`` take what its windows mark."""
        state = matched = 0
        own_doc = -1
        for i, c in enumerate(ids):
            if doc[i] != own_doc:
                state, matched, own_doc = 0, 0, doc[i]
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(c, 0)
            matched = matched + 1 if state else 0
            spot = self.up[state]
            while spot:
                for size, own in self.windows[spot].items():
                    if size <= matched:
                        hit[base + i + 1 - size : base + i + 1] = True
                        items[own_doc] |= own
                spot = self.up[self.link[spot]]


def _pieces(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.slices(batches):
            ids, rows = batch.column("item_id").to_pylist(), []
            for item, text in zip(ids, texts, strict=True):
                words = words_of(text)
                step = PIECE_WORDS - window + 1
                stops = range(0, max(1, len(words) - window + 1), step) if len(words) > PIECE_WORDS else (0,)
                rows += [(item, b" ".join(words[s : s + PIECE_WORDS])) for s in stops if words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())],
                ["item_id", "words"])

    return run


def automata(benchmark: DataFrame, window: int) -> DataFrame:
    """Stored (_block, automaton): one pickled automaton per block of items. Their number follows the benchmark's size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), common.whole_text().alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    pieces = items.mapInArrow(_pieces(window), "item_id string, words binary").withColumn(
        "_block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(None if pd.isna(i) else i, bytes(w).split()) for i, w in zip(frame.item_id, frame.words, strict=True)]
        return pd.DataFrame({"_block": frame["_block"][:1], "automaton": [pickle.dumps(Automaton(rows, window))]})

    return common.stored(pieces.groupBy("_block").applyInPandas(build, "_block long, automaton binary"), "automata")


def fetched(built: DataFrame, blocks: list[int]) -> list[bytes]:
    """The automata of the blocks of one pass."""
    return [bytes(r.automaton) for r in built.where(F.col("_block").isin(blocks)).orderBy("_block").toLocalIterator()]


@functools.lru_cache(maxsize=BLOCKS_AT_ONCE)
def _opened(key: tuple, broadcast) -> Automaton:
    return pickle.loads(broadcast.value)


class _Found:
    """Hits of one slice of documents."""

    def __init__(self, texts: list[str]):
        per_doc = [words_of(t) for t in texts]
        self.counts = np.fromiter(map(len, per_doc), np.int64, len(texts))
        self.words = [w for ws in per_doc for w in ws]
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.hit = np.zeros(len(self.words), bool)
        self.items: list[set[str]] = [set() for _ in texts]

    def search(self, automaton: Automaton) -> None:
        get = automaton.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in self.words), np.int64, len(self.words))
        for a, b in automaton.stretches(ids, self.doc):
            automaton.walk(ids[a:b].tolist(), a, self.doc[a:b].tolist(), self.hit, self.items)

    def per_doc(self) -> list[np.ndarray]:
        return np.split(self.hit, np.cumsum(self.counts)[:-1]) if len(self.counts) else []


Finish = Callable[[pa.RecordBatch, list[str], _Found], pa.RecordBatch]


def scan(docs: DataFrame, benchmark: DataFrame, finish: Finish, schema: str, window: int = WINDOW) -> DataFrame:
    """Search every document for every block; ``finish`` makes the output from the complete hits."""
    built = automata(benchmark, window)
    hits, owners = common.fresh(docs.columns, "_hits"), common.fresh(docs.columns, "_owners")
    blocks = sorted(r["_block"] for r in built.select("_block").toLocalIterator())
    context = docs.sparkSession.sparkContext
    for begin in range(0, max(len(blocks), 1), BLOCKS_AT_ONCE):
        own = blocks[begin : begin + BLOCKS_AT_ONCE]
        shared = [context.broadcast(b) for b in (fetched(built, own) if own else [pickle.dumps(Automaton([], window))])]
        last = begin + BLOCKS_AT_ONCE >= len(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, begin=begin, last=last) -> Iterator[pa.RecordBatch]:
            for batch, texts in common.slices(batches):
                found = _Found(texts)
                if begin:
                    packed = batch.column(hits).to_pylist()
                    found.hit = np.concatenate([np.zeros(0, bool), *(
                        np.unpackbits(np.frombuffer(p, np.uint8), count=int(n)).astype(bool)
                        for p, n in zip(packed, found.counts, strict=True))])
                    found.items = [set(x) for x in batch.column(owners).to_pylist()]
                    batch = batch.drop_columns([hits, owners])
                for broadcast in shared:
                    found.search(_opened((broadcast.id if hasattr(broadcast, "id") else id(broadcast),), broadcast))
                if last:
                    yield finish(batch, texts, found)
                    continue
                batch = batch.append_column(hits, pa.array([np.packbits(h).tobytes() for h in found.per_doc()], pa.binary()))
                yield batch.append_column(owners, pa.array([sorted(x) for x in found.items], pa.list_(pa.string())))

        if last:
            return docs.mapInArrow(run, schema)
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in (hits, owners))
        docs = common.stored(docs.mapInArrow(run, f"{kept}, `{hits}` binary, `{owners}` array<string>"), "hits")
        for broadcast in shared:
            broadcast.unpersist()
    raise AssertionError("unreachable")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def finish(batch: pa.RecordBatch, texts: list[str], found: _Found) -> pa.RecordBatch:
        hits = np.array([h.sum() for h in found.per_doc()], np.int64)
        digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found.items]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found.counts), pa.array(hits), pa.array([len(x) for x in found.items], pa.int64()),
             pa.array(digests, pa.string()), pa.array(hits > 0)],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return scan(common.id_text(docs), benchmark, finish, "doc_id long, n_words long, n_hit long, n_items long, "
                "items_sha256 string, contaminated boolean", window)


def cut(text: str, hit: np.ndarray, max_span: int) -> str:
    """The text without hit spans of more than ``max_span`` words."""
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    spans = [(a, b) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a > max_span]
    if not spans:
        return text
    places, parts, at = [m.span() for m in _WORD.finditer(text)], [], 0
    for a, b in spans:
        parts.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*parts, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without the contaminated spans, and without documents that are mostly such spans; n_chars follows."""
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def finish(batch: pa.RecordBatch, texts: list[str], found: _Found) -> pa.RecordBatch:
        new, keep = list(batch.column("text").to_pylist()), []
        for i, hit in enumerate(found.per_doc()):
            share = hit.mean() if len(hit) else 0.0
            keep.append(bool(share <= max_coverage))
            if share:
                new[i] = cut(texts[i], hit, max_span)
        arrays = [pa.array(new, pa.string()) if c == "text" else
                  pa.array([None if t is None else len(t) for t in new], batch.column(c).type) if c == "n_chars" else
                  batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(keep, pa.bool_()))

    return scan(docs, benchmark, finish, schema, window)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
