"""Language-model scores by online logistic context mixing.

The corpus is cut into slices of about ``SLICE`` characters; a slice is stored as its distinct words
and every document's word numbers, compressed before they leave the task. Learned from the training documents are:

* exact counts of words and of sequences: a slice's hashes (64 bits of a word; 40 of the ``earlier`` words before a
  token and 16 of its own), sorted, each once, are cut into ranges that meet those of all slices in a shuffle, so counts
  and the statistics over them cover the whole corpus and a frequent word never gathers more of them than there are slices;
* the text model (:class:`Text`), over the running text: a word is first its symbol, which is the word
  itself for the ``TOP`` most frequent and else the class of its exact count (its bit length; never
  and once are one class, the rare words), in a prefix code of the symbols' exact counts. Every code
  bit is predicted by the exact counts of its place in the code and by hashed tables of three contexts
  of earlier words of the document: the previous, the two previous, the one before the previous. The
  four predictions meet in the logistic domain with weights chosen by how many contexts have been
  seen, and a table refines the mixture by place in the code and strength of the contexts. Tables
  count every training token. Weights and refinement come from every training token too, with its
  own count taken out of the tables: context predictions are rounded to ``LEVELS`` strengths, the
  bits of equal inputs are counted over all slices, and online steps run over these counts. So
  nothing depends on slices or their order;
* the spelling model (:class:`Mixer`) of rare words, from the vocabulary: every training word once,
  with its exact count, dealt to shards by word hash. A word is its bytes and a closing space in a
  prefix code built from the vocabulary's byte counts. For every code bit, ``len(ORDERS)`` contexts of
  earlier bytes are hashed with the place in the code into tables of counts, where each word counts
  once. Each context predicts the bit; the predictions meet in the logistic domain with weights from a
  set chosen by a gate (place in the word, and how much the middle context has seen), and an adaptive
  table refines the mixture by code place. Weights and table are learned online, bit batch by bit
  batch, from all training words weighted by their occurrences, all that a word put into its slots
  taken out first; every shard learns by itself and the results are averaged in a tree.

* the sequence model (:func:`sequence_logs`): a token may be the one that followed its ``earlier`` words elsewhere, with
  its exact share of what followed them. How far that is trusted, against the text model, is a logistic weighing of how
  often and by how many different tokens they were followed and of how many words in a row before had followed theirs,
  learned online from all training tokens, all that a token's document put into the counts taken out, and then refined by
  such cells. Shares are rounded down to ``GAIN_STEP`` of their logarithm over the text model's probability.

The text model's probability of a token is that of its symbol's bits, times, in a class, the word's share of the exact
counts of the class, or for a rare word its spelled probability; over all words they sum to at most
one (spellings of words that are not rare are lost). A text's score is the sum of log10 over its words
and one end; ``bits_per_byte`` puts the same total over its UTF-8 bytes. A training text's own sequences are among those
counted, as its words are; ``others_bits_per_byte`` takes them out, and only them, so it tells what the other documents
know of it.

Defined results: a null text is empty and is the end token alone, with a null bits_per_byte; without training
documents N is 0, the base score is 0 per token and all words are rare, under untrained models; a null
id belongs to the fold of the empty text; repeated rows are scored one by one.
"""

from __future__ import annotations

import contextlib
import heapq
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swellcast.llm import common

SLICE = 16_000_000
ORDERS = (1, 2, 3, 4, 5)
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
CHUNK = 1 << 14
#: Words of a stored part of the vocabulary, and words hashed, or spelled for a score, at once.
WORDS_AT_ONCE = 4_000
HASHED_AT_ONCE = 50_000
SPELLED_AT_ONCE = 1_000
#: Words of the vocabulary that one task learns the mixing weights from, before they are merged.
SHARD_WORDS = 100_000
MIX_BATCH = 400
GATES = 16
BUCKETS = 33
RATE = 0.02
#: Words with a symbol of their own; the other words' symbols are the bit lengths of their counts.
TOP = 31
SYMBOLS = TOP + 33
TEXT_BITS = 18
TEXT_CONTEXTS = 3
#: Strengths of a context's prediction; the last one is a context never seen.
LEVELS = 16
TOKENS_AT_ONCE = 50_000
EPOCHS = 8
#: Hashes of words or events that meet in one group.
HASHES_AT_ONCE = 2_000_000
#: Earlier words of a sequence; cells of its counts' bit lengths and of the words before that followed theirs.
EARLIER = 3
SIZES = 7
RUNS = 4
#: A sequence's share over the text model's probability, rounded down to steps of its natural logarithm; the first is none.
GAIN_STEP = 1 / 6
LEAST_GAIN = -36
GAINS = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


# -- slices ------------------------------------------------------------------------------------------
def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _whole(data: pa.BinaryScalar | bytes) -> bytes:
    buffer = pa.py_buffer(data) if isinstance(data, bytes) else data.as_buffer()
    return pa.decompress(buffer[8:], int.from_bytes(buffer[:8].to_pybytes(), "little"), "zstd", asbytes=True)


def _squeezed_numbers(numbers: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, which compress far better than whole numbers."""
    return _squeezed(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes())


def _whole_numbers(data: pa.BinaryScalar | bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_whole(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _squeezed_codes(codes: np.ndarray) -> bytes:
    return _squeezed_numbers(codes.astype("<u4", copy=False))


def _whole_codes(data: pa.BinaryScalar | bytes) -> np.ndarray:
    return _whole_numbers(data, "<u4")


def _slices(rows: DataFrame) -> DataFrame:
    """Stored slices: uid, ids, train, sizes, bytes, codes (0 is the end), words (spaced), counts (training), the
    last three squeezed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            ids, train, texts = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("doc_id", "train", "text"))
            parts.clear()
            held = 0
            split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            words, ends = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
            # White space at either side of a text leaves an empty word.
            there = pc.binary_length(words).to_numpy() > 0
            number = words.filter(pa.array(there)).dictionary_encode()
            sizes = np.diff(np.r_[0, np.cumsum(there)][ends])
            # Frequent words have small numbers, which compress better.
            number, words = number.indices.to_numpy(), number.dictionary
            often = np.argsort(-np.bincount(number, minlength=len(words)), kind="stable")
            place = np.empty(len(words), np.uint32)
            place[often] = np.arange(1, len(words) + 1)
            codes = np.zeros(len(number) + len(sizes), np.uint32)
            codes[np.arange(len(number)) + np.repeat(np.arange(len(sizes)), sizes)] = place[number]
            own = np.repeat(train.to_numpy(zero_copy_only=False), sizes + 1)
            counts = np.bincount(codes[own], minlength=len(words) + 1).astype("<u4")
            spaced = b" ".join(words.take(pa.array(often)).cast(pa.binary()).to_pylist())
            row = [[ids], [train], [sizes + 1], [pc.binary_length(texts)], [_squeezed_codes(codes)], [_squeezed(spaced)],
                   [_squeezed(counts.tobytes())]]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() if isinstance(x, pa.Array) else x
                                                         for x in v], k) for v, k in zip(row, kinds, strict=True)],
                                              ["ids", "train", "sizes", "bytes", "codes", "words", "counts"])

        for batch in common.cuts(batches):
            sizes = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy().astype(np.int64))
            start = 0
            while start < len(sizes):
                base = sizes[start - 1] if start else 0
                stop = min(int(np.searchsorted(sizes, base + SLICE - held)) + 1, len(sizes))
                parts.append(batch.slice(start, stop - start))
                held += int(sizes[stop - 1] - base)
                start = stop
                if held >= SLICE:
                    yield flush()
        if parts:
            yield flush()
        # The worker lives on for other stages; what this task's batches took goes back.
        pa.default_memory_pool().release_unused()

    schema = ("ids array<long>, train array<boolean>, sizes array<long>, bytes array<long>, codes binary, words binary, "
              "counts binary")
    made = rows.mapInArrow(run, schema)
    return common.stored(made.withColumn("uid", F.monotonically_increasing_id()), "slices")


def _keys(words: bytes) -> np.ndarray:
    """A 64-bit hash per spaced word, after the end token's."""
    char = np.frombuffer(words + b" ", np.uint8) if words else np.zeros(0, np.uint8)
    stop = np.flatnonzero(char == 32)
    begin = np.r_[0, stop[:-1] + 1] if len(stop) else stop
    keys = np.zeros(len(stop) + 1, np.uint64)
    # A block of words at a time: the letters take eight bytes each here.
    for a in range(0, len(stop), HASHED_AT_ONCE):
        first, last = begin[a : a + HASHED_AT_ONCE], stop[a : a + HASHED_AT_ONCE]
        own = char[first[0] : last[-1] + 1].astype(np.uint64)
        place = (np.arange(first[0], last[-1] + 1) - np.repeat(first, last - first + 1)).astype(np.uint64)
        with np.errstate(over="ignore"):
            spelled = common.mix64(own + np.uint64(1) + (place << np.uint64(9)))
            keys[a + 1 : a + 1 + len(first)] = common.mix64(np.add.reduceat(spelled, first - first[0]))
    return keys.view(np.int64)


def _events(codes: np.ndarray, keys: np.ndarray, earlier: int) -> np.ndarray:
    """Per token a hash of the ``earlier`` words of the document before it (40 bits) and of itself (16 bits); 0 for first words."""
    out, keys = np.empty(len(codes), np.uint64), keys.view(np.uint64)
    for a in range(0, len(codes), TOKENS_AT_ONCE):
        own = codes[a : a + TOKENS_AT_ONCE]
        line = np.concatenate([np.zeros(max(earlier - a, 0), codes.dtype), codes[max(a - earlier, 0) : a + len(own)]])
        before, context = np.ones(len(own), bool), np.zeros(len(own), np.uint64)
        with np.errstate(over="ignore"):
            for back in range(1, earlier + 1):
                # The end closes a document: behind it stands no word.
                last = np.where(before, line[earlier - back : earlier - back + len(own)], 0)
                before = last > 0
                if back == 1:
                    follows = before
                context = context * _STEP + np.where(before, keys[last], np.uint64(1))
        event = common.mix64(context) >> np.uint64(24) << np.uint64(24) | keys[own] >> np.uint64(48) << np.uint64(8)
        out[a : a + len(own)] = np.where(follows, event, np.uint64(0))
    return out


def _counted(slices: DataFrame, earlier: int) -> DataFrame:
    """(uid, kind, part, n, total, kinds): corpus counts of a slice's words (kind 0) and events (kind 1), by hash.

    A slice's hashes are sorted and cut into ranges, a squeezed row each, as all slices' rows of a range meet in one
    group of about HASHES_AT_ONCE; its answers stand in the order of the hashes. Of words, ``total`` marks each once.
    Of events, ``total`` and ``kinds`` count the tokens and the different tokens that followed the same earlier words.
    """
    tokens = slices.select(F.sum(F.expr("aggregate(sizes, 0L, (a, b) -> a + b)"))).first()[0] or 0
    ranges = max(1, -(-int(tokens) // HASHES_AT_ONCE))

    def parts(uid: int, kind: int, keys: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = ((keys >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
        for a, b in itertools.pairwise(cut):
            yield pa.RecordBatch.from_arrays(
                [pa.array([uid]), pa.array([kind], pa.int32()), pa.array([int(part[a])]), pa.array([_squeezed_numbers(np.diff(keys[a:b], prepend=np.uint64(0)))], pa.binary()),
                 pa.array([_squeezed_codes(own[a:b])], pa.binary())], ["uid", "kind", "part", "keys", "own"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, train, sizes, codes, words, counts in zip(*(batch.column(c) for c in names), strict=True):
                keys = _keys(_whole(words))
                order = np.argsort(keys.view(np.uint64), kind="stable")
                yield from parts(uid.as_py(), 0, keys.view(np.uint64)[order], np.frombuffer(_whole(counts), "<u4")[order])
                if earlier:
                    own = np.repeat(np.array(train.as_py()), np.array(sizes.as_py()))
                    events = _events(_whole_codes(codes), keys, earlier)
                    # Training tokens carry a mark below the hash.
                    marked = np.sort(events[events > 0] | own[events > 0])
                    events = marked >> np.uint64(1) << np.uint64(1)
                    first = _firsts(events)
                    yield from parts(uid.as_py(), 1, events[first], np.add.reduceat(marked & np.uint64(1), first) if len(first) else first)
        pa.default_memory_pool().release_unused()

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid")
        keys = [np.cumsum(_whole_numbers(k, "<u8"), dtype=np.uint64) for k in frame["keys"]]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        keys, own = np.concatenate(keys), np.concatenate([_whole_codes(n) for n in frame["own"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, new = keys[order], np.empty(len(order), bool)
        new[0], new[1:] = True, keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        n = np.add.reduceat(own[order], first)
        if frame["kind"].iloc[0]:
            context = keys[first] >> np.uint64(24)
            other = np.r_[True, context[1:] != context[:-1]]
            total, kinds = (np.add.reduceat(x, np.flatnonzero(other))[np.cumsum(other) - 1] for x in (n, (n > 0).astype(np.int64)))
            found = [n, total, kinds]
        else:
            found = [n]
        group, made = np.cumsum(new) - 1, frame[["uid", "kind", "part"]].assign(n=None, total=None, kinds=None)
        for name, values in zip(("n", "total", "kinds"), found, strict=False):
            back = np.empty(len(order), "<i8" if len(found) == 1 else "<u4")
            back[order] = np.minimum(values, np.iinfo(back.dtype).max)[group]
            made[name] = [_squeezed_numbers(x) for x in np.split(back, ends)]
        if len(found) == 1:
            # The first slice that holds a word marks it.
            back[order] = new
            made["total"] = [_squeezed_numbers(x) for x in np.split(back, ends)]
        return made

    names = ["uid", "train", "sizes", "codes", "words", "counts"]
    sent = slices.select(*names).mapInArrow(send, "uid long, kind int, part long, keys binary, own binary")
    return sent.groupBy("kind", "part").applyInPandas(meet, "uid long, kind int, part long, n binary, total binary, kinds binary")


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ones."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _sorted_events(codes: np.ndarray, keys: np.ndarray, earlier: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice's different events in order, the number of each token that has one, and which tokens have one."""
    events = _events(codes, keys, earlier)
    there = events > 0
    events = events[there]
    # Sorting the places along in the lowest bits is far quicker than sorting places; what these bits hid comes after.
    low = np.uint64(len(events).bit_length())
    order = (np.sort(events >> low << low | np.arange(len(events), dtype=np.uint64)) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    order = order[np.argsort(events[order], kind="stable")]
    events = events[order]
    first, at = _firsts(events), np.empty(len(order), np.int32)
    at[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(order)))
    return events[first], at, there


def _coded(slices: DataFrame, earlier: int) -> DataFrame:
    """Stored slices with the corpus count (n) and the mark (seen) of each of their words, and with the counts of their
    events (followed, total, kinds), squeezed too."""

    def attach(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("part")
        whole = lambda kind, name: np.concatenate([np.zeros(0, "<u4"), *(_whole_numbers(x, ("<i8", "<u4")[kind]) for x in right.loc[right["kind"] == kind, name])])
        order = np.argsort(_keys(_whole(left["words"].iloc[0])).view(np.uint64), kind="stable")
        n, seen = np.zeros(len(order), "<i8"), np.zeros(len(order), np.uint8)
        n[order], seen[order] = whole(0, "n"), whole(0, "total")
        squeezed = {"n": _squeezed(n.tobytes()), "seen": _squeezed(seen.tobytes())}
        squeezed |= {to: _squeezed_codes(whole(1, name)) for to, name in (("followed", "n"), ("total", "total"), ("kinds", "kinds"))}
        return left.assign(**{k: [v] for k, v in squeezed.items()})[names]

    names = ["ids", "train", "sizes", "bytes", "codes", "words", "n", "seen", "followed", "total", "kinds"]
    with _row_by_row(slices.sparkSession):
        both = slices.select("uid", *names[:6]).groupBy("uid").cogroup(_counted(slices, earlier).groupBy("uid"))
        return common.stored(both.applyInPandas(
            attach, "ids array<long>, train array<boolean>, sizes array<long>, bytes array<long>, codes binary, words binary, "
            "n binary, seen binary, followed binary, total binary, kinds binary"), "coded-slices")


def _common_words(coded: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Training tokens, distinct words, hashes of the words with a symbol of their own, and every symbol's exact count."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spaced, n, seen in zip(*(map(_whole, batch.column(c)) for c in ("words", "n", "seen")), strict=True):
                n = np.where(np.frombuffer(seen, np.uint8) > 0, np.frombuffer(n, "<i8"), 0)
                large = np.argsort(-n, kind="stable")[: TOP + 1]
                large = large[n[large] > 0]
                own = [b"", *(spaced.split(b" ") if spaced else [])]
                keys = [int(_keys(own[at])[1 if at else 0]) for at in large]
                size = np.frexp(n.astype(float))[1]
                sums, words = np.zeros(65, np.int64), np.bincount(size[n > 0], minlength=65)
                np.add.at(sums, size, n)
                sizes = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*keys, *[None] * len(sizes)], pa.int64()), pa.array([*[None] * len(keys), *sizes.tolist()], pa.int32()),
                     pa.array([*n[large].tolist(), *sums[sizes].tolist()], pa.int64()), pa.array([*[1] * len(keys), *words[sizes].tolist()], pa.int64())],
                    ["key", "size", "n", "words"])

    with _row_by_row(coded.sparkSession):
        found = common.stored(coded.select("words", "n", "seen").mapInArrow(look, "key long, size int, n long, words long"), "common-words")
    first = [(r.n, r.key) for r in found.where("key IS NOT NULL").orderBy(F.desc("n")).limit(TOP + 1).collect()]
    cut = max(1, first[TOP][0] if len(first) > TOP else 1)
    # At most TOP rows; equal counts at the cut stay in their class, so files decide nothing.
    top = sorted((-n, key) for n, key in first if n > cut)
    totals, tokens, distinct = np.zeros(SYMBOLS), 0, 0
    totals[: len(top)] = [-n for n, _ in top]
    for row in found.where("size IS NOT NULL").groupBy("size").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        tokens, distinct = tokens + row.n, distinct + row.words
        totals[TOP + min(row["size"], SYMBOLS - TOP - 1)] += row.n - sum(-n for n, _ in top if (-n).bit_length() == row["size"])
    return tokens, distinct, np.array([k for _, k in top], np.int64), totals


def _vocabulary(coded: DataFrame, distinct: int) -> DataFrame:
    """Stored (shard, part, words, n, letters): every training word of the corpus once, with its count.

    Shards and their order follow the word hashes alone, not slices or files. ``words`` are up to
    WORDS_AT_ONCE words, each closed by a space, and ``letters`` the counts of their bytes.
    """
    shards = max(1, -(-distinct // SHARD_WORDS))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n, seen in zip(*(map(_whole, batch.column(c)) for c in ("words", "n", "seen")), strict=True):
                own, keys, n = [b"", *(words.split(b" ") if words else [])], _keys(words), np.frombuffer(n, "<i8")
                at = np.flatnonzero((np.frombuffer(seen, np.uint8) > 0) & (n > 0))
                for a in range(0, len(at), 50_000):
                    part = at[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[part] % shards), pa.array(keys[part]), pa.array([own[i] for i in part], pa.binary()),
                         pa.array(n[part])], ["shard", "key", "word", "n"])

    named = coded.select("words", "n", "seen").mapInArrow(name, "shard long, key long, word binary, n long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, part = [], 0

        def flush() -> pa.RecordBatch:
            closed = b" ".join([*(w for _, w, _ in rows), b""])
            made = [[rows[0][0]], [part], [closed], [np.array([n for *_, n in rows], "<i8").tobytes()],
                    [np.bincount(np.frombuffer(closed, np.uint8), minlength=256).tolist()]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], ["shard", "part", "words", "n", "letters"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "word", "n")), strict=True):
                if rows and (rows[0][0] != row[0] or len(rows) >= WORDS_AT_ONCE):
                    yield flush()
                    part += 1
                rows.append(row)
        if rows:
            yield flush()

    dealt = named.repartition(common.partitions_for(coded.sparkSession), "shard").sortWithinPartitions("shard", "key")
    return common.stored(dealt.select("shard", "word", "n").mapInArrow(
        pack, "shard long, part long, words binary, n binary, letters array<long>"), "vocabulary")


# -- spelling model -----------------------------------------------------------------------------------
def prefix_code(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman code of 256 symbols: bits per symbol, then for all symbols in a row the tree node and bit of each step."""
    order = itertools.count()
    heap = [(float(w) + 1, next(order), s) for s, w in enumerate(weights)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        name = 256 + len(children)
        children[name] = (left, right)
        heapq.heappush(heap, (a + b, next(order), name))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    todo = [(heap[0][2], [])]
    while todo:
        node, path = todo.pop()
        if node < 256:
            paths[node] = path
        else:
            todo += [(child, [*path, (node - 256, bit)]) for bit, child in enumerate(children[node])]
    return (np.array([len(p) for p in paths]), np.array([n for p in paths for n, _ in p]), np.array([b for p in paths for _, b in p]))


class Spelling:
    """Bits, contexts and gates of words under one code."""

    def __init__(self, letters: np.ndarray):
        self.size, self.node, self.bit = prefix_code(letters)
        self.start = np.cumsum(self.size) - self.size

    def bits(self, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of spaced words, each closed by a space: slots (orders, bits), nodes, bits, place in word, word number."""
        char = np.frombuffer(words, np.uint8)
        stop = np.flatnonzero(char == 32)
        begin = np.r_[0, stop[:-1] + 1]
        length = stop - begin + 1
        place = np.arange(len(char)) - np.repeat(begin, length)
        word = np.repeat(np.arange(len(stop)), length)
        context = np.empty((len(ORDERS), len(char)), np.uint64)
        rolled = np.zeros(len(char), np.uint64)
        with np.errstate(over="ignore"):
            for back in range(1, max(ORDERS) + 1):
                # Bytes before the word's start are one fixed mark.
                earlier = np.where(place >= back, char[np.maximum(np.arange(len(char)) - back, 0)], 0).astype(np.uint64)
                rolled = common.mix64(rolled * _STEP + earlier + np.uint64(1))
                if back in ORDERS:
                    context[ORDERS.index(back)] = rolled
            times = self.size[char]
            step = common.ranges(self.start[char], times)
            node = self.node[step]
            owner = np.repeat(np.arange(len(char)), times)
            mixed = (context[:, owner] ^ (node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64), node, self.bit[step], place[owner], word[owner]


def _merged(parts: DataFrame, runs: int, size: int) -> np.ndarray:
    """The sum of partial tables (run, chunk, counts), ``runs`` of them; they meet 64 at a time, however many tasks there were."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for b in frame.counts:
            total += np.frombuffer(b, f"<u{len(b) // CHUNK}").astype(np.int64)
        return pd.DataFrame({"chunk": frame.chunk[:1], "run": frame.run[:1] // 64, "counts": [_packed(total)]})

    while True:
        parts = parts.groupBy("chunk", F.expr("run div 64").alias("_to")).applyInPandas(add, "chunk long, run long, counts binary")
        runs = -(-runs // 64)
        if runs <= 1:
            break
    out = np.zeros(-(-size // CHUNK) * CHUNK, np.int64)
    for row in parts.toLocalIterator():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, f"<u{len(row.counts) // CHUNK}")
    return out[:size]


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    top = int(counts.max())
    return counts.astype(f"<u{next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)}").tobytes()


def _chunks(held: np.ndarray) -> pa.RecordBatch:
    """The used chunks of this task's table."""
    parts = np.pad(held, (0, -len(held) % CHUNK)).reshape(-1, CHUNK)
    used = np.flatnonzero(parts.any(1))
    run = np.full(len(used), TaskContext.get().partitionId())
    return pa.RecordBatch.from_arrays(
        [pa.array(run), pa.array(used, pa.int64()), pa.array([_packed(parts[i]) for i in used], pa.binary())], ["run", "chunk", "counts"])


@contextlib.contextmanager
def _row_by_row(spark: SparkSession) -> Iterator[None]:
    """Rows are whole slices here: a file's reader and a worker hold one at a time."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    rows = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, "1")
    try:
        yield
    finally:
        for name, held in zip(names, rows, strict=True):
            spark.conf.set(name, held)


def _tables(vocabulary: DataFrame, letters: np.ndarray) -> np.ndarray:
    """Counts (orders, slots, bit) over all training words, each once; fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Spelling(letters), np.zeros((len(ORDERS), 2 * SLOTS), np.uint32)
        for batch in batches:
            for words in batch.column("words").to_pylist():
                slots, _, bit, _, _ = model.bits(words)
                for k in range(len(ORDERS)):
                    held[k] += np.bincount(slots[k] * 2 + bit, minlength=2 * SLOTS).astype(np.uint32)
        yield _chunks(held.reshape(-1))

    total = _merged(vocabulary.select("words").mapInArrow(count, "run long, chunk long, counts binary"),
                    max(1, vocabulary.rdd.getNumPartitions()), len(ORDERS) * 2 * SLOTS)
    return total.reshape(len(ORDERS), SLOTS, 2).astype(np.float32)


class Mixer:
    """Gated logistic mixing of the context predictions, and the adaptive refinement."""

    def __init__(self, letters: np.ndarray, tables: np.ndarray):
        self.spelling, self.tables = Spelling(letters), tables
        self.weights = np.full((GATES, len(ORDERS) + 1), 0.35)
        self.weights[:, -1] = 0
        grid = np.linspace(-8, 8, BUCKETS)
        self.refined = np.tile(1 / (1 + np.exp(-grid)), (256, 1))

    def inputs(self, words: bytes, leave_out: bool) -> tuple:
        slots, node, bit, place, word = self.spelling.bits(words)
        n = np.empty((2, len(ORDERS), len(bit)), np.float32)
        pairs = self.tables.view(np.uint64)[:, :, 0]
        for k in range(len(ORDERS)):
            n[:, k] = pairs[k, slots[k]].view(np.float32).reshape(-1, 2).T
        if leave_out:
            # All that the word itself put into each of its slots, under either bit.
            for k in range(len(ORDERS)):
                _, at, both = np.unique((word * SLOTS + slots[k]).astype(np.int32), return_inverse=True, return_counts=True)
                ones = np.bincount(at, bit)
                n[1, k] = np.maximum(n[1, k] - ones[at], 0)
                n[0, k] = np.maximum(n[0, k] - (both - ones)[at], 0)
        total = n[0] + n[1]
        stretch = np.log((n[1] + 0.4) / (n[0] + 0.4))
        middle = total[len(ORDERS) // 2]
        gate = np.minimum(place, 3) * 4 + (middle > 0) + (middle > 3) + (middle > 30)
        return np.concatenate([stretch, np.ones((1, len(bit)), np.float32)]), gate.astype(np.int64), node, bit, word

    def mix(self, stretch: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("kb,bk->b", stretch, self.weights[gate]), -12, 12)

    def _refine(self, dot: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = (np.clip(dot, -7.999, 7.999) + 8) * (BUCKETS - 1) / 16
        low = x.astype(np.int64)
        part = x - low
        return self.refined[node, low] * (1 - part) + self.refined[node, low + 1] * part, low, part

    def learn(self, words: bytes, times: np.ndarray) -> None:
        """One online step over the bits of a few words, each weighted by its occurrences."""
        stretch, gate, node, bit, word = self.inputs(words, leave_out=True)
        weight = (times / times.mean())[word]
        dot = self.mix(stretch, gate)
        error = (bit - 1 / (1 + np.exp(-dot))) * weight
        # sqrt of the effective number of bits, over their weight.
        total, square = np.bincount(gate, weight, GATES), np.bincount(gate, weight * weight, GATES)
        scale = RATE / np.sqrt(np.maximum(square, 1e-9))
        for k in range(len(stretch)):
            self.weights[:, k] += np.where(total > 0, np.bincount(gate, error * stretch[k], GATES) * scale, 0)
        _, low, part = self._refine(dot, node)
        at = node * BUCKETS + np.where(part > 0.5, low + 1, low)
        hits = np.bincount(at, weight, self.refined.size)
        ones = np.bincount(at, bit * weight, self.refined.size)
        flat = self.refined.reshape(-1)
        flat += (ones - hits * flat) / (hits + 400)

    def log10(self, words: bytes) -> np.ndarray:
        """Log10 probability of spelling each word."""
        stretch, gate, node, bit, word = self.inputs(words, leave_out=False)
        dot = self.mix(stretch, gate)
        p = 0.5 / (1 + np.exp(-dot)) + 0.5 * self._refine(dot, node)[0]
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.bincount(word, np.log10(np.where(bit == 1, p, 1 - p)))


def _mixer(vocabulary: DataFrame, letters: np.ndarray, tables: np.ndarray) -> bytes:
    """The mixer, pickled. Each shard learns from all of its words; the results are averaged, eight to one per round."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(pickle.dumps(Mixer(letters, tables)))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        mixer, bits = pickle.loads(shared.value), 0
        for row in frame.sort_values("part").itertuples():
            words, times = bytes(row.words).split(b" ")[:-1], np.frombuffer(row.n, "<i8").astype(float)
            for a in range(0, len(words), MIX_BATCH):
                mixer.learn(b" ".join([*words[a : a + MIX_BATCH], b""]), times[a : a + MIX_BATCH])
            bits += len(words)
        return pd.DataFrame({"shard": frame.shard[:1], "size": [bits], "learned": [pickle.dumps((mixer.weights, mixer.refined))]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shard")
        share, parts = frame["size"].to_numpy() / frame["size"].sum(), [pickle.loads(b) for b in frame.learned]
        mean = tuple(sum(w * p[i] for w, p in zip(share, parts, strict=True)) for i in (0, 1))
        return pd.DataFrame({"shard": frame.shard[:1] // 8, "size": [frame["size"].sum()], "learned": [pickle.dumps(mean)]})

    schema = "shard long, size long, learned binary"
    parts = vocabulary.select("shard", "part", "words", "n").groupBy("shard").applyInPandas(learn, schema)
    shards = 1 + (vocabulary.agg(F.max("shard")).first()[0] or 0)
    while shards > 1:
        parts = parts.groupBy(F.expr("shard div 8").alias("_to")).applyInPandas(merge, schema)
        shards = -(-shards // 8)
    found = parts.collect()
    mixer = pickle.loads(shared.value)
    if found:
        mixer.weights, mixer.refined = pickle.loads(bytes(found[0].learned))
    return pickle.dumps(mixer)


# -- text model --------------------------------------------------------------------------------------
class Text:
    """Symbols of words, the bits of their code, and mixed predictions from the words before."""

    def __init__(self, top: np.ndarray, totals: np.ndarray):
        """``top``: hashes of the words with an own symbol; ``totals``: exact count of each symbol's words."""
        self.top, self.order, self.totals = np.sort(top), np.argsort(top), totals
        self.size, self.node, self.bit = prefix_code(totals)
        self.start = np.cumsum(self.size) - self.size
        # What the exact counts say at each place of the code.
        owner = np.repeat(np.arange(len(self.size)), self.size)
        ones, zeros = (np.bincount(self.node, totals[owner] * (self.bit == b), SYMBOLS) for b in (1, 0))
        self.exact = np.log((ones + 0.4) / (zeros + 0.4))

    def symbols(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = TOP + np.clip(np.frexp(n.astype(float))[1], 1, SYMBOLS - TOP - 1)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, keys), len(self.top) - 1)
            out = np.where(self.top[at] == keys, self.order[at], out)
        return out

    def bits(self, codes: np.ndarray, keys: np.ndarray, n: np.ndarray, symbols: np.ndarray) -> Iterator[tuple]:
        """Of whole documents' word numbers, by parts: begin, slots (contexts, bits), nodes, bits, token of the part."""
        # Rare words are one word where they are context; the end closes a document, so nothing before it is seen.
        known = common.mix64(np.where(n > 1, keys, -1).view(np.uint64))
        for a in range(0, len(codes), TOKENS_AT_ONCE):
            line = np.concatenate([np.zeros(max(2 - a, 0), np.int64), codes[max(a - 2, 0) : a + TOKENS_AT_ONCE].astype(np.int64)])
            last, symbol = line[1:-1], symbols[line[2:]]
            previous, skipped = known[last], known[np.where(last == 0, 0, line[:-2])]
            times = self.size[symbol]
            owner = np.repeat(np.arange(len(symbol)), times)
            step = common.ranges(self.start[symbol], times)
            node = self.node[step]
            slots = np.empty((TEXT_CONTEXTS, len(node)), np.int64)
            with np.errstate(over="ignore"):
                place = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                for k, context in enumerate((previous, previous * _STEP + skipped, skipped)):
                    slots[k] = ((context[owner] ^ place) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - TEXT_BITS)
            yield a, slots, node, self.bit[step], owner

    def learn(self, seen: np.ndarray) -> None:
        """Weights, refinement and log10 probabilities from the counts (cells, bit) of bits by their inputs."""
        cell = np.arange(SYMBOLS * LEVELS**TEXT_CONTEXTS)
        level = np.stack([cell // LEVELS**k % LEVELS for k in range(TEXT_CONTEXTS)])
        inputs = np.concatenate([np.where(level == LEVELS - 1, 0, level - (LEVELS // 2 - 1)),
                                 self.exact[cell // LEVELS**TEXT_CONTEXTS][None], np.ones((1, len(cell)))])
        gate = (level < LEVELS - 1).sum(0)
        self.weights = np.zeros((TEXT_CONTEXTS + 1, len(inputs)))
        self.weights[:, :TEXT_CONTEXTS], self.weights[:, TEXT_CONTEXTS] = 0.2, 0.6
        self.weights[0, TEXT_CONTEXTS] = 1
        chance = lambda at: 1 / (1 + np.exp(-np.clip(np.einsum("kb,bk->b", inputs[:, at], self.weights[gate[at]]), -12, 12)))
        used = np.flatnonzero(seen.sum(1))
        used = used[np.argsort(common.mix64(used.astype(np.uint64)), kind="stable")]
        squares = np.full(self.weights.shape, 1e-9)
        for _ in range(EPOCHS):
            for a in range(0, len(used), 256):
                at = used[a : a + 256]
                error = seen[at, 1] - seen[at].sum(1) * chance(at)
                for g in range(len(self.weights)):
                    own = gate[at] == g
                    step = inputs[:, at[own]] @ error[own] / max(seen[at[own]].sum(), 1)
                    squares[g] += step * step
                    self.weights[g] += RATE * step / np.sqrt(squares[g])
        mixed = chance(cell)
        refined = np.clip((seen[:, 1] + 400 * mixed) / (seen.sum(1) + 400), 1e-6, 1 - 1e-6)
        self.logs = np.log10(np.stack([1 - refined, refined], 1)).reshape(-1)


def strengths(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The rounded logistic prediction of counts, from 0; LEVELS - 1 without any."""
    half = LEVELS // 2 - 1
    rounded = np.rint(np.clip(np.log((ones.astype(np.float32) + 0.4) / (zeros.astype(np.float32) + 0.4)), -half, half)) + half
    return np.where((zeros == 0) & (ones == 0), LEVELS - 1, rounded).astype(np.uint8)


def _cells(node: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    return node * LEVELS**TEXT_CONTEXTS + sum(level.astype(np.int64) * LEVELS**k for k, level in enumerate(levels))


def _text(coded: DataFrame, top: np.ndarray, totals: np.ndarray) -> tuple[Text, np.ndarray]:
    """The text model and the strengths (contexts, slots) of its tables."""
    spark = coded.sparkSession
    model = Text(top, totals)

    def over(update, size: int) -> np.ndarray:
        """``update(held, slots, node, bit)`` over the bits of all training documents, summed."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(size, np.int64)
            for batch in batches:
                for train, sizes, codes, spaced, n in zip(*(batch.column(c) for c in names), strict=True):
                    keys, n = _keys(_whole(spaced)), np.frombuffer(_whole(n), "<i8")
                    own = _whole_codes(codes)[np.repeat(np.array(train.as_py()), np.array(sizes.as_py()))]
                    for _, slots, node, bit, _ in model.bits(own, keys, n, model.symbols(keys, n)):
                        update(held, slots, node, bit)
            yield _chunks(held)
            pa.default_memory_pool().release_unused()

        names = ["train", "sizes", "codes", "words", "n"]
        dealt = coded.select(*names)
        with _row_by_row(spark):
            parts = common.stored(dealt.mapInArrow(run, "run long, chunk long, counts binary"), "text-tables")
        return _merged(parts, dealt.rdd.getNumPartitions(), size)

    wide = 2 << TEXT_BITS

    def count(held: np.ndarray, slots: np.ndarray, node: np.ndarray, bit: np.ndarray) -> None:
        for k in range(TEXT_CONTEXTS):
            held[k * wide : (k + 1) * wide] += np.bincount(slots[k] * 2 + bit, minlength=wide)

    tables = np.minimum(over(count, TEXT_CONTEXTS * wide), 2**32 - 1).astype(np.uint32).reshape(TEXT_CONTEXTS, -1, 2)
    # The strength that each bit meets in its slot, its own count taken out.
    left = np.stack([[strengths(t[:, 0] - ((t[:, 0] > 0) & (b == 0)), t[:, 1] - ((t[:, 1] > 0) & (b == 1))) for b in (0, 1)] for t in tables])
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(left.transpose(0, 2, 1)).reshape(TEXT_CONTEXTS, -1))

    def see(held: np.ndarray, slots: np.ndarray, node: np.ndarray, bit: np.ndarray) -> None:
        levels = [shared.value[k][slots[k] * 2 + bit] for k in range(TEXT_CONTEXTS)]
        held += np.bincount(_cells(node, levels) * 2 + bit, minlength=len(held))

    model.learn(over(see, SYMBOLS * LEVELS**TEXT_CONTEXTS * 2).reshape(-1, 2))
    return model, np.stack([strengths(t[:, 0], t[:, 1]) for t in tables])


# -- sequence model ------------------------------------------------------------------------------------
def _without_own(at: np.ndarray, doc: np.ndarray, train: np.ndarray, distinct: np.ndarray, counts: list[np.ndarray]) -> list[np.ndarray]:
    """Per token (event ``at`` of document ``doc``) its event's counts without what its own document put into them."""
    out = [c[at].astype(np.int64) for c in counts]
    # What nothing else follows is the document's own.
    alone = train[doc] & (out[1] == 1)
    for x in out:
        x[alone] = 0
    shared = np.flatnonzero(train[doc] & (out[1] > 1))
    if len(shared):
        pair, at, times = np.unique(doc[shared] * len(distinct) + at[shared], return_inverse=True, return_counts=True)
        doc, event = pair // len(distinct), pair % len(distinct)
        context, followed = distinct[event] >> np.uint64(24), counts[0][event].astype(np.int64)
        new = np.ones(len(pair), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (context[1:] != context[:-1])
        group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        own = times, np.add.reduceat(times, begin)[group], np.add.reduceat((followed == times).astype(np.int64), begin)[group]
        for x, y in zip(out, own, strict=True):
            x[shared] -= y[at]
    return out


def _gains(there: np.ndarray, logs: np.ndarray, followed: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Per token the number of its cell and of what the sequence's share makes of its probability; 0 without a sequence."""
    met = np.zeros(len(there), bool)
    met[there] = followed > 0
    run = np.zeros(len(there), np.int64)
    # Words before it, in a row, that had followed their sequence too; a first word never has.
    behind = np.ones(len(there), bool)
    for back in range(1, RUNS):
        behind[back:] &= met[:-back]
        behind[:back] = False
        run += behind
    used = total > 0
    at, followed, total, kinds = np.flatnonzero(there)[used], followed[used], total[used], kinds[used]
    level = lambda n: np.minimum(np.frexp(n.astype(float))[1], SIZES) - 1
    with np.errstate(divide="ignore"):
        gain = np.floor((np.log(followed / total) - logs[at] * np.log(10)) / GAIN_STEP) - LEAST_GAIN
    gain = np.where(gain < 0, 0, np.minimum(gain + 1, GAINS - 1)).astype(np.int64)
    out = np.zeros(len(there), "<u2")
    out[at] = GAINS + ((level(total) * SIZES + level(kinds)) * RUNS + run[at]) * GAINS + gain
    return out


def sequence_logs(seen: np.ndarray) -> np.ndarray:
    """Log10 of what a token's probability is multiplied by, per number of _gains, from the counts of these numbers.

    A sequence is trusted by a logistic weighing of its counts and of the run before, learned online over cells of
    equal inputs; each cell then adapts to what it has seen.
    """
    seen, cell = seen[GAINS:].reshape(-1, GAINS), np.arange(SIZES * SIZES * RUNS)
    ratio = np.r_[0, np.exp((np.arange(GAINS - 1) + LEAST_GAIN) * GAIN_STEP)]
    size = [cell // RUNS // SIZES, cell // RUNS % SIZES]
    inputs = np.stack([np.ones(len(cell)), *size, *(cell % RUNS >= r for r in range(1, RUNS))]).astype(float)
    weights, squares = np.zeros(len(inputs)), np.full(len(inputs), 1e-9)
    logistic = lambda at: 1 / (1 + np.exp(-np.clip(weights @ inputs[:, at], -9, 9)))
    taken = lambda trust: trust[:, None] * ratio / (1 - trust[:, None] + trust[:, None] * ratio)
    used = np.flatnonzero(seen.sum(1))
    used = used[np.argsort(common.mix64(used.astype(np.uint64)), kind="stable")]
    for _ in range(EPOCHS * 8):
        for a in range(0, len(used), 16):
            at = used[a : a + 16]
            trust = logistic(at)
            step = inputs[:, at] @ (seen[at] * (taken(trust) - trust[:, None])).sum(1) / seen[at].sum()
            squares += step * step
            weights += 5 * RATE * step / np.sqrt(squares)
    trust = prior = logistic(cell)
    for _ in range(EPOCHS * 4):
        trust = ((seen * taken(trust)).sum(1) + 50 * prior) / (seen.sum(1) + 50)
    trust = np.clip(trust, 1e-4, 1 - 1e-4)
    return np.r_[np.zeros(GAINS), np.log10(1 - trust[:, None] + trust[:, None] * ratio).reshape(-1)]


# -- scores ------------------------------------------------------------------------------------------
def score(docs: DataFrame, earlier: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, others_bits_per_byte.

    ``earlier`` is the number of words before a token whose exact sequence in the corpus is mixed in; 0 leaves it out.
    """
    spark = docs.sparkSession
    rows = common.id_text(docs).withColumn("train", ~common.fold("doc_id", 2, 7))
    coded = _coded(_slices(rows), earlier)
    tokens, distinct, top, totals = _common_words(coded)
    vocabulary = _vocabulary(coded, distinct)
    letters = np.zeros(256)
    for row in vocabulary.select(F.posexplode("letters")).groupBy("pos").agg(F.sum("col").alias("n")).toLocalIterator():
        letters[row.pos] = row.n
    mixer = spark.sparkContext.broadcast(_mixer(vocabulary, letters, _tables(vocabulary, letters)))
    model = spark.sparkContext.broadcast(_text(coded, top, totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, (text, levels) = pickle.loads(mixer.value), model.value
        for batch in batches:
            for row in zip(*(batch.column(c) for c in names), strict=True):
                ids, train, sizes, spans = (x.as_py() for x in row[:4])
                codes, spaced, n = _whole_codes(row[4]), _whole(row[5]), np.frombuffer(_whole(row[6]), "<i8")
                keys = _keys(spaced)
                symbols = text.symbols(keys, n)
                # What a word adds to its symbol: nothing, its share of the class, or its spelling.
                leaf = np.where(symbols < TOP, 0, np.log10(np.maximum(n, 1)) - np.log10(np.maximum(text.totals[symbols], 1)))
                rare = np.flatnonzero(symbols == TOP + 1)
                words = [b"", *(spaced.split(b" ") if spaced else [])]
                for a in range(0, len(rare), SPELLED_AT_ONCE):
                    part = rare[a : a + SPELLED_AT_ONCE]
                    leaf[part] = spelling.log10(b" ".join([*(words[i] for i in part), b""]))
                logs = leaf[codes]
                for a, slots, node, bit, owner in text.bits(codes, keys, n, symbols):
                    cells = _cells(node, [levels[k, slots[k]] for k in range(TEXT_CONTEXTS)])
                    part = np.bincount(owner, text.logs[cells * 2 + bit])
                    logs[a : a + len(part)] += part
                sizes, train = np.array(sizes), np.array(train)
                begin = np.cumsum(sizes) - sizes
                gains, others, seen = [np.zeros(0, "<u2")], [np.zeros(0, "<u2")], np.zeros(0, np.int64)
                if earlier:
                    events, at, there = _sorted_events(codes, keys, earlier)
                    counts, stop = [_whole_codes(c) for c in row[7:]], begin + sizes
                    behind = np.cumsum(there) - there
                    a = 0
                    while a < len(sizes):
                        # Some whole documents at a time.
                        b = max(a + 1, int(np.searchsorted(stop, begin[a] + TOKENS_AT_ONCE)))
                        part, doc = slice(begin[a], stop[b - 1]), np.repeat(np.arange(b - a), sizes[a:b])[there[begin[a] : stop[b - 1]]]
                        own = at[behind[begin[a]] :][: len(doc)]
                        gains.append(_gains(there[part], logs[part], *(c[own].astype(np.int64) for c in counts)))
                        others.append(_gains(there[part], logs[part], *_without_own(own, doc, train[a:b], events, counts)))
                        a = b
                    seen = np.bincount(np.concatenate(others)[np.repeat(train, sizes)])
                    seen[:1] = 0
                gains, others = np.concatenate(gains), np.concatenate(others)
                used = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tolist()], kind) for x, kind in (
                        (np.array(ids, object), pa.list_(pa.int64())), (~train, pa.list_(pa.bool_())), (sizes, pa.list_(pa.int64())), (np.array(spans), pa.list_(pa.int64())),
                        (np.add.reduceat((n > 0)[codes].astype(np.int64), begin), pa.list_(pa.int64())),
                        (np.add.reduceat(np.log10(n + 1)[codes], begin) - sizes * np.log10(tokens + distinct + 1), pa.list_(pa.float64())),
                        (np.add.reduceat(logs, begin), pa.list_(pa.float64())), (used, pa.list_(pa.int64())), (seen[used], pa.list_(pa.int64())))]
                    + [pa.array([_squeezed_numbers(g)], pa.binary()) for g in (gains, others)],
                    ["ids", "held", "sizes", "bytes", "known", "base", "total", "used", "times", "gains", "others"])
        pa.default_memory_pool().release_unused()

    names = ["ids", "train", "sizes", "bytes", "codes", "words", "n", "followed", "total", "kinds"]
    with _row_by_row(spark):
        scored = common.stored(coded.select(*names).mapInArrow(
            run, "ids array<long>, held array<boolean>, sizes array<long>, bytes array<long>, known array<long>, base array<double>, "
            "total array<double>, used array<long>, times array<long>, gains binary, others binary"), "scored-slices")
    seen = np.zeros((1 + SIZES * SIZES * RUNS) * GAINS, np.int64)
    for row in scored.select(F.explode(F.arrays_zip("used", "times")).alias("x")).groupBy("x.used").agg(F.sum("x.times").alias("n")).toLocalIterator():
        seen[row.used] = row.n
    learned = spark.sparkContext.broadcast(sequence_logs(seen))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in columns), strict=True):
                ids, held, known = (x.values for x in row[:3])
                sizes, spans, base, total = (x.values.to_numpy() for x in row[3:7])
                begin = np.cumsum(sizes) - sizes
                with_own, others = (total + (np.add.reduceat(learned.value[g], begin) if len(g) else 0) for g in (_whole_numbers(x, "<u2") for x in row[7:]))
                each_byte = lambda t: pa.array(-t * np.log2(10) / np.maximum(spans, 1), mask=spans == 0)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [ids, held, pa.array(sizes), known, pa.array(np.full(len(sizes), tokens)), pa.array(base), pa.array(with_own), each_byte(with_own), each_byte(others)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte", "others_bits_per_byte"])

    columns = ["ids", "held", "known", "sizes", "bytes", "base", "total", "gains", "others"]
    with _row_by_row(spark):
        return common.stored(scored.select(*columns).mapInArrow(
            add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
            "bits_per_byte double, others_bits_per_byte double"), "scores")


def op9_mixing_lm(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), EARLIER)
