"""Token-id output as wavelet matrix files.

Documents are tokenised where they lie: a text falls at ASCII white space into chunks, which the
tokenizer's white-space rules make independent, and each distinct chunk is encoded once by the
tokenizers library. The ids travel to shards by ranges of doc_id; each shard is sorted and cut into
files of about ``FILE_TOKENS`` ids, which are rows (shard, file, payload) of a table in the shared
folder.

A file holds, after a JSON header: the document ids, the document lengths, and a wavelet matrix of
the ids: one bit-plane per id bit, highest first, each plane the bits of the sequence after a stable
partition by the plane before, with the number of ones before every block of 512 bits. ``WaveletFile``
answers from it: ``access`` (any positions at once), ``count`` of an id in a prefix (its rank),
``select`` (place of its k-th occurrence) and ``tokens`` (all of them).

Defined results: a null text has the end id alone; documents are ordered by doc_id, then by their
ids, null ids first; repeated rows are written once each; an empty table writes no file.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swellcast.llm import common

END_ID = 1
FILE_TOKENS = 1_000_000
CACHE_CHUNKS = 250_000
MAGIC = b"WVM1"
#: 64-bit words of a plane for one stored count of ones.
BLOCK = 8
#: A letter and the punctuation that ends its chunk, and what takes their place.
_GAP = (r"([a-zÀ-ÖØ-öø-ÿ])([.,!?;:%&*#$|]+)(\s|$)", r"\1 \2\3")
#: Chunks of Latin letters with punctuation behind them: one or two pre-tokens.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%&*#$|]*)")


class WaveletFile:
    """Reader of one payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("no wavelet file")
        size = struct.unpack("<I", payload[4:8])[0]
        head = json.loads(payload[8 : 8 + size])
        self.n, self.bits, docs = head["tokens"], head["bits"], head["documents"]
        at = 8 + size
        self.ids = np.frombuffer(payload, np.int64, docs, at)
        self.null = np.frombuffer(payload, np.uint8, docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(payload, np.int64, docs, at + 9 * docs)
        at += 17 * docs
        blocks = self.n // (64 * BLOCK) + 1
        words = blocks * BLOCK
        self.planes = np.frombuffer(payload, np.uint64, self.bits * words, at).reshape(self.bits, words)
        at += 8 * self.bits * words
        self.before = np.frombuffer(payload, np.uint32, self.bits * blocks, at).reshape(self.bits, blocks)
        self.zeros = [self.n - self._rank1(b, np.array([self.n]))[0] for b in range(self.bits)]

    def _rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        part = self.planes[plane][word] & ((np.uint64(1) << bit) - np.uint64(1))
        ones = self.before[plane][word // BLOCK].astype(np.int64) + np.bitwise_count(part)
        for back in range(1, BLOCK):
            earlier = word - back
            inside = earlier >= word // BLOCK * BLOCK
            ones += np.where(inside, np.bitwise_count(self.planes[plane][np.maximum(earlier, 0)]), 0)
        return ones

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given positions."""
        at, out = np.asarray(at, np.int64).copy(), np.zeros(len(at), np.int64)
        for plane in range(self.bits):
            one = (self.planes[plane][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._rank1(plane, at)
            at = np.where(one, self.zeros[plane] + ones, at - ones)
            out = out * 2 + one
        return out

    def tokens(self) -> np.ndarray:
        """All ids in order: the stable partitions undone from the last plane to the first."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[plane].view(np.uint8), count=self.n, bitorder="little").astype(bool)
            back = np.empty_like(out)
            back[~one] = out[: self.zeros[plane]]
            back[one] = out[self.zeros[plane] :] | out.dtype.type(1 << (self.bits - 1 - plane))
            out = back
        return out

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        """[begin, end) of the token's occurrences before ``stop`` in the last order."""
        begin, end = 0, stop
        for plane in range(self.bits):
            ones = self._rank1(plane, np.array([begin, end]))
            if token >> (self.bits - 1 - plane) & 1:
                begin, end = (int(self.zeros[plane] + x) for x in ones)
            else:
                begin, end = int(begin - ones[0]), int(end - ones[1])
        return begin, end

    def count(self, token: int, stop: int | None = None) -> int:
        """Occurrences of ``token`` before position ``stop``."""
        if token >> self.bits:
            return 0
        begin, end = self._range(token, self.n if stop is None else stop)
        return end - begin

    def select(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence; -1 if there are fewer."""
        if token >> self.bits:
            return -1
        begin, end = self._range(token, self.n)
        if k < 0 or begin + k >= end:
            return -1
        at = begin + k
        for plane in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - plane) & 1
            rank = at - self.zeros[plane] if one else at
            low, high = 0, self.n
            while low < high:  # the first position with more than ``rank`` such bits up to it
                mid = (low + high) // 2
                ones = int(self._rank1(plane, np.array([mid + 1]))[0])
                low, high = (low, mid) if (ones if one else mid + 1 - ones) > rank else (mid + 1, high)
            at = low
        return int(at)


def build(ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """The payload of one file."""
    n = len(tokens)
    bits = max(1, int(tokens.max()).bit_length()) if n else 1
    blocks = n // (64 * BLOCK) + 1
    words = blocks * BLOCK
    planes, before = np.zeros((bits, words), np.uint64), np.zeros((bits, blocks), np.uint32)
    order = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    for plane in range(bits):
        one = (order & order.dtype.type(1 << (bits - 1 - plane))) > 0
        padded = np.zeros(words * 64, bool)
        padded[:n] = one
        planes[plane] = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(planes[plane]).reshape(blocks, BLOCK).sum(1, dtype=np.uint32)
        before[plane] = np.cumsum(ones, dtype=np.uint32) - ones
        order = np.concatenate([order[~one], order[one]])
    head = json.dumps({"tokens": n, "bits": bits, "documents": len(ids)}).encode()
    return b"".join([
        MAGIC, struct.pack("<I", len(head)), head, np.array([i or 0 for i in ids], np.int64).tobytes(),
        np.array([i is None for i in ids], np.uint8).tobytes(), lengths.astype(np.int64).tobytes(),
        planes.tobytes(), before.tobytes()])


class Chunks:
    """Ids of white-space separated chunks, encoded by the library once each."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.lengths, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _thin(self) -> None:
        """Keep the half of the cache that most slices have used; older uses count half."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHE_CHUNKS // 2])
        starts, names = np.cumsum(self.lengths) - self.lengths, list(self.index)
        self.flat = self.flat[common.ranges(starts[keep], self.lengths[keep])]
        self.lengths, self.used = self.lengths[keep], self.used[keep] // 2
        self.index = {names[i]: at for at, i in enumerate(keep.tolist())}

    def _add(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks)), strict=True))
        self.flat, self.lengths = np.concatenate([self.flat, ids]), np.concatenate([self.lengths, lengths])
        self.used = np.concatenate([self.used, np.zeros(len(chunks), np.int64)])

    def _apart(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return (np.fromiter((i for c in coded for i in c), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)))

    def _together(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One call for all: every pre-token ends with an id that carries the word end, so the ids fall apart again."""
        if not stems:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids])
        return (ids, np.diff(np.r_[-1, ends])) if len(ends) == len(stems) else self._apart(stems)

    def _learn(self, new: list[str]) -> None:
        """Plain chunks are their lower-case stem and the punctuation behind it, two pre-tokens; the rest goes whole."""
        index = self.index
        # Most new chunks are lower-case words already, and so their own stems.
        words = [c for c in new if c.isascii() and c.isalpha() and c.islower()]
        known = set(words)
        matched = [(c, _PLAIN.fullmatch(c)) for c in new if c not in known]
        rest = [c for c, m in matched if not m]
        plain = [(c, m[1].lower(), m[2]) for c, m in matched if m]
        rest += {tail for *_, tail in plain}.difference(index, rest)
        self._add(rest, *self._apart(rest))
        words += {stem for _, stem, _ in plain}.difference(index, known)
        self._add(words, *self._together(words))
        made = [x for x in plain if x[0] not in index]
        parts = np.array([(index[stem], index[tail]) for _, stem, tail in made], np.int64).reshape(-1)
        starts = np.cumsum(self.lengths) - self.lengths
        ids = self.flat[common.ranges(starts[parts], self.lengths[parts])]
        self._add([c for c, *_ in made], ids, self.lengths[parts].reshape(-1, 2).sum(1))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end id per text, and the number of ids of each."""
        if len(self.index) > CACHE_CHUNKS:
            self._thin()
        # Only ASCII white space splits; other separators stay inside a chunk for the library. Each distinct
        # chunk of the slice comes to Python once.
        split = pc.ascii_split_whitespace(_lowered(texts))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        own = np.fromiter(map(self.index.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(own < 0)
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            self._learn(new)
            own[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        self.used[own] += 1
        at = own[coded.indices.to_numpy()]
        starts = np.cumsum(self.lengths) - self.lengths
        lengths = self.lengths[at]
        ids = self.flat[common.ranges(starts[at], lengths)]
        ends = np.r_[0, np.cumsum(lengths)][split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
        return np.insert(ids, ends, END_ID).astype(np.uint32), np.diff(np.r_[0, ends]) + 1


def _lowered(texts: list[str]) -> pa.Array:
    """The texts with A-Z lower-cased and a gap before the punctuation that ends a chunk.

    The tokenizer lower-cases anyway and always parts a letter from punctuation, so a word is one chunk whatever
    stands behind it; only its special tokens are matched before that.
    """
    column = pa.array(texts, pa.string())
    plain = pc.replace_substring_regex(pc.ascii_lower(column), *_GAP)
    marked = [i for i, t in enumerate(texts) if "<|" in t]
    if not marked:
        return plain
    special = np.zeros(len(texts), bool)
    special[marked] = True
    return pc.if_else(pa.array(special), column, plain)


@functools.lru_cache(maxsize=2)
def _chunks(tokenizer_file: str) -> Chunks:
    return Chunks(tokenizer_file)


def tokenised(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, tokens binary, width): ids as little-endian integers of ``width`` bytes, end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = _chunks(tokenizer_file)
        for batch, texts in common.slices(batches):
            ids, counts = own.encode(texts)
            width = np.dtype(own.kind).itemsize
            stops = np.r_[0, np.cumsum(counts) * width].astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(stops), pa.py_buffer(ids.astype(own.kind))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), data, pa.array([width] * len(texts), pa.int32())], ["doc_id", "tokens", "width"])
            del ids, data, batch, texts
        # The worker lives on for other stages; what this task's batches took goes back.
        pa.default_memory_pool().release_unused()

    return common.id_text(docs).mapInArrow(run, "doc_id long, tokens binary, width int")


def write_files(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write the corpus; the stored table (shard, file, tokens, payload), in doc_id order by (shard, file)."""
    shards = common.partitions_for(docs.sparkSession)
    # Range bounds come from doc_id alone, so the text is not read for them.
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double")).na.drop().approxQuantile(
        "doc_id", [i / shards for i in range(1, shards)], 1 / (4 * shards)))) if docs.columns else []
    bound = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else None
    shard = F.coalesce(F.size(F.filter(bound, lambda b: b < F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        shard, file, size, width, offset = None, 0, 0, 4, 0

        def flush() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(t for _, t in held), f"<u{width}")
            payload = build([i for i, _ in held], np.array([len(t) // width for _, t in held]), tokens)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([file], pa.int32()), pa.array([offset], pa.int64()),
                 pa.array([len(tokens)], pa.int64()), pa.array([payload], pa.binary())],
                ["shard", "file", "offset", "tokens", "payload"])

        for batch in batches:
            for s, i, t, width in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "tokens", "width")), strict=True):  # noqa: B007
                if held and (s != shard or size >= FILE_TOKENS):
                    yield flush()
                    file, offset = (file + 1, offset + size) if s == shard else (0, 0)
                    size, held = 0, []
                shard = s
                held.append((i, t))
                size += len(t) // width
        if held:
            yield flush()
        held = []
        pa.default_memory_pool().release_unused()

    dealt = (tokenised(docs, tokenizer_file).withColumn("shard", shard.cast("int")).repartition(shards, "shard")
             .sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "tokens"))
    return common.stored(dealt.mapInArrow(run, "shard int, file int, offset long, tokens long, payload binary"), "wavelets")


def read_back(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    # One row per shard, so as many as shuffle partitions: small enough to order in one task and to broadcast.
    totals = files.groupBy("shard").agg(F.sum("tokens").alias("_all"))
    before = totals.select("shard", F.coalesce(F.sum("_all").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, base in zip(batch.column("payload"), batch.column("offset").to_pylist(), strict=True):
                own = WaveletFile(payload.as_py())
                tokens = own.tokens().astype("<u4").tobytes()
                ends = np.cumsum(own.lengths)
                starts = ends - own.lengths
                crc = [zlib.crc32(tokens[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.ids, mask=own.null), pa.array(starts + base), pa.array(own.lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])
        pa.default_memory_pool().release_unused()

    return files.join(F.broadcast(before), "shard").select("payload", (F.col("offset") + F.col("before")).alias("offset")).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_wavelet(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_back(write_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
