"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is its characters with every space as the word mark, and one mark in front. No piece of the
vocabulary runs from another character into a word mark, so the text falls into independent
segments: a run of marks and the characters up to the next mark (checked when the model loads;
otherwise the whole text is one segment). All new segments of a slice are merged together: one flat
array of symbols, the pair ranks beside it, and per round the smallest rank of every segment by a
segmented minimum; its leftmost non-overlapping occurrences merge at once, the array is compacted,
and finished segments leave.

One by one merging would give the same result only if no merge creates a pair of the same or a
better rank, which this vocabulary does not promise. So each round looks at the pairs a merge would
create; in a segment where one reaches the current rank, the merges behind the first such place wait
for the next round. Results equal the library's for every text.

Segments already merged are remembered per Python worker, up to ``CACHE_WORDS``.

Defined results: a null text is empty and gives the end id alone; other columns are ignored; rows
are independent of each other; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from swellcast.llm import common

MARK = "▁"
CACHE_WORDS = 120_000
_NONE = np.int32(2**31 - 1)


class Codec:
    """Tables of one model file and the merge rounds over them."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.end_id, self.unknown_id, self.size = model.eos_id(), model.unk_id(), size
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        is_byte = [model.is_byte(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(size):
            if is_byte[i]:
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        normal = {pieces[i]: i for i in range(size) if not special[i] and not is_byte[i] and not model.is_unused(i)}
        # Symbols: piece ids, then characters that occur in pieces without being one.
        symbols = dict(normal)
        for piece in normal:
            for char in piece:
                symbols.setdefault(char, size + len(symbols))
        self.width = size + len(symbols) + 1
        self.char_symbol = np.full(0x110000, self.width - 1, np.int32)
        for text, symbol in symbols.items():
            if len(text) == 1:
                self.char_symbol[ord(text)] = symbol
        scores = {i: model.get_score(i) for i in normal.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        keys, ranks, merged = [], [], []
        for text, i in normal.items():
            for cut in range(1, len(text)):
                left, right = symbols.get(text[:cut]), symbols.get(text[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    ranks.append(order[scores[i]])
                    merged.append(i)
        by_key = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[by_key], np.int64(2**62))
        self.ranks = np.append(np.array(ranks, np.int32)[by_key], _NONE)
        self.merged = np.append(np.array(merged, np.int32)[by_key], np.int32(0))
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)
        # Decoding: the bytes of each id.
        out = [b"" if model.is_control(i) else " ⁇ ".encode() if special[i] else
               bytes([int(pieces[i][3:5], 16)]) if is_byte[i] else pieces[i].replace(MARK, " ").encode()
               for i in range(size)]
        self.piece_len = np.array([len(b) for b in out], np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.is_byte = np.array(is_byte)
        self.leads = np.array([not special[i] and not is_byte[i] and pieces[i][:1] == MARK for i in range(size)])
        self.is_control = np.array([model.is_control(i) for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.word_text: list[str] = []
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    # -- encoding ---------------------------------------------------------------------------------
    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if self.splits and "  " not in text and text[0] != " " and MARK not in text:
            return (MARK + text.replace(" ", " " + MARK)).split(" ")
        marked = MARK + text.replace(" ", MARK)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if self.splits else [marked]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the merge table, or of its last entry, which never merges."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1).astype(np.int32)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, concatenated, and the number of ids of each."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols, owner = self.char_symbol[chars], np.repeat(np.arange(len(words)), lengths)
        unknown = symbols >= self.size
        # Characters travel with their symbol, so that those outside the vocabulary become bytes at the end.
        chars = np.where(unknown, chars, 0)
        pair = np.full(len(symbols), len(self.keys) - 1, np.int32)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pair[inside] = self._pairs(symbols[inside], symbols[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[first, len(symbols)])
            rank = self.ranks[pair]
            least = np.minimum.reduceat(rank, first)
            ended = least == _NONE
            if ended.any():
                gone = np.repeat(ended, count)
                done.append((owner[gone], symbols[gone], chars[gone]))
                symbols, owner, pair, rank, chars = (x[~gone] for x in (symbols, owner, pair, rank, chars))
                if not len(symbols):
                    break
                count, least = count[~ended], least[~ended]
            segment = np.repeat(np.arange(len(count)), count)
            least = least[segment]
            hit = np.flatnonzero(rank == least)
            # Of adjacent candidates every second one merges, counted from the left.
            fresh = np.r_[True, np.diff(hit) != 1]
            begin = hit[fresh][np.cumsum(fresh) - 1]
            pick = hit[(hit - begin) % 2 == 0]
            new = self.merged[pair[pick]]
            # The pairs that these merges create: with the symbol left of them as it will be then, and the next one.
            left = symbols[np.maximum(pick - 1, 0)].copy()
            after = np.flatnonzero(np.r_[False, np.diff(pick) == 2])
            left[after] = new[after - 1]
            left_ok = (pick > 0) & (segment[np.maximum(pick - 1, 0)] == segment[pick])
            far = np.minimum(pick + 2, len(symbols) - 1)
            right_ok = (pick + 2 < len(symbols)) & (segment[far] == segment[pick])
            made = np.minimum(
                np.where(left_ok, self.ranks[self._pairs(left, new)], _NONE),
                np.where(right_ok, self.ranks[self._pairs(new, symbols[far])], _NONE))
            clash = np.flatnonzero(made <= least[pick])
            if len(clash):
                seg, at = np.unique(segment[pick[clash]], return_index=True)
                limit = np.full(len(count), len(symbols), np.int64)
                limit[seg] = pick[clash[at]]
                stay = pick <= limit[segment[pick]]
                pick, new = pick[stay], new[stay]
            symbols[pick] = new
            keep = np.ones(len(symbols), bool)
            keep[pick + 1] = False
            place = np.cumsum(keep) - 1
            chars[pick] = 0
            symbols, owner, pair, chars = symbols[keep], owner[keep], pair[keep], chars[keep]
            at = place[pick]
            touched = np.zeros(len(symbols), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            pair[touched] = len(self.keys) - 1
            touched[:-1] &= owner[1:] == owner[:-1]
            touched[-1] = False
            go = np.flatnonzero(touched)
            pair[go] = self._pairs(symbols[go], symbols[go + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owner, symbols, chars = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        owner, symbols, chars = owner[order], symbols[order], chars[order]
        outside = np.flatnonzero(symbols >= self.size)
        if len(outside):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars[outside]]
            times = np.ones(len(symbols), np.int64)
            times[outside] = [len(b) for b in raw]
            spot = np.cumsum(times) - times
            owner, symbols = np.repeat(owner, times), np.repeat(symbols, times)
            symbols[common.ranges(spot[outside], times[outside])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return symbols.astype(np.int32), np.bincount(owner, minlength=len(words)).astype(np.int64)

    def _learn(self, segments: Iterable[str]) -> None:
        new = list(dict.fromkeys(s for s in segments if s not in self.index))
        if not new:
            return
        ids, lengths = self.merge(new)
        texts, at = list(map(str, ids.tolist())), 0
        for word, n in zip(new, lengths.tolist(), strict=True):
            self.index[word] = len(self.word_text)
            self.word_text.append(" ".join(texts[at : at + n]))
            at += n
        self.flat, self.lengths = np.concatenate([self.flat, ids]), np.concatenate([self.lengths, lengths])

    def encode_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts with an end id each, the ids per text, and their decimal texts."""
        if len(self.index) > CACHE_WORDS:
            self._forget()
        per_text = [self.segments(t) for t in texts]
        flat_words = [s for segs in per_text for s in segs]
        self._learn(flat_words)
        index = np.fromiter(map(self.index.__getitem__, flat_words), np.int64, len(flat_words))
        starts = np.cumsum(self.lengths) - self.lengths
        ids = self.flat[common.ranges(starts[index], self.lengths[index])]
        sizes = np.fromiter(map(len, per_text), np.int64, len(texts))
        ends = np.r_[0, np.cumsum(self.lengths[index])][np.cumsum(sizes)] if len(texts) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[0, ends]) + 1
        ids = np.insert(ids, ends, self.end_id).astype(np.int32)
        words, decimals, at = list(map(self.word_text.__getitem__, index.tolist())), [], 0
        for n in sizes.tolist():
            decimals.append(" ".join([*words[at : at + n], str(self.end_id)]))
            at += n
        return ids, counts, decimals

    # -- decoding ---------------------------------------------------------------------------------
    def decode_slice(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of every id list. The mark that encoding puts in front of a text goes."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise IndexError("piece id out of range")
        lengths = self.piece_len[ids]
        data = self.piece_bytes[common.ranges(self.piece_start[ids], lengths)].tobytes()
        stops, id_stops = np.r_[0, np.cumsum(lengths)], np.r_[0, np.cumsum(counts)]
        out = []
        for a, b in zip(id_stops[:-1].tolist(), id_stops[1:].tolist(), strict=True):
            begin = int(stops[a])
            own = ids[a:b]
            shown = np.flatnonzero(~self.is_control[own[:8]]) if b > a else ()
            if len(shown) and self.leads[own[shown[0]]]:
                begin += 1
            raw = data[begin : int(stops[b])]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(self._lenient(own))
        return out

    def _lenient(self, ids: np.ndarray) -> str:
        """Byte runs that are no valid UTF-8: every byte outside a valid character becomes U+FFFD."""
        parts, run, seen = [], bytearray(), False

        def flush() -> None:
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(bytes(run[:n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    parts.append("�")
                del run[:n]

        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.piece_bytes[self.piece_start[i] : self.piece_start[i] + 1].tobytes()
                seen = True
                continue
            flush()
            text = self.piece_bytes[self.piece_start[i] : self.piece_start[i] + self.piece_len[i]].tobytes().decode()
            parts.append(text[1:] if not seen and self.leads[i] else text)
            seen = seen or not self.is_control[i]
        flush()
        return "".join(parts)


@functools.lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One codec per Python worker and model."""
    return Codec(model_file)


def encode_decode(docs: DataFrame, model_file: str, outputs: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ``outputs`` names ids and decoded where they are wanted."""
    kinds = {"ids": "array<int>", "decoded": "string"}
    schema = ", ".join(["doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", *(f"{c} {kinds[c]}" for c in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch, texts in common.slices(batches):
            ids, counts, decimals = own.encode_slice(texts)
            decoded = own.decode_slice(ids, counts)
            columns = [
                batch.column("doc_id"), pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decimals]),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            for name in outputs:
                columns.append(pa.array(decoded) if name == "decoded" else pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, [*names, *outputs])
            del ids, decimals, decoded, columns

    return common.id_text(docs).mapInArrow(run, schema)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
