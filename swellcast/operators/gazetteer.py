"""Names of several words, or of scripts without spaces, found in texts by a code-point automaton.

Texts and names are compared in one form: lower case, every run of characters that are neither letters
nor digits as one space. A name begins and ends at a word's edge, except where its own edge is a
character of a script that is written without spaces. The longest name wins at a place, and the search goes
on behind it; found names do not overlap.

Names are cut into blocks of bounded size. A block's names are broadcast, each worker builds one
automaton of them, and one pass over the texts finds every place where a name of the block begins,
with the longest one. Places of all blocks meet by text, where the leftmost longest are taken.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the names of one pass, which bounds what is broadcast; the automaton takes some ten times as much.
BLOCK_BYTES = 2_000_000
#: Characters of the texts that a worker holds as Python strings at once, with the places found in them.
TEXT_CHARS = 2_000_000
#: Code points from here on belong to scripts without spaces (kana, ideographs and what follows them).
UNSPACED = 0x2E80


def plain_form(text: Column) -> Column:
    """Lower case, with one space for everything between words, and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


@functools.lru_cache(maxsize=2)
def _automaton(key: int, shared) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for name, kind in shared.value:
        made.add_word(name, (name, kind))
    made.make_automaton()
    return made


def _edge(text: str, at: int) -> bool:
    """Whether a word ends between ``at - 1`` and ``at``."""
    if at <= 0 or at >= len(text):
        return True
    return any(c == " " or ord(c) >= UNSPACED for c in text[at - 1 : at + 1])


def starts(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, name, type) of the longest name that begins at each place."""
    best: dict[int, tuple[int, int, str, str]] = {}
    for last, (name, kind) in automaton.iter(text):
        begin, end = last - len(name) + 1, last + 1
        if _edge(text, begin) and _edge(text, end) and (begin not in best or best[begin][1] < end):
            best[begin] = (begin, end, name, kind)
    return [best[b] for b in sorted(best)]


def leftmost(places: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Of places sorted by start, longest first, those that the search takes from the left."""
    out, at = [], 0
    for place in places:
        if place[0] >= at:
            out.append(place)
            at = place[1]
    return out


_FIELDS = ("start", "end", "name", "entity_type")
_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("entity_type", pa.string())]))
_SQL_PLACES = "array<struct<start: int, end: int, name: string, entity_type: string>>"


def _rows(keys: pa.Array, places: list[list[tuple[int, int, str, str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.array([[dict(zip(_FIELDS, p, strict=True)) for p in own] for own in places], _PLACES)], ["_key", "_places"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about TEXT_CHARS characters of ``_form``, whole rows each: a batch counts rows, whatever their length."""
    for batch in batches:
        sizes = pc.utf8_length(batch.column("_form")).to_pylist()
        begin = held = 0
        for at, size in enumerate(sizes):
            if at > begin and held + size > TEXT_CHARS:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += size
        yield batch.slice(begin)


def _found(shared, number: int, alone: bool):
    """Places per text; if there is no other block, only those that the search takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            automaton = _automaton(number, shared)
            places = [starts(automaton, t) for t in batch.column("_form").to_pylist()]
            yield _rows(batch.column("_key"), list(map(leftmost, places)) if alone else places)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [sorted((tuple(p[f] for f in _FIELDS) for p in own), key=lambda p: (p[0], -p[1])) for own in batch.column("_places").to_pylist()]
        yield _rows(batch.column("_key"), list(map(leftmost, places)))


def name_mentions(texts: DataFrame, gazetteer: DataFrame, key: str, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, start, name, entity_type): every mention; ``start`` counts characters of the text's plain form.

    ``gazetteer``: name, entity_type. Of entries with one name the type that sorts first counts; names
    without a letter or digit and null texts find nothing. ``key`` names one text; rows that share it are
    texts of their own with the same key.
    """
    spark = texts.sparkSession
    names = gazetteer.select(plain_form(F.col("name")).alias("name"), "entity_type").where("name <> ''").groupBy("name").agg(
        F.min("entity_type").alias("entity_type"))
    total = names.agg(F.sum(F.octet_length("name") + F.octet_length("entity_type"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    kind = texts.schema[key].dataType.simpleString()
    forms = texts.select(F.col(key).alias("_key"), plain_form(F.col(text)).alias("_form")).where("_form <> ''")
    if blocks > 1:
        # The places of a row travel under its number, and meet those of the other blocks.
        forms = forms.select(F.struct("_key", F.monotonically_increasing_id().alias("_row")).alias("_key"), "_form")
        kind = f"struct<_key: {kind}, _row: long>"
    schema, found = f"_key {kind}, _places {_SQL_PLACES}", None
    for number in range(blocks):
        block = names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == number)
        shared = spark.sparkContext.broadcast([(r.name, r.entity_type) for r in block.toLocalIterator()])
        if shared.value:
            own = forms.mapInArrow(_found(shared, number, blocks == 1), schema).where(F.size("_places") > 0)
            found = own if found is None else found.unionByName(own)
    if found is None:
        return texts.select(F.col(key), F.lit(0).alias("start"), F.lit("").alias("name"), F.lit("").alias("entity_type")).where("false")
    if blocks > 1:
        found = found.groupBy("_key").agg(F.flatten(F.collect_list("_places")).alias("_places")).mapInArrow(_merged, schema)
        found = found.select(F.col("_key._key").alias("_key"), "_places")
    return found.select(F.col("_key").alias(key), F.inline("_places")).select(key, "start", "name", "entity_type")
