"""N-gram Jaccard join by prefixes of single rare shingles and of combinations of frequent ones.

A document is its set of word shingles, as 64-bit hashes. All documents with the same set are one
node. Document frequencies, kept in a counter sketch of fixed size over the whole corpus, split the
shingles into rare and frequent ones; the shared order is rare before frequent, then by hash.

* Two linked sets share a shingle of their prefixes (size - ceil(t * size) + 1 shingles). Rare
  shingles of the prefix are indexed one by one. A rare shingle is in no more documents than its
  counter says, so its bucket is bounded by the class limit.
* If a pair shares only frequent shingles in its prefixes, it shares no rare one at all. Extending
  both prefixes by g shingles makes it share g + 1 frequent ones, two of which fall into the same
  one of g hash classes. So such documents index the pairs within each class: about as many keys as
  the prefix is long. g follows the size class (powers of two) of the smaller document; a larger
  partner that may reach down into it also writes that class's keys.

A bucket never becomes all its pairs. First every member is verified against the bucket's smallest
node only; the links found are contracted to components. Then only buckets that still hold several
components are joined across them (in combination buckets the members outside the largest component
against all), filtered by size, by the positions of the shared prefix shingles, and, in combination buckets,
by the number of frequent shingles, which bounds the overlap of a pair that shares no rare one. Candidate pairs of both rounds
pass a bound from small hash-bucket counts of the two sets and are then verified by exact intersection. Both rounds together find a link between every two components that have one.

Defined results: words are split at ASCII white space, A-Z lower-cased; fewer words than the shingle
length make one shingle of the whole sequence; null or wordless texts have an empty set and no
links; repeated rows belong together; a null id is no component's smallest unless all are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swellcast.llm import common
from swellcast.llm.components import components

WORDS = 5
PERCENT = 80
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Counters of the frequency sketch: between these powers of two, about one for 1,024 bytes of text.
SKETCH_BITS = (20, 24)
CHUNK = 1 << 14
#: Bits of the filter that keeps documents outside all candidate pairs out of a verification.
FILTER_BITS = 26
PIVOT_PAIRS = 1_000
#: Least open combinations of a node that its rows carry, to tell whether a pair has met before.
HEADS = 12
#: Hash buckets of a set's shape: the overlap of two sets is at most the sum of their buckets' smaller counts.
SHAPE = 256
PIVOT_SALTS = 16
_NO_ID = -(2**63)


def shingles(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    raw = b"\n".join(t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts) + b"\n"
    char = np.frombuffer(raw, np.uint8)
    space = (char == 32) | (char == 10)
    edge = np.diff(np.r_[1, space.astype(np.int8), 1])
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    empty = np.zeros(0, np.uint64)
    if not len(begin):
        return [empty for _ in texts]
    inner = np.flatnonzero(~space)
    place = (inner - np.repeat(begin, end - begin)).astype(np.uint64)
    with np.errstate(over="ignore"):
        spelled = common.mix64(char[inner].astype(np.uint64) + np.uint64(1) + (place << np.uint64(9)))
        word = common.mix64(np.add.reduceat(spelled, np.cumsum(end - begin) - (end - begin)))
        stops = np.cumsum(char == 10)[begin]
        bounds = np.searchsorted(stops, np.arange(len(texts) + 1))
        sizes = np.diff(bounds)
        rolled = word
        for i in range(1, words):
            rolled = common.mix64(rolled[: max(len(word) - i, 0)] * _STEP + word[i:])
        out = []
        for a, n in zip(bounds[:-1].tolist(), sizes.tolist(), strict=True):
            if n >= words:
                out.append(np.unique(rolled[a : a + n - words + 1]))
            elif n:
                whole = np.array([n], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                for w in word[a : a + n]:
                    whole = common.mix64(whole * _STEP + w)
                out.append(whole)
            else:
                out.append(empty)
    return out


def node_of(own: np.ndarray) -> int:
    """One signed 64-bit name per set."""
    with np.errstate(over="ignore"):
        total = common.mix64(np.array([own.sum(dtype=np.uint64)])) + common.mix64(own ^ _STEP).sum(dtype=np.uint64)
        return int(common.mix64(total + np.uint64(len(own))).view(np.int64)[0])


def shape_of(own: np.ndarray) -> bytes:
    return np.bincount((own & np.uint64(SHAPE - 1)).astype(np.int64), minlength=SHAPE).astype("<u4").tobytes()


def at_least(percent: int, size: int) -> int:
    """The overlap that a set of ``size`` needs with any linked set."""
    return -(-percent * size // 100)


class Keys:
    """Index keys of a set under a frequency sketch."""

    def __init__(self, sketch: np.ndarray, percent: int):
        self.sketch, self.percent = sketch, percent
        self.shift = np.uint64(64 - int(math.log2(len(sketch))))
        mean = float(sketch.sum(dtype=np.float64)) / len(sketch)
        self.limit = mean + 6 * math.sqrt(mean) + 32

    def of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Rare prefix shingles in order, keys of frequent combinations, and the number of frequent shingles."""
        size = len(own)
        if not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        prefix = size - at_least(self.percent, size) + 1
        often = self.sketch[(own >> self.shift).astype(np.int64)] > self.limit
        rare, frequent = own[~often], own[often]
        single = rare[:prefix]
        if len(single) == prefix:
            return single.view(np.int64), np.zeros(0, np.int64), len(frequent)
        made = []
        level = size.bit_length() - 1
        levels = [level, level - 1] if level and at_least(self.percent, size) < 1 << level else [level]
        for lv in levels:
            classes = (1 << lv) // 8
            room = prefix + classes - len(rare)
            part = frequent[: max(room, 0)]
            with np.errstate(over="ignore"):
                salt = common.mix64(np.array([lv + 1], np.uint64))
                if not classes:
                    made.append(common.mix64(part ^ salt))
                    continue
                kind = common.mix64(part) % np.uint64(classes)
                part = part[np.argsort(kind, kind="stable")]
                kind = np.sort(kind)
                gap = 1
                while gap < len(part):
                    same = kind[gap:] == kind[:-gap]
                    if not same.any():
                        break
                    made.append(common.mix64(common.mix64(part[:-gap][same] ^ salt) * _STEP + part[gap:][same]))
                    gap += 1
        return single.view(np.int64), np.unique(np.concatenate(made)).view(np.int64), len(frequent)


def _sketch(rows: DataFrame, words: int) -> np.ndarray:
    """Document frequencies by hash counter over the whole corpus; its size is bounded."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(SKETCH_BITS[0], (total >> 10).bit_length()), SKETCH_BITS[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.uint32)
        for _, texts in common.slices(batches):
            sets = shingles(texts, words)
            held += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        parts = held.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["chunk", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.uint32)
        for b in frame.counts:
            total += np.frombuffer(b, np.uint32)
        return pd.DataFrame({"chunk": frame.chunk[:1], "run": (frame.run[:1] // 64), "counts": [total.tobytes()]})

    parts = rows.select("text").mapInArrow(count, "chunk long, counts binary").withColumn("run", F.spark_partition_id().cast("long"))
    runs = max(1, rows.rdd.getNumPartitions())
    while True:
        parts = parts.withColumn("_to", F.expr("run div 64")).groupBy("chunk", "_to").applyInPandas(
            add, "chunk long, run long, counts binary")
        runs = -(-runs // 64)
        if runs <= 1:
            break
    sketch = np.zeros(1 << bits, np.uint32)
    for row in parts.toLocalIterator():
        sketch[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, np.uint32)
    return sketch


def _indexed(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, node, size; the index keys and the shape only at a set's first row in each task."""
    shared = rows.sparkSession.sparkContext.broadcast(_sketch(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = Keys(shared.value, percent), set()
        for batch, texts in common.slices(batches):
            sets = shingles(texts, words)
            nodes, singles, combined, shapes, often = [node_of(s) for s in sets], [], [], [], []
            for node, own in zip(nodes, sets, strict=True):
                single, multi, frequent = (None, None, None) if node in seen else keys.of(own)
                if len(seen) < 1_000_000:
                    seen.add(node)
                singles.append(single)
                combined.append(multi)
                often.append(frequent)
                shapes.append(None if single is None or not len(own) else shape_of(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(singles, pa.list_(pa.int64())), pa.array(combined, pa.list_(pa.int64())), pa.array(shapes, pa.binary()),
                 pa.array(often, pa.int64())],
                ["doc_id", "node", "size", "singles", "combined", "shape", "often"])

    return common.stored(rows.mapInArrow(
        run, "doc_id long, node long, size long, singles array<long>, combined array<long>, shape binary, often long"), "keys")


def _id(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col), F.lit(_NO_ID))


def _marked(candidates: DataFrame) -> np.ndarray:
    """A filter of 2**FILTER_BITS bits with the documents of ``candidates`` (doc_id long)."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    rows = candidates.select(F.expr("0L").alias("_"), bit.alias("bit")).groupBy(
        F.expr("bit div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits"))
    held = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in rows.toLocalIterator():
        held[row.bucket * 4096 : (row.bucket + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return held


def fresh_roles(seen: dict[int, int], nodes: list[int], in_a: list[bool], in_b: list[bool]) -> tuple[list[bool], list[bool]]:
    """Per row the sides that its node takes for the first time. A copy may be held by one filter by chance,
    and the row that both filters mean may come later, so the sides are remembered one by one."""
    out: tuple[list[bool], list[bool]] = ([], [])
    for node, a, b in zip(nodes, in_a, in_b, strict=True):
        had = seen.get(node, 0)
        new = (int(a) | 2 * int(b)) & ~had
        seen[node] = had | new
        out[0].append(bool(new & 1))
        out[1].append(bool(new & 2))
    return out


def _sets(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(node, own binary, in_a, in_b) of the nodes in ``pairs``, and by chance of a few others.

    Only documents that the filters may hold are cut into shingles; nothing is shuffled here.
    """
    context = rows.sparkSession.sparkContext
    shared = [context.broadcast(_marked(nodes.join(pairs.select(F.col(side).alias("node")).distinct(), "node").select("doc_id")))
              for side in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, seen = [s.value for s in shared], {}
        for batch in batches:
            at = batch.column("bit").to_numpy()
            held = [((bits[at >> 3] >> (at & 7)) & 1 == 1) for bits in filters]
            batch = batch.append_column("in_a", pa.array(held[0])).append_column("in_b", pa.array(held[1]))
            for part, texts in common.slices([batch.filter(pa.array(held[0] | held[1]))]):
                sets = shingles(texts, words)
                named = [node_of(s) for s in sets]
                in_a, in_b = fresh_roles(seen, named, part.column("in_a").to_pylist(), part.column("in_b").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(named, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array(in_a, pa.bool_()), pa.array(in_b, pa.bool_())], ["node", "own", "in_a", "in_b"]).filter(
                         pa.array([a or b for a, b in zip(in_a, in_b, strict=True)], pa.bool_()))

    bit = F.pmod(F.xxhash64(_id()), F.lit(1 << FILTER_BITS))
    return rows.select(bit.alias("bit"), "text").mapInArrow(run, "node long, own binary, in_a boolean, in_b boolean")


def _possible(index: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose shapes allow a link."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    shapes = (index.where(F.col("shape").isNotNull()).select("node", "shape").join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(shapes.select(F.col("node").alias("b"), F.col("shape").alias("shape_b")), "b").join(
        shapes.select(F.col("node").alias("a"), F.col("shape").alias("shape_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, SHAPE).astype(np.int64) for c in ("shape_a", "shape_b"))
            bound = np.minimum(x, y).sum(1)
            keep = 100 * bound >= percent * (x.sum(1) + y.sum(1) - bound)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "shape_a", "shape_b").mapInArrow(run, "a long, b long")


def _verified(rows: DataFrame, index: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection."""
    tried = common.stored(pairs.select("a", "b"), f"{name}-tried")
    pairs = common.stored(_possible(index, tried, percent), f"{name}-pairs")
    if pairs.isEmpty():
        return pairs
    sets = common.stored(_sets(rows, nodes, pairs, words), f"{name}-sets")
    # A node that is the pivot of many pairs is met by its partners on several keys.
    heavy = pairs.groupBy("a").count().where(F.col("count") > PIVOT_PAIRS).select("a", F.lit(PIVOT_SALTS).alias("_salts"))
    salted = pairs.join(heavy, "a", "left").withColumn(
        "_salt", F.pmod(F.xxhash64("b"), F.coalesce("_salts", F.lit(1)).cast("long"))).drop("_salts")
    left = (sets.where("in_a").withColumnRenamed("node", "a").join(heavy, "a", "left")
            .select("a", F.col("own").alias("own_a"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1)).alias("_salt")))
    right = sets.where("in_b").select(F.col("node").alias("b"), F.col("own").alias("own_b"))
    full = salted.join(right, "b").join(left, ["a", "_salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                both = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * both >= percent * (len(merged) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.stored(full.select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long"), f"{name}-links")


def _sizes_fit(percent: int) -> Column:
    return 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")


def _often_fit(size_a: str, size_b: str, often_a: str, often_b: str, percent: int) -> Column:
    """Whether frequent shingles alone can make a link. Combinations serve pairs that share no rare shingle."""
    return (100 + percent) * F.least(often_a, often_b) >= percent * (F.col(size_a) + F.col(size_b))


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links)."""
    rows = common.id_text(docs)
    index = _indexed(rows, words, percent)
    filled = index.where(F.col("size") > 0)
    salts = common.partitions_for(docs.sparkSession)
    leaf = filled.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).groupBy("node", "_salt").agg(F.min("doc_id").alias("doc_id"))
    # Nodes without any id take part under the reserved smallest one.
    nodes = common.stored(leaf.groupBy("node").agg(F.min("doc_id").alias("_first")).select(
        "node", "_first", _id("_first").alias("doc_id")), "nodes")
    tokens = filled.where(F.col("singles").isNotNull()).select("node", "size", F.posexplode("singles").alias("pos", "key"))
    by_key = Window.partitionBy("key")
    pivot = F.min(F.struct("node", "size")).over(by_key)
    single = common.stored(
        tokens.withColumn("pivot", pivot).withColumn("_last", F.max("node").over(by_key))
        .where(F.col("pivot.node") < F.col("_last"))
        .select("key", "node", "size", "pos", F.col("pivot.node").alias("pivot"), F.col("pivot.size").alias("pivot_size"))
        .distinct(), "single")
    multi_all = filled.where(F.col("combined").isNotNull()).select("node", "size", "often", F.explode("combined").alias("key"))
    # The pivot of a combination is the member with most frequent shingles: the least altered of a group of near copies.
    ends = multi_all.groupBy("key").agg(
        F.max(F.struct("often", "node", "size")).alias("pivot"), F.min("node").alias("_first"), F.max("node").alias("_last"))
    # Pivots come from the ends themselves; only the other members are joined to them.
    shared = ends.where("_first < _last")
    others = (multi_all.join(shared.select("key", "pivot"), "key").where(F.col("node") != F.col("pivot.node"))
              .select("key", "node", "size", "often", "pivot"))
    multi = common.stored(
        others.unionByName(shared.select("key", "pivot.node", "pivot.size", "pivot.often", "pivot"))
        .select("key", "node", "size", "often", F.col("pivot.node").alias("pivot"), F.col("pivot.size").alias("pivot_size"),
                F.col("pivot.often").alias("pivot_often"))
        .distinct(), "multi")

    # Round 1: members against their bucket's smallest node. Pairs that share little wait for round 2.
    to_pivot = lambda df: df.where(F.col("node") != F.col("pivot")).groupBy(
        F.col("pivot").alias("a"), F.col("node").alias("b"), F.col("pivot_size").alias("size_a"),
        F.col("size").alias("size_b")).agg(F.count("*").alias("n"))
    prefix = F.col("size_b") - F.ceil(F.col("size_b") * percent / 100) + 1
    tried = to_pivot(single).where(_sizes_fit(percent) & (4 * F.col("n") >= prefix)).union(
        to_pivot(multi.where(_often_fit("size", "pivot_size", "often", "pivot_often", percent))).where(_sizes_fit(percent)))
    # The pivot that a member meets most often; its other pivots are round 2's where still open.
    first = tried.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
    links = _verified(rows, index, nodes, first, words, percent, "first")
    labels = components(links)

    # Round 2: buckets that still hold several components, across them.
    named = lambda df: df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named(single)
    open_keys = mixed.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("key")
    mixed = common.stored(mixed.join(open_keys, "key", "left_semi").select("key", "node", "size", "pos", "label"), "open")
    side = lambda df, s: df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "key"])
    need = F.ceil((F.col("size_a") + F.col("size_b")) * F.lit(percent) / F.lit(100 + percent))
    rest = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    across = (
        side(mixed, "a").join(side(mixed, "b"), "key")
        .where((F.col("label_a") < F.col("label_b")) & _sizes_fit(percent)
               & (F.least("pos_a", "pos_b") + rest >= need))
        .groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "size_a", "size_b")
        .agg(F.count("*").alias("n"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"))
        # All shared shingles before the last shared position are counted; behind it lies at most the rest.
        .where(F.col("n") + rest - 1 >= need).select("a", "b"))
    crowd = named(multi)
    counted = crowd.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = counted.groupBy("key").agg(F.max_by("label", "n").alias("_most"), F.count("*").alias("_labels")).where("_labels > 1")
    crowd = common.stored(crowd.join(largest.select("key", "_most"), "key").select("key", "node", "size", "often", "label", "_most"), "crowd")
    # Members of a group share many combinations. A key among the least ones of both members was met before,
    # and since the pair meets on every open key that it shares, only later keys are left out.
    heads = crowd.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, HEADS).alias("heads"))
    crowd = common.stored(crowd.withColumn("out", F.col("label") != F.col("_most")).drop("_most").join(heads, "node"), "crowd-heads")
    met = F.arrays_overlap(F.filter("heads_a", lambda k: k < F.col("key")), F.col("heads_b"))
    over = (side(crowd.where("out"), "a").join(side(crowd, "b"), "key")
            .where((F.col("label_a") != F.col("label_b")) & _sizes_fit(percent)
                   & _often_fit("size_a", "size_b", "often_a", "often_b", percent)
                   & (~F.col("out_b") | (F.col("node_a") < F.col("node_b"))) & ~met)
            .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))
    second = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(over).distinct()
    more = _verified(rows, index, nodes, second, words, percent, "second")
    labels = components(links.union(more))

    best = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = best.groupBy("label").agg(F.min("_first").alias("component_id"))
    verdict = best.join(lowest, "label").select("node", "component_id")
    # Down to the rows by (node, salt): a set that many rows share is spread over the salts.
    down = leaf.select("node", "_salt").join(verdict, "node")
    return (index.select("doc_id", "node", "size", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("_salt"))
            .join(down, ["node", "_salt"], "left")
            .select("doc_id", F.col("size").alias("n_shingles"),
                    F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The row of each component with its smallest doc_id (rows with a null id stay), all columns kept."""
    found = classes(docs, words, percent)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"), words=4, percent=85)
