"""Approximate nearest neighbours by cross-polytope hashing.

Rows with equal vectors are one node, which carries its ``top + 1`` smallest ids. Each of TABLES hash
tables turns unit vectors by fast pseudo-rotations (random signs and Hadamard transforms, three times)
and takes the nearest signed axis of each of several turns. All axes but the last name a cell, the last
one a place in the cell; how many axes, and of how many coordinates the first turn keeps, follows the
number of nodes, so buckets hold about BUCKET of them at any size.

A query probes many buckets of each table, in order of the squared distance by which their axes miss its
largest coordinates. How many is measured, not guessed: for at most SAMPLE query vectors (chosen by a
hash; this sample is the only one) the exact neighbours are found in one pass over all nodes, and the
number of probes is the smallest that would have reached RECALL of them. If that takes every bucket, the
search is exhaustive.

Nodes go to their cells with an 8-bit code; a query goes once to each cell that it probes, with the
places it asks for. Crowded cells are cut into parts by a hash of the node and their queries are sent to
all parts, so no cell is gathered whole. A query carries its reach: the distance of its (top + 1)-th nearest
among REACH_NODES nodes (chosen by a hash), which the true one cannot exceed, so candidates whose code is
provably farther end there. The others are ranked by their codes; per query the best SHORT of all cells
are fetched with their original vectors and ranked exactly, in double precision.

Vectors of different lengths are not comparable: each length is an index of its own.

Defined results: rows whose id or vector is null, whose vector is empty, all zero or holds a null or
non-finite component take no part; repeated rows count once, and of rows with one id but several vectors
the bytewise smallest vector counts; a query never finds its own id; ties go to the smaller id; with
fewer candidates than asked for all are returned; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swellcast.llm import common

TOP = 10
TABLES = 6
BUCKET = 2.0
SAMPLE = 192
RECALL = 0.96
#: Candidates per query that are ranked exactly.
SHORT = 48
#: Nodes that give each query an upper bound of the distance that matters.
REACH_NODES = 2_048
#: Nodes of a cell, or of a part of a crowded one.
PART = 8_192
PAIRS_AT_ONCE = 1 << 18
#: Bytes of cells that a task ranks together.
GATHER = 1 << 24


# -- hashing ---------------------------------------------------------------------------------------------
def hadamard(rows: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the length is a power of two."""
    n, step = rows.shape[1], 1
    while step < n:
        pairs = rows.reshape(len(rows), -1, 2, step)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(rows), n)
        step *= 2
    return rows / np.float32(n**0.5)


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, padded with zeros to a power of two."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    room = 1 << max(0, vectors.shape[1] - 1).bit_length()
    return np.pad(vectors.astype(np.float32), ((0, 0), (0, room - vectors.shape[1])))


class Plan:
    """Tables for vectors of one length: turns per table, coordinates the first turn keeps, and probes."""

    def __init__(self, length: int, nodes: int):
        self.length, self.room = length, 1 << max(0, length - 1).bit_length()
        wanted, self.turns, self.first = max(1.0, nodes / BUCKET), 1, self.room
        while (2 * self.room) ** self.turns < wanted and self.turns < 8:
            self.turns += 1
        # The first turn keeps the fewest coordinates (a power of two) that give enough buckets.
        while self.first > 1 and self.first * (2 * self.room) ** (self.turns - 1) >= wanted:
            self.first //= 2
        if self.turns == 1:
            self.first = self.room
        self.probes = self.buckets

    @property
    def buckets(self) -> int:
        return 2 * self.first * (2 * self.room) ** (self.turns - 1)

    def misses(self, rows: np.ndarray, table: int, turn: int) -> np.ndarray:
        """For every signed axis the squared distance by which it misses the row's largest coordinate."""
        for i in range(3):
            signs = np.random.default_rng((11, self.length, table, turn, i)).choice(np.float32([-1, 1]), self.room)
            rows = hadamard(rows * signs)
        rows = rows[:, : self.first] if turn == 0 else rows
        both = np.concatenate([rows, -rows], axis=1)
        return (both.max(1, keepdims=True) - both) ** 2

    def bucket(self, rows: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        for turn in range(self.turns):
            miss = self.misses(rows, table, turn)
            out = out * miss.shape[1] + miss.argmin(1)
        return out

    def probed(self, rows: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The ``probes`` first buckets of each row (all, if there are fewer), in order."""
        at, cost = np.zeros((len(rows), 1), np.int64), np.zeros((len(rows), 1), np.float32)
        for turn in range(self.turns):
            miss = self.misses(rows, table, turn)
            cost = (cost[:, :, None] + miss[:, None, :]).reshape(len(rows), -1)
            at = (at[:, :, None] * miss.shape[1] + np.arange(miss.shape[1])).reshape(len(rows), -1)
            if cost.shape[1] > probes:
                best = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
                at, cost = np.take_along_axis(at, best, 1), np.take_along_axis(cost, best, 1)
        return np.take_along_axis(at, np.argsort(cost, axis=1, kind="stable"), 1)

    def cell(self, bucket: np.ndarray, table: int) -> np.ndarray:
        """One long per table and cell of this length."""
        with np.errstate(over="ignore"):
            seed = common.mix64(np.array([self.length * 64 + table], np.uint64))
            return common.mix64((bucket // (2 * self.room)).astype(np.uint64) ^ seed).view(np.int64)


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit components and the scale that gives them back, about."""
    scale = np.abs(vectors).max(1) / 127
    return np.rint(vectors / scale[:, None]).astype(np.int8), scale.astype(np.float64)


# -- vectors ---------------------------------------------------------------------------------------------
def _matrix(column: pa.Array, picked: np.ndarray, length: int, wide: bool) -> np.ndarray:
    kind = np.dtype("<f8" if wide else "<f4")
    return np.frombuffer(b"".join(column.take(pa.array(picked)).to_pylist()), kind).reshape(len(picked), length).astype(np.float64)


def _by_length(column: pa.Array, wide: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, vectors as doubles) of packed vectors."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False) // (8 if wide else 4)
    for length in np.unique(lengths).tolist():
        picked = np.flatnonzero(lengths == length)
        yield length, picked, _matrix(column, picked, length, wide)


def _packed(wide: bool):
    """Valid vectors as bytes."""
    kind = np.dtype("<f8" if wide else "<f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            flat = column.flatten()
            value = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.r_[0, np.cumsum(sizes)]
            bad = np.r_[0, np.cumsum(~np.isfinite(value))]
            some = np.r_[0, np.cumsum(value != 0)]
            good = (bad[edges[1:]] == bad[edges[:-1]]) & (some[edges[1:]] > some[edges[:-1]])
            rows = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)),
                 pa.array([value[edges[i] : edges[i + 1]].tobytes() for i in rows.tolist()], pa.binary())], ["vec_id", "vec"])

    return run


def packed(rows: DataFrame, id_col: str, vec_col: str, wide: bool) -> DataFrame:
    """(vec_id, vec): one row per id with a usable vector."""
    kind = "array<double>" if wide else "array<float>"
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec")).where(
        "vec_id IS NOT NULL AND vec IS NOT NULL")
    return given.mapInArrow(_packed(wide), "vec_id long, vec binary").groupBy("vec_id").agg(F.min("vec").alias("vec"))


# -- probes ----------------------------------------------------------------------------------------------
def _exact_sample(sample: dict[int, np.ndarray], top: int, wide: bool):
    """A partition's exact neighbours of the sampled queries: (length, query, distance, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: (np.full((len(q), top), np.inf), np.zeros((len(q), top), object)) for n, q in sample.items()}
        for batch in batches:
            column = batch.column("vec")
            for length, picked, rows in _by_length(column, wide):
                if length not in sample:
                    continue
                query, (far, held) = sample[length], best[length]
                d2 = (query**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * query @ rows.T
                same = (query[:, :1] == rows[None, :, 0]) & (d2 < 1e-9 * (query**2).sum(1)[:, None])
                d2[same] = np.inf  # the query itself
                near = np.argpartition(d2, min(top, d2.shape[1]) - 1, axis=1)[:, :top]
                both = np.concatenate([far, np.take_along_axis(d2, near, 1)], axis=1)
                keep = np.argsort(both, axis=1, kind="stable")[:, :top]
                new = np.concatenate([held, np.array(column.take(pa.array(picked[near.ravel()])).to_pylist(), object).reshape(near.shape)], axis=1)
                best[length] = np.take_along_axis(both, keep, 1), np.take_along_axis(new, keep, 1)
        out = [(n, q, float(d), v) for n, (far, held) in best.items() for q in range(len(far))
               for d, v in zip(far[q], held[q], strict=True) if np.isfinite(d)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.binary()))],
            ["length", "query", "distance", "vec"])

    return run


def plans_for(nodes: DataFrame, queries: DataFrame, top: int, wide: bool) -> dict[int, Plan]:
    """A plan per vector length, with as many probes as the sampled queries need."""
    each = 8 if wide else 4
    plans = {r.n // each: Plan(r.n // each, r["count"]) for r in nodes.groupBy(F.octet_length("vec").alias("n")).count().collect()}
    at = Window.partitionBy(F.octet_length("vec")).orderBy(F.xxhash64("vec"), "vec")
    sample: dict[int, list] = {}
    for r in queries.withColumn("at", F.row_number().over(at)).where(F.col("at") <= SAMPLE).toLocalIterator():
        if plans[len(r.vec) // each].turns > 1:
            sample.setdefault(len(r.vec) // each, []).append(np.frombuffer(bytes(r.vec), "<f8" if wide else "<f4").astype(np.float64))
    drawn = {n: np.stack(v) for n, v in sample.items()}
    if not drawn:
        return plans
    best = Window.partitionBy("length", "query").orderBy("distance")
    found: dict[int, list] = {}
    for r in (nodes.mapInArrow(_exact_sample(drawn, top, wide), "length long, query long, distance double, vec binary")
              .withColumn("at", F.row_number().over(best)).where(F.col("at") <= top).toLocalIterator()):
        found.setdefault(r.length, []).append((r["query"], np.frombuffer(bytes(r.vec), "<f8" if wide else "<f4").astype(np.float64)))
    for length, pairs in found.items():
        plan, query = plans[length], np.array([q for q, _ in pairs])
        near, asked = units(np.stack([v for _, v in pairs])), units(drawn[length])
        # The probe at which each true neighbour would be met first, over all tables.
        limit, needed = 256, None
        while True:
            met = np.full(len(pairs), limit, np.int64)
            for table in range(TABLES):
                order, own = plan.probed(asked, table, limit), plan.bucket(near, table)
                for q in np.unique(query).tolist():
                    mine = np.flatnonzero(query == q)
                    hit = order[q][None, :] == own[mine][:, None]
                    met[mine] = np.minimum(met[mine], np.where(hit.any(1), hit.argmax(1), limit))
            met.sort()
            needed = int(met[min(len(met) - 1, int(np.ceil(RECALL * len(met))) - 1)]) + 1
            if needed <= limit or limit >= plan.buckets:
                break
            limit = min(limit * 4, plan.buckets)
        plan.probes = min(needed, plan.buckets)
    return plans


# -- cells -----------------------------------------------------------------------------------------------
_CELLS = "cell long, part int, kind int, id long, places binary, code binary, scale double, reach double"
_NAMES = ["cell", "part", "kind", "id", "places", "code", "scale", "reach"]


def _rows(cell, part, kind: int, ids, places, code: np.ndarray, scale, reach) -> pa.RecordBatch:
    n = len(cell)
    return pa.RecordBatch.from_arrays(
        [pa.array(cell, pa.int64()), pa.array(part, pa.int32()), pa.array(np.full(n, kind), pa.int32()), pa.array(ids, pa.int64()),
         pa.array(places, pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale, pa.float64()),
         pa.array(reach, pa.float64())], _NAMES)


def _node_cells(plans: dict[int, Plan], wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            for length, picked, rows in _by_length(batch.column("vec"), wide):
                plan, unit, (code, scale) = plans[length], units(rows), codes(rows)
                for table in range(TABLES):
                    bucket = plan.bucket(unit, table)
                    place = (bucket % (2 * plan.room)).astype("<u4")
                    salt = (common.mix64(ids[picked].astype(np.uint64)) >> np.uint64(33)).astype(np.int32)
                    yield _rows(plan.cell(bucket, table), salt, 0, ids[picked], [p.tobytes() for p in place], code, scale,
                                np.zeros(len(picked)))

    return run


def _reach(rows: np.ndarray, some: np.ndarray | None, nodes: int) -> np.ndarray:
    """Per row the distance of the ``nodes``-th nearest of ``some``; infinite if there are fewer."""
    if some is None or len(some) < nodes:
        return np.full(len(rows), np.inf)
    d2 = (rows**2).sum(1)[:, None] + (some**2).sum(1)[None, :] - 2 * rows @ some.T
    # The slack covers rounding of the expanded form.
    slack = 1e-9 * ((rows**2).sum(1) + (some**2).sum(1).max())
    return np.sqrt(np.maximum(np.partition(d2, nodes - 1, axis=1)[:, nodes - 1] + slack, 0))


def _query_cells(plans: dict[int, Plan], some: dict[int, np.ndarray], nodes: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            for length, picked, rows in _by_length(batch.column("vec"), wide):
                plan, unit, (code, scale) = plans[length], units(rows), codes(rows)
                for begin in range(0, len(picked), 256):
                    part = slice(begin, begin + 256)
                    reach = _reach(rows[part], some.get(length), nodes)
                    for table in range(TABLES):
                        bucket = np.sort(plan.probed(unit[part], table, plan.probes), axis=1)
                        cell, place = bucket // (2 * plan.room), (bucket % (2 * plan.room)).astype("<u4")
                        row = np.repeat(np.arange(len(bucket)), bucket.shape[1])
                        flat = cell.ravel()
                        head = np.flatnonzero(np.r_[True, (np.diff(flat) != 0) | (np.diff(row) != 0)])
                        parts = np.split(place.ravel(), head[1:])
                        at = begin + row[head]
                        yield _rows(plan.cell(flat[head] * 2 * plan.room, table), np.zeros(len(head), np.int32), 1, ids[picked[at]],
                                    [p.tobytes() for p in parts], code[at], scale[at], reach[at - begin])

    return run


def _ranked(short: int):
    """Candidates of sorted cells: nodes of a cell come before its queries, and stay until the cell ends."""

    def best(node: pa.RecordBatch, query: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spot = lambda b: np.stack([b.column("cell").to_numpy(), b.column("part").to_numpy().astype(np.int64)], 1)
        _, own = np.unique(np.concatenate([spot(node), spot(query)]), axis=0, return_inverse=True)
        sizes = [pc.binary_length(b.column("code")).to_numpy(zero_copy_only=False) for b in (node, query)]
        for length in np.unique(sizes[1]).tolist():
            n, q = (np.flatnonzero(s == length) for s in sizes)
            if not len(n):
                continue
            code, scale = [], []
            for b, picked in ((node, n), (query, q)):
                code.append(np.frombuffer(b"".join(b.column("code").take(pa.array(picked)).to_pylist()), np.int8).reshape(-1, length).astype(np.float32))
                scale.append(b.column("scale").to_numpy()[picked])
            squares = [(c.astype(np.float64) ** 2).sum(1) * s**2 for c, s in zip(code, scale, strict=True)]
            room = 1 << 33
            key = own[: node.num_rows][n] * room + np.frombuffer(b"".join(node.column("places").take(pa.array(n)).to_pylist()), "<u4")
            order = np.argsort(key, kind="stable")
            key = key[order]
            reach = query.column("reach").to_numpy()[q]
            asks, who = np.unique(query.column("id").to_numpy()[q], return_inverse=True)
            places = [np.frombuffer(p, "<u4") for p in query.column("places").take(pa.array(q)).to_pylist()]
            asker = np.repeat(np.arange(len(q)), [len(p) for p in places])
            probe = own[node.num_rows :][q][asker] * room + np.concatenate(places)
            left = np.searchsorted(key, probe)
            count = np.searchsorted(key, probe, side="right") - left
            some = count > 0
            asker, left, count = asker[some], left[some], count[some]
            ends, begin, held = np.cumsum(count), 0, []
            while begin < len(count):
                base = ends[begin - 1] if begin else 0
                stop = max(int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")), begin + 1)
                a = np.repeat(asker[begin:stop], count[begin:stop])
                c = order[common.ranges(left[begin:stop], count[begin:stop])]
                d2 = squares[1][a] + squares[0][c] - 2 * np.einsum("ij,ij->i", code[1][a], code[0][c]).astype(np.float64) * scale[1][a] * scale[0][c]
                # A component of a code is off by half its scale at most.
                far = reach[a] + (scale[1][a] + scale[0][c]) * (length**0.5 / 2)
                near = d2 <= far * far * (1 + 1e-5)
                held.append(_first(who[a[near]], c[near], d2[near], short))
                begin = stop
            if held:
                who, c, d2 = _first(*(np.concatenate(x) for x in zip(*held, strict=True)), short)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asks[who]), node.column("id").take(pa.array(n[c])), pa.array(np.maximum(d2, 0.0))],
                    ["query", "node", "about"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None
        for batch in _gathered(batches):
            kind = batch.column("kind").to_numpy()
            node = batch.filter(pa.array(kind == 0))
            query = batch.filter(pa.array(kind == 1))
            node = pa.concat_batches([kept, node]) if kept is not None else node
            if query.num_rows:
                yield from best(node, query)
            # Only the last cell can go on in the next batch.
            last = batch.slice(batch.num_rows - 1)
            kept = node.filter(pc.and_(pc.equal(node.column("cell"), last.column("cell")[0]), pc.equal(node.column("part"), last.column("part")[0])))

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about GATHER bytes: the more cells are ranked together, the fewer candidates of a query go on."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= GATHER:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _first(a: np.ndarray, c: np.ndarray, d2: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every a the ``short`` nearest pairs."""
    order = np.lexsort((c, d2, a))
    a, c, d2 = a[order], c[order], d2[order]
    head = np.flatnonzero(np.r_[True, np.diff(a) != 0][: len(a)])
    keep = np.arange(len(a)) - np.repeat(head, np.diff(np.r_[head, len(a)])) < short
    return a[keep], c[keep], d2[keep]


def _exact(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for (_, picked, a), (_, _, b) in zip(_by_length(batch.column("asked"), wide), _by_length(batch.column("vec"), wide), strict=True):
                out[picked] = np.sqrt(((a - b) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(out), batch.column("ids")], ["query", "score", "ids"])

    return run


def nearest(rows: DataFrame, every: int, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows of every row whose id ``every`` divides."""
    element = rows.schema[vec_col].dataType.elementType.simpleString()
    wide = element != "float"
    unique = packed(rows, id_col, vec_col, wide)
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    nodes = common.stored(
        unique.withColumn("_at", F.row_number().over(by_id)).where(F.col("_at") <= top + 1).groupBy("vec").agg(
            F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    asking = common.stored(packed(rows.where(F.col(id_col).cast("long") % every == 0), id_col, vec_col, wide), "asking")
    queries = common.stored(asking.groupBy("vec").agg(F.min("vec_id").alias("node")), "queries")
    plans = plans_for(nodes, queries, top, wide)

    members = nodes.select("node", "vec").mapInArrow(_node_cells(plans, wide), _CELLS)
    crowded = (members.groupBy("cell").count().where(F.col("count") > PART)
               .select("cell", F.ceil(F.col("count") / PART).cast("int").alias("parts")))
    crowded = common.stored(crowded, "crowded")
    parts = F.coalesce("parts", F.lit(1))
    members = members.join(crowded, "cell", "left").withColumn("part", F.pmod("part", parts)).drop("parts")
    each, some = 8 if wide else 4, {}
    # At most REACH_NODES vectors of each length.
    by_hash = Window.partitionBy(F.octet_length("vec")).orderBy(F.xxhash64("vec"), "vec")
    for r in nodes.select("vec").withColumn("_at", F.row_number().over(by_hash)).where(F.col("_at") <= REACH_NODES).toLocalIterator():
        some.setdefault(len(r.vec) // each, []).append(np.frombuffer(bytes(r.vec), "<f8" if wide else "<f4").astype(np.float64))
    some = {n: np.stack(v) for n, v in some.items()}
    asked = (queries.mapInArrow(_query_cells(plans, some, top + 1, wide), _CELLS).join(crowded, "cell", "left")
             .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts"))
    near = members.select(_NAMES).unionByName(asked.select(_NAMES)).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    near = near.mapInArrow(_ranked(SHORT), "query long, node long, about double")
    # Several tables find the same pair with the same distance: it takes one rank.
    order = Window.partitionBy("query").orderBy("about", "node")
    near = near.withColumn("_at", F.dense_rank().over(order)).where(F.col("_at") <= SHORT).groupBy("query", "node").agg(F.min("about"))
    pairs = near.select("query", "node").join(nodes, "node").join(
        queries.select(F.col("node").alias("query"), F.col("vec").alias("asked")), "query")
    exact = pairs.select("query", "asked", "vec", "ids").mapInArrow(_exact(wide), "query long, score double, ids array<long>")
    by_score = Window.partitionBy("query").orderBy("score", F.col("ids")[0])
    hits = (exact.withColumn("_at", F.row_number().over(by_score)).where(F.col("_at") <= top + 1)
            .select("query", "score", F.explode("ids").alias("vec_id")))
    hits = (hits.withColumn("_at", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id")))
            .where(F.col("_at") <= top + 1).groupBy("query")
            .agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("hits")))
    hits = hits.join(queries.withColumnRenamed("node", "query"), "query").select("vec", "hits")
    own = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, top)
    return (asking.withColumnRenamed("vec_id", "query_id").join(hits, "vec").select("query_id", F.posexplode(own).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")))


def op11_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), every=100)
