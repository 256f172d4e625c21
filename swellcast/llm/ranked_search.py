"""Ranked lexical search over posting lists cut into geometric blocks.

The items are cut into blocks of bounded text size; each block is one pass. A pass tokenises every
document once and stores, per document, its number of terms and the counts of the terms that the
block's items hold. N, L and the document frequencies are sums over that table, and so a term's weight
and its share of a document's score (its impact) are plain integers.

The stored rows are read back in shards of bounded size. Each shard lays out an impact matrix and its
posting lists. The lists are taken by falling weight. A list's documents are clustered by similarity
(random projections of their impact vectors, nearest of a few of them as centres), and each cluster is
a block with the coordinatewise maximum of its impact vectors as summary. An item's query vector times
the summary bounds the score of every document of the block from above; a block is skipped only if the
bound is below the item's threshold, and the rest of an item's lists only if the sum of their largest
impacts is. All other documents are scored exactly and keep the item's threshold rising. The first
thresholds come from a first search of each shard through the item's heaviest short lists: the k-th
best score found so is reached by k documents, so nothing below it can be in the result. Bounds are
sums of the same integers that make the scores, so the result is exact.

score = sum over the item's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 12 m)),
w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + (25 n N) div L.

Defined results: terms are runs of ASCII letters and digits and of everything outside ASCII, A-Z
lower-cased; null, empty and termless texts have none and rank nowhere, items without terms get no
rows; a repeated document row ranks on its own, equal rows one after the other; null doc_ids come last
among equal scores; of benchmark rows with one item_id the smallest text counts; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swellcast.llm import common

TOP = 20
#: Text bytes of the items of one pass: their terms and query vectors are what a pass broadcasts.
BLOCK_BYTES = 1_000_000
#: Cells of a shard's impact matrix (documents times terms of the pass).
SHARD_CELLS = 1 << 24
#: Shorter posting lists are one block without a summary.
LEAST_LIST = 64
#: Documents of a geometric block, about.
BLOCK_DOCS = 48
SKETCH = 32
#: Lists, and documents of each, that give the first thresholds.
SEED_LISTS, SEED_DOCS = 6, 256
#: ASCII upper case to lower case; other ASCII but digits and letters to a space; bytes above ASCII stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Items:
    """The items of a pass: their terms and how often each item holds each."""

    def __init__(self, rows: list[tuple[object, str]]):
        held = [(i, Counter(terms_of(t))) for i, t in rows]
        self.ids = [i for i, c in held if c]
        self.vocabulary = {t: n for n, t in enumerate(sorted({t for _, c in held for t in c}))}
        self.terms = [np.array([self.vocabulary[t] for t in c], np.int64) for _, c in held if c]
        self.times = [np.array(list(c.values()), np.int64) for _, c in held if c]


# -- counts of a pass ------------------------------------------------------------------------------------
def _counted(shared):
    """Per document with terms: its id, number of terms, and (term, tf) of the items' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = shared.value.vocabulary.get, max(1, len(shared.value.vocabulary))
        for batch, texts in common.slices(batches):
            counts, parts = np.zeros(len(texts), np.int64), []
            for d, text in enumerate(texts):
                terms = terms_of(text)
                counts[d] = len(terms)
                own = np.fromiter((get(t, -1) for t in terms), np.int64, len(terms))
                parts.append(own[own >= 0] + d * size)
            key, tf = np.unique(np.concatenate(parts), return_counts=True)
            edges = pa.array(np.searchsorted(key, np.arange(len(texts) + 1) * size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(edges, pa.array(key % size, pa.int32())),
                 pa.ListArray.from_arrays(edges, pa.array(tf, pa.int32()))],
                ["doc_id", "n", "terms", "tfs"]).filter(pa.array(counts > 0))

    return run


def _frequencies(size: int):
    """Document frequencies of a partition, as (term, df)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["term", "df"])

    return run


# -- a shard ---------------------------------------------------------------------------------------------
class Shard:
    """Impact matrix and posting lists of some documents."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, n: np.ndarray, term: np.ndarray, tf: np.ndarray, edges: np.ndarray,
                 weight: np.ndarray, documents: int, length: int):
        # Tasks score in the order of ids, so ties need no second look; null ids come last.
        self.ids, self.known = ids, known
        doc = np.repeat(np.arange(len(ids)), np.diff(edges))
        m = np.array([75 + 25 * int(x) * documents // length for x in n], np.int64)[doc]
        tf = tf.astype(np.int64)
        self.impact = np.zeros((len(ids), len(weight)), np.int32)
        self.impact[doc, term] = 1_000_000_000 * tf // (1000 * tf + 12 * m)
        order = np.argsort(term, kind="stable")
        self.posted, self.first = doc[order], np.r_[0, np.cumsum(np.bincount(term, minlength=len(weight)))]
        self.weight = weight
        self.largest = self.impact.max(0).astype(np.int64) * weight if len(ids) else np.zeros(len(weight), np.int64)
        self._sketch: np.ndarray | None = None

    def docs(self, term: int) -> np.ndarray:
        return self.posted[self.first[term] : self.first[term + 1]]

    def sketch(self) -> np.ndarray:
        """Unit vectors of random projections of the weighted impacts."""
        if self._sketch is None:
            signs = np.random.default_rng(13).choice(np.float32([-1, 1]), (len(self.weight), SKETCH))
            flat = self.impact.astype(np.float32) @ (signs * self.weight[:, None].astype(np.float32))
            self._sketch = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-30)
        return self._sketch

    def blocks(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a list ordered by cluster, and where each cluster starts."""
        centres = docs[:: BLOCK_DOCS]
        near = np.argmax(self.sketch()[docs] @ self.sketch()[centres].T, axis=1)
        order = np.argsort(near, kind="stable")
        return docs[order], np.flatnonzero(np.r_[True, np.diff(near[order]) != 0])

    def scores(self, docs: np.ndarray, terms: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.impact[docs[:, None], terms[None, :]].astype(np.int64) @ query


class _Best:
    """The k best documents of an item so far; the threshold never falls."""

    def __init__(self, top: int, threshold: int):
        self.top, self.threshold = top, max(threshold, 1)
        self.docs, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.threshold
        docs, scores = np.r_[self.docs, docs[good]], np.r_[self.scores, scores[good]]
        order = np.lexsort((docs, -scores))[: self.top]
        self.docs, self.scores = docs[order], scores[order]
        if len(order) == self.top:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def seeds(shard: Shard, items: Items, top: int) -> Iterator[_Best]:
    """Per item its best documents among those of its heaviest short lists."""
    for terms, times in zip(items.terms, items.times, strict=True):
        best = _Best(top, 1)
        sizes = shard.first[terms + 1] - shard.first[terms]
        usable = terms[(sizes > 0) & (sizes <= SEED_DOCS)]
        usable = usable[np.argsort(-shard.weight[usable], kind="stable")][:SEED_LISTS]
        if len(usable):
            docs = np.unique(np.concatenate([shard.docs(t) for t in usable]))
            best.add(docs, shard.scores(docs, terms, times * shard.weight[terms]))
        yield best


def search(shard: Shard, items: Items, top: int, thresholds: list[int]) -> list[_Best]:
    """Per item its best documents of the shard; a document below the item's threshold may be missing."""
    best = [_Best(top, t) for t in thresholds]
    query = np.zeros((len(items.ids), len(shard.weight)), np.int64)
    for i, (terms, times) in enumerate(zip(items.terms, items.times, strict=True)):
        query[i, terms] = times * shard.weight[terms]
    order = np.argsort(-shard.weight, kind="stable")
    # What an item's lists from here on can add up to at most.
    rest = np.array([int(q[t] @ shard.impact[:, t].max(0, initial=0).astype(np.int64)) for q, t in zip(query, items.terms, strict=True)])
    most = shard.impact.max(0, initial=0).astype(np.int64)
    holders = [[] for _ in shard.weight]
    for i, terms in enumerate(items.terms):
        for t in terms.tolist():
            holders[t].append(i)
    seen = np.zeros((len(items.ids), len(shard.ids)), bool)
    for t in order.tolist():
        docs = shard.docs(t)
        own = [i for i in holders[t] if rest[i] >= best[i].threshold] if len(docs) else []
        if own:
            starts, bounds = np.zeros(1, np.int64), None
            if len(docs) >= LEAST_LIST:
                docs, starts = shard.blocks(docs)
                columns = np.unique(np.concatenate([items.terms[i] for i in own]))
                summary = np.maximum.reduceat(shard.impact[docs[:, None], columns[None, :]], starts, axis=0)
                bounds = summary.astype(np.float64) @ query[np.ix_(own, columns)].T.astype(np.float64)
            sizes = np.diff(np.r_[starts, len(docs)])
            for k, i in enumerate(own):
                # The slack covers rounding of sums beyond 2^53.
                part = docs if bounds is None else docs[np.repeat(bounds[:, k] * (1 + 1e-9) >= best[i].threshold, sizes)]
                part = part[~seen[i, part]]
                seen[i, part] = True
                if len(part):
                    best[i].add(part, shard.scores(part, items.terms[i], query[i, items.terms[i]]))
        for i in holders[t]:
            rest[i] -= query[i, t] * most[t]
    return best


# -- jobs ------------------------------------------------------------------------------------------------
def _shards(batches: Iterator[pa.RecordBatch], weight: np.ndarray, documents: int, length: int) -> Iterator[Shard]:
    rows, held = max(1, SHARD_CELLS // max(1, len(weight))), []

    def made(parts: list[pa.RecordBatch]) -> Shard:
        table = pa.Table.from_batches(parts).combine_chunks().sort_by([("doc_id", "ascending")])
        terms, ids = table["terms"].combine_chunks(), table["doc_id"]
        edges = np.r_[0, np.cumsum(pc.list_value_length(terms).to_numpy())]
        return Shard(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), table["n"].to_numpy(), terms.flatten().to_numpy(),
                     table["tfs"].combine_chunks().flatten().to_numpy(), edges, weight, documents, length)

    size = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - size)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(part.num_rows)
            if size == rows:
                yield made(held)
                held, size = [], 0
    if size:
        yield made(held)


def _pass(docs: DataFrame, items: Items, top: int) -> DataFrame:
    """(item number, doc_id, score) of the best documents of the items of one pass, each with its rank."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    counted = common.stored(docs.mapInArrow(
        _counted(shared), "doc_id long, n long, terms array<int>, tfs array<int>"), "postings")
    size = len(items.vocabulary)
    documents, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for r in counted.select("terms").mapInArrow(_frequencies(size), "term long, df long").groupBy("term").agg(
            F.sum("df").alias("df")).toLocalIterator():
        df[r.term] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, weight, documents, length):
            found = [b.scores for b in seeds(shard, shared.value, top)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64()), pa.array(np.concatenate(found))],
                ["item", "score"])

    at_top = Window.partitionBy("item").orderBy(F.desc("score"))
    known = (counted.mapInArrow(first, "item long, score long").withColumn("rank", F.row_number().over(at_top))
             .where(F.col("rank") <= top).where(F.col("rank") == top))
    thresholds = [1] * len(items.ids)
    for r in known.toLocalIterator():
        thresholds[r["item"]] = r["score"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, weight, documents, length):
            found = search(shard, shared.value, top, thresholds)
            at = np.concatenate([b.docs for b in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(found)), [len(b.docs) for b in found]), pa.int64()),
                 pa.array(shard.ids[at], mask=~shard.known[at]), pa.array(np.concatenate([b.scores for b in found]))],
                ["item", "doc_id", "score"])

    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (counted.mapInArrow(best, "item long, doc_id long, score long")
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))


def ranked(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents by score."""
    docs = common.id_text(docs)
    items = (benchmark.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min(common.whole_text()).alias("text")))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes, kind = max(1, math.ceil(total / BLOCK_BYTES)), benchmark.schema["item_id"].dataType
    names = f"item long, item_id {kind.simpleString()}"
    out = docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("item_id").toLocalIterator()
        block = Items([(r.item_id, r.text) for r in rows])
        if not block.ids:
            continue
        own = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), names)
        found = _pass(docs, block, top).join(F.broadcast(own), "item").select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(common.stored(found, "ranked") if passes > 1 else found)
    return out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The same ranks in DuckDB's dialect.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS t
  FROM documents),
docs AS (SELECT doc_id, r, len(t)::BIGINT AS n, t FROM words WHERE len(t) > 0),
total AS (SELECT count(*)::HUGEINT AS n_docs, sum(n)::HUGEINT AS n_terms FROM docs),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
query AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
held AS (SELECT r, doc_id, n, unnest(t) AS term FROM docs),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM held SEMI JOIN query USING (term) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM tf JOIN query USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id, r)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
