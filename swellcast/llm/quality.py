"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the bag of its words, its pairs of adjacent words and the character n-grams of its
words (with their borders), each hashed into one of ``BUCKETS`` learned vectors; the vectors are
averaged, words and pairs counting ``WORD_WEIGHT`` times, and a softmax layer gives the two class
probabilities. A pair's hash is the exclusive or of its words' hashes, so any repeated word falls
into one and the same bucket. Training uses at most ``MAX_TRAIN`` labelled documents, chosen by
a hash of their id, whole texts each, in one task of its own. The model has a fixed size (``BUCKETS``
by ``DIM`` floats). For scoring, softmax over an average is linear in the vectors, so one number per
bucket is broadcast and every document is one pass of segmented sums over its whole text.

Only the text is an input of the score. Defined results: null, empty and blank texts have no
features and get the bias alone; label rows that are null, not 0 or 1, or contradict each other for
an id are not learned from; without labels every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellcast.llm import common

BUCKETS = 1 << 16
DIM = 8
NGRAMS = (2, 3, 4)
WORD_WEIGHT = 8
MAX_TRAIN = 3_000
EPOCHS = 5
BATCH = 32
RATE = 0.5
_P = np.uint32(0x01000193)


def _bucket(x: np.ndarray) -> np.ndarray:
    """The upper bits of a mixed hash."""
    x = x ^ (x >> np.uint32(13))
    return ((x * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the document index and the weight of each."""
    joined = "\n" + "\n".join(texts) + "\n"
    char = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.r_[0, np.repeat(np.arange(len(texts), dtype=np.int32), sizes)].astype(np.int32)
    space = (char == 32) | ((char >= 9) & (char <= 13))
    char = np.where(space, np.uint32(32), char)
    out, owner, heavy = [], [], 0
    with np.errstate(over="ignore"):
        # Words: positional hash summed over each run of non-spaces.
        edge = np.diff(np.r_[1, space.astype(np.int8), 1])
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(begin):
            spot = np.arange(len(char), dtype=np.uint32)
            spot[~space] -= np.repeat(begin, end - begin).astype(np.uint32)
            mixed = (char * np.uint32(0x9E3779B1) + spot * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
            mixed ^= mixed >> np.uint32(15)
            mixed[space] = 0
            word = np.add.reduceat(mixed, begin, dtype=np.uint32) * _P
            out.append(_bucket(word))
            owner.append(doc[begin])
            # A document never ends inside a word, so neighbours of one document lie side by side.
            same = np.flatnonzero(doc[begin[1:]] == doc[begin[:-1]])
            out.append(_bucket((word[same] ^ word[same + 1]) * np.uint32(0x27D4EB2F) + np.uint32(1)))
            owner.append(doc[begin[same]])
            heavy = len(begin) + len(same)
        # n-grams of code points that lie in one word, its borders included.
        inner = ~space
        rolling = char.copy()
        for n in range(2, max(NGRAMS) + 1):
            rolling = rolling[: len(char) - n + 1] * _P ^ char[n - 1 :] if n > 2 else char[:-1] * _P ^ char[1:]
            if n not in NGRAMS:
                continue
            solid = np.ones(len(rolling), bool)
            for k in range(1, n - 1):
                solid &= inner[k : k + len(rolling)]
            solid &= inner[: len(rolling)] | inner[n - 1 :]
            at = np.flatnonzero(solid)
            mixed = (rolling[at] + np.uint32(n)) * np.uint32(0x9E3779B1)
            out.append(_bucket(mixed))
            owner.append(doc[at + 1])
    bucket, owner = np.concatenate(out), np.concatenate(owner)
    weight = np.ones(len(bucket), np.float32)
    weight[:heavy] = WORD_WEIGHT
    return bucket, owner, weight


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """One number per bucket, then the bias: the log-odds of label 1 is their mean over the features plus the bias."""
    if not len(texts):
        return np.zeros(BUCKETS + 1, np.float32)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    held = []
    for begin in range(0, len(texts), 200):
        bucket, owner, weight = features(texts[begin : begin + 200])
        key, where = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_inverse=True)
        count = np.bincount(where, weight, len(key))
        stops = np.searchsorted(key, np.arange(1, len(texts[begin : begin + 200])) * BUCKETS)
        held += list(zip(np.split((key % BUCKETS).astype(np.int32), stops), np.split(count.astype(np.float32), stops), strict=True))
    steps, step = EPOCHS * -(-len(texts) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            pick = order[begin : begin + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            sizes = np.array([len(held[i][0]) for i in pick])
            ids = np.concatenate([held[i][0] for i in pick])
            weight = np.concatenate([held[i][1] / max(held[i][1].sum(), 1) for i in pick])
            owner = np.repeat(np.arange(len(pick)), sizes)
            hidden = np.stack([np.bincount(owner, vectors[ids, d] * weight, len(pick)) for d in range(DIM)], 1).astype(np.float32)
            logits = hidden @ output + bias
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(pick)), labels[pick]] -= 1
            back = chance @ output.T
            output -= rate * hidden.T @ chance
            bias -= rate * chance.mean(0)
            for d in range(DIM):
                vectors[:, d] -= rate * np.bincount(ids, weight * back[owner, d], BUCKETS)
    turn = output[:, 1] - output[:, 0]
    return np.r_[vectors @ turn, bias[1] - bias[0]].astype(np.float32)


def score_texts(model: np.ndarray, texts: list[str]) -> np.ndarray:
    bucket, owner, weight = features(texts)
    total = np.bincount(owner, model[bucket] * weight, len(texts))
    count = np.bincount(owner, weight, len(texts))
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + float(model[-1]))))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Learn from labelled rows outside the held-out fold (crc32 of the id as text, mod 3, is 1)."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = (
        own.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~common.fold("doc_id", 1, 3))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
        .where(F.col("quality") == F.col("_most")).drop("_most")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    # At most max_train rows, so the broadcast is bounded whatever the tables' size.
    sample = common.id_text(docs).join(F.broadcast(chosen), "doc_id").repartition(1).sortWithinPartitions("doc_id", "text")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"text": [], "quality": []})])
        model = train(rows.text.tolist(), rows.quality.to_numpy(np.int64))
        yield pd.DataFrame({"model": [model.tobytes()]})

    models = sample.select("text", "quality").mapInPandas(learn, "model binary").collect()
    return np.frombuffer(models[0].model, np.float32) if models else np.zeros(BUCKETS + 1, np.float32)


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, beside: str | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; with ``beside`` the rows of ``docs`` and the score under that name."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.slices(batches):
            yield batch.append_column(beside, pa.array(score_texts(shared.value, texts), pa.float64())) if beside else \
                pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(score_texts(shared.value, texts), pa.float64())], ["doc_id", "score"])

    if beside:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(run, f"{schema}, `{beside}` double")
    return common.id_text(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", common.fold("doc_id", 1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    name = common.fresh(docs.columns, "_score")
    return score(docs, labels, beside=name).where(F.col(name) >= threshold).select(*docs.columns)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
