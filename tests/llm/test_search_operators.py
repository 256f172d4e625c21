"""Nearest neighbours, word runs and ranked search, against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE_ROWS, docs, lower_ascii

from swellcast.llm import nearest, ranked_search, word_runs

VECTORS = "vec_id long, embedding array<float>, label string"


# -- nearest neighbours --------------------------------------------------------------------------------
def exact_nearest(rows, every, top):
    good = {}
    for vec_id, vec in rows:
        if vec_id is None or not vec or any(x is None or not math.isfinite(x) for x in vec) or not any(vec):
            continue
        packed = (np.array(vec, "<f4") + np.float32(0)).tobytes()
        good[vec_id] = min(good.get(vec_id, packed), packed)
    flat = {i: np.frombuffer(p, "<f4").astype(float) for i, p in good.items()}
    out = {}
    for q in flat:
        if q % every == 0:
            near = sorted((math.sqrt(((flat[q] - v) ** 2).sum()), i) for i, v in flat.items() if i != q and len(v) == len(flat[q]))
            out[q] = near[:top]
    return out


def vector_rows(seed, n, copies):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 24))
    rows = [(i, (centres[i % 5] + rng.normal(size=24)).tolist()) for i in range(n)]
    hot = rows[3][1]
    rows += [(n + i, hot) for i in range(copies)]
    rows += [rows[1], rows[1], (2, rows[7][1]), (None, hot), (-1, None), (-2, []), (-3, [0.0] * 24), (-4, [float("nan")] * 24),
             (-5, [1.0] * 23 + [None]), (-6, [float("inf")] + [1.0] * 23), (-7, [1.0, 2.0]), (-10, [3.0, 2.0]), (-20, [0.5, -2.0])]
    return rows


def test_nearest_finds_exact_neighbours(spark):
    rows = vector_rows(1, 600, 150)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS).selectExpr("*", "1 AS node", "2 AS vec", "3 AS query", "4 AS cell")
    out = nearest.nearest(df, every=10).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q, near in exact_nearest(rows, 10, 10).items():
        own = sorted(got.get(q, []))
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and len(own) <= len(near)
        true = {i: d for d, i in near}
        hit, total = hit + len({x[1] for x in own} & set(true)), total + len(near)
        assert [(x[2], x[1]) for x in own] == sorted((x[2], x[1]) for x in own)
        assert all(abs(x[2] - true[x[1]]) < 1e-12 for x in own if x[1] in true)
    assert hit >= 0.9 * total


def test_nearest_copies_and_ties(spark):
    """Of a crowd of equal vectors a query gets the smallest ids but its own."""
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0], "x") for i in range(500)], VECTORS)
    got = {}
    for r in nearest.nearest(df, every=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 100, 200, 300, 400]
    for q, own in got.items():
        assert sorted(own) == [(k + 1, i, 0.0) for k, i in enumerate([x for x in range(11) if x != q][:10])]
    assert nearest.nearest(df.where("false"), every=100).count() == 0


def test_nearest_parts_of_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART", 20)
    rows = vector_rows(2, 300, 0)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    found = {(r.query_id, r.vec_id) for r in nearest.nearest(df, every=10).collect()}
    true = {(q, i) for q, near in exact_nearest(rows, 10, 10).items() for _, i in near}
    assert len(found & true) >= 0.9 * len(true)


def test_hadamard_is_orthogonal():
    h = nearest.hadamard(np.eye(8, dtype=np.float32))
    assert np.allclose(h @ h.T, np.eye(8), atol=1e-6) and np.allclose(np.abs(h), 8**-0.5)


def test_probes_start_at_the_own_bucket():
    plan = nearest.Plan(24, 50_000)
    rows = nearest.units(np.random.default_rng(3).normal(size=(50, 24)))
    for table in range(3):
        order = plan.probed(rows, table, 40)
        assert (order[:, 0] == plan.bucket(rows, table)).all() and all(len(set(o)) == 40 for o in order.tolist())


# -- word runs -----------------------------------------------------------------------------------------
def plain_runs(words):
    """Every maximal stretch with its smallest period, by definition."""
    found, n = set(), len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(
                    all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def run_rows(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [rng.choice("abcdef") for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            piece = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
            words += (piece * 9)[: rng.randint(4, 40)] + [rng.choice("abcx")]
        rows.append((i, rng.choice([" ", "\t", "  \n"]).join(words), None, None, None))
    return rows


def test_word_runs(spark):
    rows = [r for r in EDGE_ROWS if r[0] != 7] + run_rows(4, 250)
    got = Counter(tuple(r)[:8] for r in word_runs.word_runs(docs(spark, rows), altered=True).collect())
    assert got == Counter(plain_row(r[0], r[1]) for r in rows)
    assert word_runs.word_runs(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_nested_repeats(seed):
    rng = random.Random(seed)
    per_doc = []
    for _ in range(40):
        words = [rng.randint(0, 1)]
        for _ in range(rng.randint(1, 4)):
            words = words * rng.randint(1, 5) + [rng.randint(0, 2) for _ in range(rng.randint(0, 2))]
        per_doc.append(words[:200])
    counts = np.array([len(w) for w in per_doc])
    start, end, period = word_runs.runs(np.array([x for w in per_doc for x in w]), counts)
    base = np.cumsum(counts) - counts
    expected = [(s + b, s + b + n, q) for w, b in zip(per_doc, base.tolist(), strict=True) for s, n, q in plain_runs(w)]
    assert list(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == expected


def test_runs_with_lying_hashes(monkeypatch):
    """Where hashes call everything equal, the exact search gives the runs."""
    words = [1, 2, 3] * 5 + [4] * 7 + [5, 6, 7, 8, 9] + [1, 2] * 6
    monkeypatch.setattr(word_runs.common, "mix64", lambda x: np.zeros(len(x), np.uint64))
    start, end, period = word_runs.runs(np.array(words), np.array([len(words)]))
    assert [(s, e - s, q) for s, e, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True)] == plain_runs(words)


def test_runs_of_a_very_long_text():
    words = np.r_[np.zeros(60_000, np.int64), np.tile(np.arange(1, 1_001), 50), np.arange(2_000, 60_000)]
    start, end, period = word_runs.runs(words, np.array([len(words)]))
    assert list(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == [(0, 60_000, 1), (60_000, 110_000, 1_000)]


# -- ranked search -------------------------------------------------------------------------------------
def plain_ranking(rows, items, top):
    terms = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower_ascii(t)) for _, t in rows]
    counts = [Counter(t) for t in terms]
    n_docs, total = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(t for c in counts for t in c)
    texts = {}
    for item, text in items:
        if item is not None:
            texts[item] = min(texts.get(item, text or ""), text or "")
    out = []
    for item, text in texts.items():
        asked = Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower_ascii(text)))
        scored = []
        for (doc_id, _), own, c in zip(rows, terms, counts, strict=True):
            if own:
                m = 75 + (25 * len(own) * n_docs) // total
                score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                            for t, k in asked.items() if t in c)
                if score > 0:
                    scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return out


ITEMS = [(1, "alpha beta beta w3 Ünï"), (2, None), (3, ""), (4, "w1 w2 w3 w4 w5 w6 rare7"), (4, "w1 w2"), (None, "w1"), (5, "same words HERE again"), (6, "zzz")]


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_ranked_search(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(ranked_search, "SHARD_CELLS", 1_500)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 6)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice([f"w{min(int(rng.expovariate(.4)), 20)}", "Alpha", "beta", f"rare{rng.randint(0, 40)}"])
                         for _ in range(rng.randint(1, 60))), None, None, None) for i in range(400)]
    rows += EDGE_ROWS + rows[:5] + [(1000 + i, "w1 w3 alpha", None, None, None) for i in range(60)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS rank")
    got = [tuple(r) for r in ranked_search.ranked(docs(spark, rows), items, top=7).collect()]
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(plain_ranking([r[:2] for r in rows], ITEMS, 7), key=key)
    assert ranked_search.ranked(docs(spark, []), items).count() == 0
    assert ranked_search.ranked(docs(spark), items.where("false")).count() == 0


def test_blocks_are_skipped_by_their_bounds():
    """A block whose bound is below the threshold is not scored; the result is that of scoring everything."""
    rng = np.random.default_rng(6)
    n, size = 2_000, 12
    held = rng.random((n, size)) < 0.3
    held[:1_000, 1] = held[1_000:, 2] = False  # two kinds of documents
    doc, term = np.nonzero(held)
    edges = np.r_[0, np.cumsum(held.sum(1))]
    shard = ranked_search.Shard(np.arange(n), np.ones(n, bool), held.sum(1), term, rng.integers(1, 5, len(term)), edges,
                                np.arange(size, 0, -1) * 500, n, int(held.sum()))
    items = ranked_search.Items([(0, "t0 t1 t3"), (1, "t0 t2 t4 t4")])
    items.terms, items.times = [np.array([0, 1, 3]), np.array([0, 2, 4])], [np.array([1, 1, 1]), np.array([1, 1, 2])]
    scored, plain = [], shard.scores
    shard.scores = lambda docs, *a: scored.append(len(docs)) or plain(docs, *a)
    seeds = [b.threshold for b in ranked_search.seeds(shard, items, 5)]
    found = ranked_search.search(shard, items, 5, seeds)
    for best, terms, times in zip(found, items.terms, items.times, strict=True):
        full = plain(np.arange(n), terms, times * shard.weight[terms])
        order = np.lexsort((np.arange(n), -full))[:5]
        assert best.docs.tolist() == order.tolist() and best.scores.tolist() == full[order].tolist()
    assert sum(scored) < 1.5 * n
