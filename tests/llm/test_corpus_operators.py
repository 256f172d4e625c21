"""Operators over the whole corpus, against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import pickle
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import EDGE_ROWS, bench_words, docs, space_words
from pyspark.sql import functions as F

from swellcast.llm import common, components, decontaminate, exact_dedup, jaccard, mixing_lm, page_text

BENCH = "item_id long, text string"


# -- exact dedup ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("largest", [True, False])
def test_exact_dedup(spark, largest):
    rng = random.Random(1)
    rows = [(i * 7 % 401 - 50, rng.choice(["x", "y", "", None, f"t{i % 9}"]), None, None, None) for i in range(300)] + EDGE_ROWS
    out = exact_dedup.mark(docs(spark, rows), largest=largest).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(doc_id)
    assert len(out) == len(rows)
    for r in out:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        if known and (largest or len(known) == len(ids)):
            assert r.keep_id == (max if largest else min)(known)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    stay = exact_dedup.keep_one(docs(spark, rows), largest=largest)
    assert stay.count() == len(groups) and stay.columns == docs(spark, rows).columns
    assert exact_dedup.mark(docs(spark, [])).count() == 0


# -- decontamination -----------------------------------------------------------------------------------
def plain_hits(text, windows):
    words, hit, items = bench_words(text), set(), set()
    for window, owners in windows.items():
        for p in range(len(words) - len(window) + 1):
            if tuple(words[p : p + len(window)]) == window:
                hit.update(range(p, p + len(window)))
                items |= owners
    return len(words), len(hit), items


def windows_of(items, size):
    out = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        k = min(size, len(words))
        for p in range(len(words) - k + 1 if k else 0):
            out[tuple(words[p : p + k])] |= {str(item)} if item is not None else set()
    return out


@pytest.mark.parametrize("blocks", [1, 6])
def test_decontamination_report(spark, monkeypatch, blocks):
    rng = random.Random(2)
    word = lambda: rng.choice("aé B c d".split())
    items = [(i % 18, " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(22)] + [(None, "d d d d"), (3, None)]
    rows = [(i, " ".join(rng.choice([word(), "zz"]) + rng.choice(["", ",", "!"]) for _ in range(rng.randint(0, 60))), None, None, None) for i in range(120)] + EDGE_ROWS
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
        monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 2)
        monkeypatch.setattr(decontaminate, "PIECE_WORDS", 6)
    got = Counter(map(tuple, decontaminate.report(docs(spark, rows), spark.createDataFrame(items, BENCH), window=4).collect()))
    windows, want = windows_of(items, 4), Counter()
    for doc_id, text, *_ in rows:
        n, hit, found = plain_hits(text, windows)
        want[(doc_id, n, hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), hit > 0)] += 1
    assert got == want
    assert decontaminate.report(docs(spark, []), spark.createDataFrame(items, BENCH)).count() == 0
    assert {r.n_hit for r in decontaminate.report(docs(spark), spark.createDataFrame([], BENCH)).collect()} == {0}


def test_decontamination_fetches_one_pass_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 2)
    seen, keep = [], decontaminate.fetched
    monkeypatch.setattr(decontaminate, "fetched", lambda *a: seen.append(keep(*a)) or seen[-1])
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(30)], BENCH)
    rows = [(i, f"x a{i} b{i} c{i} d{i} e{i} f{i} y", None, None, None) for i in range(30)]
    out = decontaminate.report(docs(spark, rows), items, window=4).collect()
    assert {(r.n_hit, r.n_items) for r in out} == {(6, 1)}
    assert len(seen) > 2 and all(len(part) <= 2 for part in seen)


def test_decontamination_cleans(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(51, f"Kept start, {passage.upper()}! Kept end of a text that is long enough to stay in the corpus for good", "en", "s", 9),
            (52, passage, "en", "s", 9), (53, "clean", "en", "s", 5), *EDGE_ROWS]
    out = decontaminate.clean(docs(spark, rows), spark.createDataFrame([(7, passage)], BENCH))
    got = {r.doc_id: r for r in out.collect()}
    assert 52 not in got and got[53].text == "clean"
    assert got[51].text.startswith("Kept start, ! Kept end") and got[51].n_chars == len(got[51].text)
    assert out.count() == len(rows) - 1 and out.columns == docs(spark, rows).columns


# -- Jaccard join --------------------------------------------------------------------------------------
def plain_classes(rows, words, percent):
    sets = []
    for _, text in rows:
        w = space_words(text)
        sets.append({tuple(w[p : p + words]) for p in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared, index = Counter(), defaultdict(list)
    for n, own in enumerate(sets):
        for x in own:
            index[x].append(n)
    for members in index.values():
        shared.update((a, b) for i, a in enumerate(members) for b in members[i + 1 :])
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    lowest = {}
    for n, (i, _) in enumerate(rows):
        lowest[find(n)] = min(lowest.get(find(n), i), i)
    return Counter((i, len(sets[n]), lowest[find(n)]) for n, (i, _) in enumerate(rows))


def near_copies(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    base, rows = [rng.choice(vocabulary) for _ in range(90)], []
    for _ in range(150):  # a large group of near copies: frequent shingles only
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append(text)
    passages = [[rng.choice(vocabulary) for _ in range(50)] for _ in range(3)]
    rows += [[rng.choice(vocabulary) for _ in range(rng.randint(0, 20))] + rng.choice(passages) + rng.choice(passages) for _ in range(90)]
    for _ in range(20):
        start = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 30, 60, 200]))]
        for _ in range(rng.randint(1, 5)):
            text = list(start)
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(text)
    rows += [[], [], ["a"], ["A"], ["same"] * 50]
    rng.shuffle(rows)
    return [(3 * i + 1, " ".join(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_jaccard_classes(spark, monkeypatch, words, percent):
    monkeypatch.setattr(jaccard, "SKETCH_BITS", (10, 12))
    monkeypatch.setattr(jaccard, "CHUNK", 1 << 8)
    monkeypatch.setattr(jaccard, "PIVOT_PAIRS", 20)
    rows = near_copies(random.Random(words))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, jaccard.classes(table, words, percent).collect()))
    assert got == plain_classes(rows, words, percent)


def test_jaccard_index_has_combinations():
    # A sketch in which every shingle is frequent leaves combinations only, and linked sets share one.
    rng = np.random.default_rng(3)
    keys = jaccard.Keys(np.full(1 << 10, 10, np.uint32), 85)
    keys.limit = 1.0
    for size in (1, 3, 8, 15, 16, 17, 40, 127, 128, 150, 600):
        own = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        allowed = len(own) - math.ceil(2 * 85 * len(own) / 185)
        other = np.unique(np.r_[own[allowed:], rng.integers(0, 2**63, allowed).astype(np.uint64)])
        single, multi, often = keys.of(own)
        assert len(single) == 0 and often == len(own) and len(multi) <= 12 * len(own) + 8
        assert set(multi.tolist()) & set(keys.of(other)[1].tolist())


def test_jaccard_on_edge_rows(spark):
    out = jaccard.classes(docs(spark)).collect()
    by_id = defaultdict(set)
    for r in out:
        by_id[r.doc_id].add((r.n_shingles, r.component_id))
    assert len(out) == len(EDGE_ROWS)
    assert by_id[1] == {(0, 1)} and by_id[2] == {(0, 2)} and by_id[4] == by_id[5] == {(2, 4)} and by_id[None] == {(1, None)} and by_id[7] == {(1, 7)}
    kept = jaccard.keep_one(docs(spark))
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8, None} and kept.columns == docs(spark).columns
    assert jaccard.classes(docs(spark, [])).count() == 0


def test_jaccard_sets_keep_both_sides(spark, monkeypatch):
    # A copy met first shares its filter bit with another document of side a only.
    monkeypatch.setattr(jaccard, "FILTER_BITS", 15)
    from pyspark.sql import functions as F

    found = spark.range(10, 4000).groupBy(F.pmod(F.xxhash64("id"), F.lit(1 << 15))).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    other, copy = found.where(F.size("ids") > 1).orderBy(F.col("ids")[0]).first().ids[:2]
    texts = ["one two three", "one two three", "four five six", "seven eight nine"]
    rows = spark.createDataFrame(list(zip([copy, 1, other, 2], texts, strict=True)), "doc_id long, text string").coalesce(1)
    x, y, z = (jaccard.node_of(jaccard.shingles([t], 2)[0]) for t in texts[1:])
    nodes = spark.createDataFrame([(x, 1), (y, other), (z, 2)], "node long, doc_id long")
    pairs = spark.createDataFrame([(y, x), (x, z)], "a long, b long")
    sets = jaccard._sets(rows, nodes, pairs, 2).collect()
    assert x in {r.node for r in sets if r.in_a} and x in {r.node for r in sets if r.in_b}


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 5), (100, 7), (7, 6)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 5 for i in (100, 5, 7, 6)}}


# -- page text -----------------------------------------------------------------------------------------
def test_page_blocks_by_structure():
    page = ("<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu<li>More</ul></nav><article><h1>Head &amp; line</h1>"
            "<p>One <b>bold</b>word<br>next<p class='ad box'>Buy<p>Two&nbsp;&lt;x&gt;<!-- <p>no</p> --><script>var a='</p>';</script><form>Sign<input></form>"
            "<section id=comments><article>Reader</article></section><footer>End</footer></article><aside>Side</aside><div class=cookie-notice>Ok</div></body>")
    assert page_text.settled(page_text.blocks(page)) == (["Head & line", "One boldword next", "Two <x>"], True)
    assert page_text.blocks("") == [] and page_text.blocks("<p") == [("<p", 0, 0)]


def test_shared_lines_are_longest():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        shared, rest = page_text.shared_lines(a, b), iter(b)
        assert len(shared) == table[-1][-1] and all(any(y == a[i] for y in rest) for i in shared)


def test_page_differencing(spark):
    rows = [(i, f"http://h{i % 2}.x/a/{'ab'[i // 2 % 2]}/{i}", f"<body><div>Menu one</div><div>Body {i} text</div><div>Copy</div></body>") for i in range(40)]
    rows += [(99, None, None), (98, "http://solo.x/a", "<div>Only</div>"), (97, "http://[bad", "<article>Kept</article>"), (96, "http://h0.x/z", "")]
    out = {r.page_id: r for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == 44 and all(out[i].text == f"Body {i} text" for i in range(40))
    assert (out[99].text, out[98].text, out[97].text, out[96].text, out[98].n_chars) == ("", "Only", "Kept", "", 4)
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_differencing_in_articles(spark):
    page = lambda i: f"<div>Top</div><p>Lead {i}</p><article><p>Own text of {i}, at some length.</p><p class='x1'>Write to us</p></article>"
    copy = "<article><p>One text on two pages</p><p>Its end</p></article>"
    rows = [(i, f"http://h.x/{i:02}", page(i)) for i in range(20)] + [(50 + i, f"http://c.x/{i}", copy + f"<div>{i}</div>") for i in range(2)]
    rows += [(60, "http://solo.x/", page(60))]
    out = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Lead {i} Own text of {i}, at some length." for i in range(20))
    assert [out[50 + i] for i in range(2)] == [f"One text on two pages Its end {i}" for i in range(2)]
    assert out[60] == "Own text of 60, at some length. Write to us"


# -- language model ------------------------------------------------------------------------------------
def test_prefix_code_is_complete():
    size, node, bit = mixing_lm.prefix_code(np.arange(256.0) ** 2)
    assert abs(sum(2.0 ** -int(s) for s in size) - 1) < 1e-9 and len(node) == len(bit) == size.sum()
    ends = np.cumsum(size)
    assert len({tuple(bit[e - s : e]) for e, s in zip(ends, size, strict=True)}) == 256


def test_lm_base_and_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing_lm, "SLICE", 3_000)
    rng = random.Random(8)
    stems = ["".join(rng.choices("etaoinshrd", k=rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(stems[: 5 + i % 295]).title() for _ in range(rng.randint(0, 60))), None, None, None) for i in range(300)] + EDGE_ROWS
    out = mixing_lm.score(docs(spark, rows)).collect()
    tokens = [(i, [*space_words(t), ""]) for i, t, *_ in rows]
    training = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    counts = Counter(w for i, ws in tokens if training(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = Counter((i, not training(i), len(ws), sum(w in counts for w in ws), total,
                    round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 5)) for i, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    assert all(r.score < 0 for r in out) and any(r.bits_per_byte is None for r in out)
    held = [r for r in out if r.held_out and r.n_tokens > 5]
    untrained = mixing_lm.Mixer(np.ones(256), np.zeros((len(mixing_lm.ORDERS), mixing_lm.SLOTS, 2), np.float32))
    plain = {i: sum(untrained.log10(b" ".join([w.encode() for w in ws] + [b""])).tolist()) for i, ws in tokens}
    assert sum(r.score for r in held) > 0.3 * sum(plain[r.doc_id] for r in held)
    assert mixing_lm.score(docs(spark, [])).count() == 0
    alone = mixing_lm.score(docs(spark, [(next(i for i in range(99) if not training(i)), "some words", None, None, None)])).collect()
    assert alone[0].train_tokens == 0 and alone[0].base_score == 0 and alone[0].score < 0


def test_lm_is_free_of_layout_and_learns_from_all_words(spark, monkeypatch):
    rng = random.Random(5)
    stems = ["".join(rng.choices("etaoinshrd", k=rng.randint(2, 7))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(stems[: 5 + i]) for _ in range(40)), None, None, None) for i in range(200)]
    monkeypatch.setattr(mixing_lm, "SHARD_WORDS", 60)
    learned = []
    keep = mixing_lm._mixer
    monkeypatch.setattr(mixing_lm, "_mixer", lambda *a: learned.append(keep(*a)) or learned[-1])
    scores = []
    for size, parts in ((3_000, 7), (16_000_000, 1)):
        monkeypatch.setattr(mixing_lm, "SLICE", size)
        out = mixing_lm.score(docs(spark, rows).repartition(parts)).collect()
        scores.append({r.doc_id: round(r.score, 8) for r in out})
    assert scores[0] == scores[1]
    first, second = (pickle.loads(b) for b in learned)
    assert (first.tables == second.tables).all() and (first.spelling.size == second.spelling.size).all()
    # Every training word took part, once.
    training = {w for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in space_words(t)} | {""}
    bits = first.spelling.bits(b" ".join([*(w.encode() for w in training), b""]))
    assert first.tables[0].sum() == len(bits[2]) and (first.weights != 0.35).any()


def test_lm_mixes_exact_counts_and_earlier_words(spark, monkeypatch):
    """A plain walk over the words gives the same totals; word order counts."""
    monkeypatch.setattr(mixing_lm, "SLICE", 2_000)
    rng = random.Random(6)
    stems = ["".join(rng.choices("etaoinshrd", k=rng.randint(3, 7))) for _ in range(60)]
    follow = {w: rng.choices(stems, k=2) for w in stems}
    texts = []
    for _ in range(400):
        line = [rng.choice(stems)]
        while len(line) < 25:
            line.append(rng.choice(follow[line[-1]]))
        texts.append(line)
    training = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(900)]
    free = [i for i in range(len(texts), 900) if not training[i]][:40]
    shuffled = {i: rng.sample(texts[j], 25) for j, i in enumerate(free[20:])}
    rows = list(enumerate(texts)) + [(i, texts[j]) for j, i in enumerate(free[:20])] + list(shuffled.items()) + [(899, ["zzz", "qq"])]
    models, keep, spellers, spell = [], mixing_lm._text, [], mixing_lm._mixer
    monkeypatch.setattr(mixing_lm, "_text", lambda *a: models.append(keep(*a)) or models[-1])
    monkeypatch.setattr(mixing_lm, "_mixer", lambda *a: spellers.append(spell(*a)) or spellers[-1])
    out = {r.doc_id: r.score for r in mixing_lm.score(docs(spark, [(i, " ".join(t), None, None, None) for i, t in rows])).collect()}
    model, speller = models[0][0], pickle.loads(spellers[0])
    counts = Counter(w for i, t in rows if training[i] for w in [*t, ""])
    key = lambda w: int(mixing_lm._keys(w.encode())[1 if w else 0])
    ranked = sorted(counts, key=lambda w: (-counts[w], key(w)))
    cut = max(1, counts[ranked[mixing_lm.TOP]])
    top = [w for w in ranked if counts[w] > cut]
    symbol = lambda w: top.index(w) if w in top else mixing_lm.TOP + max(1, counts[w].bit_length())
    totals = Counter()
    for w, n in counts.items():
        totals[symbol(w)] += n
    assert all(model.totals[s] == totals[s] for s in range(mixing_lm.SYMBOLS))
    path = {s: [(int(model.node[j]), int(model.bit[j])) for j in range(model.start[s], model.start[s] + model.size[s])] for s in totals | {mixing_lm.TOP + 1: 0}}
    full = (1 << 64) - 1

    def name(w):
        x = key(w) & full if counts[w] > 1 else full
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
        return x ^ x >> 31

    def slot(context, node):
        return (((context ^ (node + 1) * 0xD6E8FEB86659FD93 & full) * 0xFF51AFD7ED558CCD) & full) >> 64 - mixing_lm.TEXT_BITS


    def walk(line):
        last, skipped = "", ""
        for w in [*line, ""]:
            one, two = name(last), name(skipped)
            for node, bit in path[symbol(w)]:
                yield w, node, bit, [(0, slot(one, node)), (1, slot(one * 0x9E3779B97F4A7C15 + two & full, node)), (2, slot(two, node))]
            last, skipped = w, last

    tables = Counter((*c, bit) for i, t in rows if training[i] for _, _, bit, contexts in walk(t) for c in contexts)
    level = lambda zeros, ones: int(mixing_lm.strengths(np.array([zeros]), np.array([ones]))[0])
    size = mixing_lm.SYMBOLS * mixing_lm.LEVELS**3
    place = lambda node, levels: (node << 12) + sum(v << 4 * k for k, v in enumerate(levels))
    seen = np.zeros((size, 2), np.int64)
    for i, t in rows:
        for _, node, bit, contexts in walk(t) if training[i] else ():
            seen[place(node, [level(*(tables[*c, b] - (bit == b) for b in (0, 1))) for c in contexts]), bit] += 1
    mine = mixing_lm.Text(np.array([key(w) for w in top], np.int64), model.totals)
    mine.learn(seen)
    assert np.allclose(mine.weights, model.weights) and (mine.weights != 0).all()
    close = 0
    for i, t in rows:
        want = sum(mine.logs[2 * place(node, [level(*(tables[*c, b] for b in (0, 1))) for c in contexts]) + bit] for _, node, bit, contexts in walk(t))
        for w in [*t, ""]:
            if symbol(w) == mixing_lm.TOP + 1:
                want += float(speller.log10(w.encode() + b" ")[0])
            elif w not in top:
                want += math.log10(counts[w] / totals[symbol(w)])
        close += abs(out[i] - want) < 1e-6
    assert close == len(rows)
    assert all(out[i] < out[j] - 1 for j, i in enumerate(free[20:]))
    assert all(abs(out[i] - out[j]) < 1e-9 for j, i in enumerate(free[:20]))


def test_lm_counts_sequences_of_the_whole_corpus(spark, monkeypatch):
    monkeypatch.setattr(mixing_lm, "SLICE", 1_500)
    monkeypatch.setattr(mixing_lm, "HASHES_AT_ONCE", 700)
    rng = random.Random(11)
    texts = [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(0, 40))) for _ in range(150)]
    rows = [(i, t, None, None, None) for i, t in enumerate([*texts, *texts[:20], "ab " * 300, ""])]
    given = common.id_text(docs(spark, rows)).withColumn("train", F.col("doc_id") % 5 != 2).repartition(3)
    coded = mixing_lm._coded(mixing_lm._slices(given), 3).collect()
    assert len(coded) > 5

    def events(text):
        line = [None, None, None, *text.split(), ""]
        return [(tuple(line[i - 3 : i]), line[i]) for i in range(4, len(line))]

    def tally(made):
        followed = Counter(made)
        total, kinds = Counter(c for c, _ in made), Counter(c for c, _ in followed)
        return followed, total, kinds

    every = {i: events(t) for i, t, *_ in rows}
    whole = tally([e for i, made in every.items() if i % 5 != 2 for e in made])
    for row in coded:
        codes = np.frombuffer(mixing_lm._whole(row.codes), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)
        sizes, train = np.array(row.sizes), np.array(row.train)
        distinct, at, there = mixing_lm._sorted_events(codes, mixing_lm._keys(mixing_lm._whole(row.words)), 3)
        counts = [mixing_lm._whole_codes(c) for c in (row.followed, row.total, row.kinds)]
        doc = np.repeat(np.arange(len(sizes)), sizes)[there]
        tokens = [(i, e) for i in row.ids for e in every[i]]
        assert len(tokens) == len(at)
        assert [tuple(int(c[j]) for c in counts) for j in at] == [(whole[0][e], whole[1][e[0]], whole[2][e[0]]) for _, e in tokens]
        others = list(zip(*(x.tolist() for x in mixing_lm._without_own(at, doc, train, distinct, counts)), strict=True))
        for i in set(row.ids):
            rest = tally(list((Counter(e for j, made in every.items() if j % 5 != 2 for e in made) - Counter(every[i] if i % 5 != 2 else [])).elements()))
            assert [o for o, (j, _) in zip(others, tokens, strict=True) if j == i] == [(rest[0][e], rest[1][e[0]], rest[2][e[0]]) for e in every[i]]


def test_lm_tells_documents_that_occur_twice(spark, monkeypatch):
    """Words in the order of another document are likelier than the same words in an order of their own."""
    monkeypatch.setattr(mixing_lm, "SLICE", 20_000)
    rng = random.Random(12)
    stems = ["".join(rng.choices("etaoinshrd", k=rng.randint(3, 8))) for _ in range(3_000)]
    training = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    texts = {i: " ".join(rng.choices(stems, k=40)) for i in range(500)}
    sources = [i for i in texts if training(i)]
    held, seen = ([i for i in range(1_000, 2_000) if training(i) == kind][:20] for kind in (False, True))
    copies = dict(zip([*held, *seen], sources, strict=False))
    rows = [(i, t, None, None, None) for i, t in (texts | {i: texts[j] for i, j in copies.items()}).items()]
    out = {r.doc_id: r for r in mixing_lm.score(docs(spark, rows), mixing_lm.EARLIER).collect()}
    assert len(out) == 540
    alone = [r for i, r in out.items() if i not in copies and i not in copies.values()]
    least = min(r.bits_per_byte for r in alone if r.held_out)
    assert all(out[i].bits_per_byte < 0.5 * least for i in held)
    assert all(out[i].others_bits_per_byte < 0.5 * min(r.others_bits_per_byte for r in alone) for i in copies)
    assert all(out[i].bits_per_byte == out[i].others_bits_per_byte for i in held) and all(r.score < 0 for r in out.values())
    # A text has one score, in whichever fold.
    assert all(abs(out[i].score - out[j].score) < 1e-9 for i, j in copies.items())


def test_lm_holds_little_of_a_slice(spark):
    words = [f"word{i * 7919}" for i in range(200_000)]
    spaced = " ".join(words).encode()
    tracemalloc.start()
    keys = mixing_lm._keys(spaced)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(spaced)
    at = [0, 49_999, 50_000, 199_999]
    assert [keys[i + 1] for i in at] == [mixing_lm._keys(words[i].encode())[1] for i in at] and len(keys) == len(words) + 1
    # A slice leaves its task in far fewer bytes than four a word number, and comes back whole.
    rows = [(i, " ".join(words[i * 50 % 1000 : i * 50 % 1000 + 40]), None, None, None) for i in range(2_000)]
    made = mixing_lm._slices(common.id_text(docs(spark, rows)).withColumn("train", F.lit(True)).coalesce(1)).toArrow()
    tokens = sum(sum(sizes) for sizes in made["sizes"].to_pylist())
    assert sum(len(c) for c in made["codes"].to_pylist()) < 2 * tokens
    codes = [mixing_lm._whole_codes(c) for chunk in made["codes"].chunks for c in chunk]
    spelled = [[b"", *mixing_lm._whole(w).split(b" ")] for chunk in made["words"].chunks for w in chunk]
    ids = [i for part in made["ids"].to_pylist() for i in part]
    texts = [t for c, w in zip(codes, spelled, strict=True) for t in b" ".join(w[i] or b"\n" for i in c).split(b"\n")[:-1]]
    assert {i: t.split() for i, t in zip(ids, texts, strict=True)} == {i: t.encode().split() for i, t, *_ in rows}


def test_lm_spelling_sums_to_one():
    # Over all words of one byte, and the longer rest, the spelled probabilities add up to at most one.
    mixer = mixing_lm.Mixer(np.ones(256), np.zeros((len(mixing_lm.ORDERS), mixing_lm.SLOTS, 2), np.float32))
    words = [bytes([b]) for b in range(256) if b != 32]
    assert 0 < (10.0 ** mixer.log10(b" ".join([*words, b""]))).sum() < 1


def test_stages_hand_on_clashing_columns(spark, monkeypatch):
    """Working columns get fresh names, so a caller's own come through unchanged."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 1)
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [*EDGE_ROWS, (20, f"before it stands {passage} and after it stand these many other words of its own", None, None, None)]
    given = docs(spark, rows)
    bench = spark.createDataFrame([(7, passage), (8, "a b c d e f g h i j k l m n"), (9, "q w e r t z u i o p a s d f")], BENCH)
    cleaned = decontaminate.clean(given, bench)
    assert cleaned.columns == given.columns and {r["_hits"] for r in cleaned.collect()} == {"x"}
    assert [r.text for r in cleaned.where("doc_id = 20").collect()] == [rows[-1][1].replace(passage + " ", " ").replace("stands  and", "stands  and")]
    stay = exact_dedup.keep_one(given)
    assert stay.columns == given.columns and stay.count() == len({r[1] or "" for r in rows})
    assert {(r["_tag"], r["_sha"]) for r in stay.collect()} == {("x", "x")}


# -- page text -----------------------------------------------------------------------------------------
def page(headline, body, menu="Home"):
    return f"<html><body><p>{menu}</p><article><h1>{headline}</h1><p>{body}</p></article></body></html>"


def test_article_lines_that_a_neighbour_shares_stay(spark):
    bare = "<html><body><p>Share this page</p><p>{}</p></body></html>"
    rows = [(1, "http://h/a/1", page("The same headline", "First text")), (2, "http://h/a/2", page("The same headline", "Second text")),
            (3, "http://h/b/1", bare.format("Only here")), (4, "http://h/b/2", bare.format("Only there")), (5, "http://g/x", page("Alone", "Text"))]
    found = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "The same headline First text", 2: "The same headline Second text", 3: "Only here", 4: "Only there", 5: "Alone Text"}
