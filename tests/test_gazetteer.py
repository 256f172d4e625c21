"""Multi-word names against a plain search."""

from __future__ import annotations

import random
import re

import pytest

from swellcast.operators import gazetteer

NAMES = [("Snow Man", "GROUP"), ("snow", "WORK"), ("Snow-Man Live", "WORK"), ("米津玄師", "PERSON"), ("米津", "KEYWORD"), ("ぬい活", "KEYWORD"),
         ("a b", "X"), ("b c d", "Y"), ("b c d", "A"), ("é", "Z"), ("!!", "Q"), (None, "N"), ("man", "M")]
TEXTS = [(1, "SNOW MAN live! snowman, Snow; snow, man"), (2, "昨日の米津玄師と米津さんのぬい活"), (3, "a b c d b c d ab c"), (4, None), (5, "..."),
         (6, "café é É xé"), (6, "a  B"), (None, "man")]


def plain(text, names):
    form = re.sub(r"[\W_]+", " ", (text or "").lower()).strip()
    edge = lambda at: at <= 0 or at >= len(form) or any(c == " " or ord(c) >= 0x2E80 for c in form[at - 1 : at + 1])
    out, at = [], 0
    while at < len(form):
        here = max((n for n in names if form.startswith(n, at) and edge(at) and edge(at + len(n))), key=len, default=None)
        if here:
            out.append((at, here, names[here]))
        at += len(here) if here else 1
    return out


@pytest.mark.parametrize("block", [1_000_000, 12])
def test_name_mentions(spark, block):
    rng = random.Random(1)
    texts = TEXTS + [(100 + i, " ".join(rng.choice(["a", "b", "c", "d", "snow", "man", "live", "x"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    texts = [t for t in texts if "́" not in (t[1] or "")]
    names = {}
    for name, kind in NAMES:
        form = re.sub(r"[\W_]+", " ", (name or "").lower()).strip()
        if form:
            names[form] = min(names.get(form, kind), kind)
    got = sorted(map(tuple, gazetteer.name_mentions(
        spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(NAMES, "name string, entity_type string"), "id", block_bytes=block).collect()), key=str)
    assert got == sorted(((i, *m) for i, t in texts for m in plain(t, names)), key=str)
    none = gazetteer.name_mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "name string, entity_type string"), "id")
    assert none.count() == 0


def test_a_worker_holds_few_texts_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(gazetteer, "TEXT_CHARS", 10)
    texts = ["abcd", "efgh", "ijkl", "a text longer than all", "", "m"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["_key", "_form"])
    parts = list(gazetteer._parts(iter([batch])))
    assert [p.num_rows for p in parts] == [2, 1, 1, 2]
    assert [t for p in parts for t in p.column("_form").to_pylist()] == texts
