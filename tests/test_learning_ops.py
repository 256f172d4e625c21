"""Resolution, pairs, relations, labels, learning, evaluation, health and streaming cases."""

from __future__ import annotations

import datetime as dt
import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.operators import anomaly, evaluation, evidence, health, labels, learning, pairs, relations, resolve, weights
from swellcast.plans.stages import new_path
from swellcast.sources import tables
from swellcast.streaming import anomaly as SA

D0 = dt.date(2024, 3, 1)
CAND = (
    "candidate_id string, candidate_type string, candidate_kind string, canonical_name string, display_name string, "
    "aliases array<string>, status string, external_ids map<string,string>, manual_lock boolean, created_seq int, "
    "related_ids array<string>, exclude_ids array<string>, merged_from array<string>, merged_into string, domain_class string"
)


def cand(cid, name, ctype="PERSON", aliases=(), status="ACTIVE", ext=None, lock=False, seq=0, **kw):
    kind = "TOPIC" if ctype in dims.TOPIC_TYPES else "ENTITY"
    return (cid, ctype, kind, name, name, list(aliases), status, ext or {}, lock, seq, kw.get("related", []), kw.get("exclude", []), [], None, "ENTERTAINMENT")


def test_resolution_cascade(spark):
    cands = spark.createDataFrame([
        cand("a", "Snow Man", "GROUP", ["スノーマン"]), cand("b", "Blocked One", status="BLOCKED"), cand("m", "Merged One", status="MERGED"),
        cand("l", "Locked", aliases=["Exact Alias"], lock=True), cand("e", "Ext", ext={"spotify": "42"}), cand("t", "#ぬい活", "HASHTAG"),
    ], CAND)
    rows = [
        (1, "SNOW MAN!", "PERSON", None), (2, "スノーマン", "GROUP", None), (3, "Blocked One", "PERSON", None), (4, "Merged One", "PERSON", None),
        (5, "LOCKED", "PERSON", None), (6, "Lock-ed", "PERSON", None), (7, "whatever", "PERSON", {"spotify": "42"}), (8, "ぬい活", "PHRASE", None),
        (9, "New Name", "PERSON", None), (10, "new-name", "GROUP", None),
    ]
    m = spark.createDataFrame(rows, "ordinal long, name string, candidate_type string, external_ids map<string,string>")
    res = resolve.resolve(m, cands).cache()
    got = {r.ordinal: r.candidate_id for r in res.collect()}
    assert got == {1: "a", 2: "a", 3: None, 4: None, 5: "l", 6: None, 7: "e", 8: "t", 9: None, 10: None}
    minted = {r.match_key: r for r in resolve.mint(res).collect()}
    assert minted["newname"].canonical_name == "New Name" and minted["newname"].candidate_type == "PERSON"
    ids = {r.ordinal: r.candidate_id for r in resolve.assign_ids(res).collect()}
    assert ids[9] == ids[10] == minted["newname"].candidate_id


def test_stored_aliases_fall_through_to_the_typed_key(spark):
    cands = spark.createDataFrame([cand("a", "Snow Man", "GROUP"), cand("b", "Gone", status="MERGED"), cand("l", "Locked", lock=True)], CAND)
    m = spark.createDataFrame(
        [(1, "Snow Man", "GROUP", None), (2, "Snow Man", "PERSON", None), (3, "Nick", "PERSON", None), (4, "old", "PERSON", None), (5, "lo-cked", "PERSON", None)],
        "ordinal long, name string, candidate_type string, external_ids map<string,string>",
    )
    stored = spark.createDataFrame([("nick", "a"), ("old", "b"), ("locked", "l")], "match_key string, candidate_id string")
    got = {r.ordinal: (r.candidate_id, r.resolved_by) for r in resolve.resolve(m, cands, stored).collect()}
    assert got == {1: ("a", "typed"), 2: (None, None), 3: ("a", "alias"), 4: (None, None), 5: (None, None)}


def test_pairs_equal_all_combinations(spark):
    rnd = random.Random(11)
    base = ["Snow Man", "SnowMan", "abcd", "abxcd", "ab cd ef", "ef cd ab", "longer name here", "longer name", "ぬい活", "IU", "iu", "xyz"]
    names = base + ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 9))).strip() or "q" for _ in range(60)]
    cands = [cand(f"k{i:02d}", n, "GROUP", seq=i) for i, n in enumerate(names)]
    feats = [(f"k{i:02d}", round(rnd.random() * 4, 2), ["SEARCH"], "people_music") for i in range(len(names))]
    got = pairs.unresolved_pairs(
        spark.createDataFrame(feats, "candidate_id string, primary_score double, source_families array<string>, lane string"),
        spark.createDataFrame(cands, CAND), max_pairs=10_000,
    ).collect()
    import re

    key = lambda n: re.sub(r"[\s\-_・:：/／]", "", n.lower())
    expected = {}
    for l, r in combinations(sorted(feats, key=lambda f: (-f[1], f[0])), 2):
        a, b = names[int(l[0][1:])], names[int(r[0][1:])]
        p = 0.12 + 0.08 + 0.05 + min(0.2, (l[1] + r[1]) * 0.02)
        ka, kb = key(a), key(b)
        if ka and ka == kb:
            p += 1.1 + 0.95
        if ka and kb and min(len(ka), len(kb)) >= 5 and (ka in kb or kb in ka):
            p += 0.45
        if SequenceMatcher(a=ka, b=kb).ratio() >= 0.88:
            p += 0.55
        ta, tb = set(a.lower().split()), set(b.lower().split())
        if ta and tb and len(ta & tb) / len(ta | tb) >= 0.67:
            p += 0.35
        if p >= 0.72:
            expected[l[0], r[0]] = round(p, 4)
    assert {(g.left_id, g.right_id): g.priority for g in got} == pytest.approx(expected)
    assert any(g.left_name in ("Snow Man", "SnowMan") and "sequence_ratio" in g.reasons and g.merge_recommended for g in got)


MENTION = (
    "candidate_id string, candidate_type string, name string, source_id string, source_item_id string, rank int, url string, "
    "title string, artist string, show string, from_title string"
)


def test_repeated_mentions_vanish_before_texts_are_cleaned(spark):
    """Columns that no relation reads make no further rows, and neighbours come straight from the items."""
    base = {"candidate_type": "PRODUCT", "source_id": "S", "source_item_id": "1", "rank": 1, "url": "u", "title": "t",
            "name": "n", "artist": "a", "show": "s", "from_title": ""}
    rows = [{**base, "candidate_id": c, "artist": f"a{i}", "show": f"s{i}", "title": f"t{i}", "rank": i, "name": f"n{i}"} for c in "xy" for i in range(50)]
    rows += [{**base, "candidate_id": "m", "candidate_type": "MUSIC_TRACK", "artist": "Star"},
             {**base, "candidate_id": "p", "candidate_type": "MUSIC_ARTIST", "name": "star!"}]
    mentions = spark.createDataFrame([tuple(r[c.split()[0]] for c in MENTION.split(", ")) for r in rows], MENTION)
    read = relations._read_columns(mentions)
    assert read.count() == 4
    items = relations.group_items(mentions)
    assert items.count() == 4
    assert {tuple(r) for r in relations.related_in_items(items).collect()} == {tuple(r) for r in relations.related_ids(relations.build_relations(items)).collect()}


def test_relations_from_one_item(spark):
    rows = [
        ("t", "MUSIC_TRACK", "Song", "S", "i1", 1, "", "", "The Artist", "", ""), ("a", "MUSIC_ARTIST", "the artist", "S", "i1", 1, "", "", "", "", ""),
        ("w", "REALITY_SHOW", "Show", "S", "i1", 1, "", "", "", "", ""), ("p", "PERSON", "P", "S", "i1", 1, "", "", "", "Show", "Show"),
        ("h", "HASHTAG", "#x", "S", "i1", 1, "", "", "", "", ""), ("o", "PHRASE", "y", "S", "i1", 1, "", "", "", "", ""),
        ("z", "PERSON", "Z", "S", "i2", 1, "", "", "", "", "Show"),
    ]
    built = relations.build_relations(relations.group_items(spark.createDataFrame(rows, MENTION)))
    rel = {(r.src_id, r.relation_type, r.dst_id): r.confidence for r in built.collect()}
    assert rel["t", "performed_by", "a"] == 0.96 and rel["a", "performs", "t"] == 0.96
    assert rel["p", "appears_in_reality_show", "w"] == 0.87 and rel["w", "has_cast", "p"] == 0.87
    node = "group:S:i1"
    assert rel["h", "about_via", node] == 0.84 and rel["o", "about_via", node] == 0.74 and rel["h", "co_occurs_via", node] == 0.55
    assert rel["p", "context_of", node] == 1.0 and not any(k[0] == "z" and "i1" in k[2] for k in rel)
    near = {tuple(r) for r in relations.related_ids(built).collect()}
    assert {("h", "o"), ("o", "h"), ("h", "p"), ("p", "h"), ("t", "a"), ("a", "t")} <= near and not any("z" in n for n in near)
    asked = spark.createDataFrame([("h",)], "candidate_id string")
    assert {tuple(r) for r in relations.related_ids(built, asked).collect()} == {n for n in near if n[0] == "h"}
    pairs_ = spark.createDataFrame([("h", "o"), ("p", "h"), ("a", "t"), ("p", "z"), ("p", "w")], "left_id string, right_id string")
    assert {tuple(r) for r in relations.already_related(pairs_, built).collect()} == {("h", "o"), ("p", "h"), ("a", "t"), ("p", "w")}


@pytest.mark.parametrize("members", [5, 64, 70, 200])
def test_groups_of_any_size_have_one_form(spark, members):
    rows = [(f"c{i % members}", "PHRASE", f"n{i}", "S", "hot", 1, "", "", "", "", "") for i in range(2 * members)]
    built = relations.build_relations(relations.group_items(spark.createDataFrame(rows, MENTION)))
    assert {(r.relation_type, r.dst_id) for r in built.collect()} == {("co_occurs_via", "group:S:hot"), ("about_via", "group:S:hot")}
    assert built.count() == 2 * members
    near = {tuple(r) for r in relations.related_ids(built).collect()}
    assert near == {(f"c{i}", f"c{j}") for i in range(members) for j in range(members) if i != j}


def test_evidence_rules(spark):
    rows = [
        (D0, "c", 1, "A", "t1", "u1", "m1"), (D0, "c", 2, "A", "t2", "u2", "m"), (D0, "c", 3, "B", "t", "", "m"), (D0, "c", 4, "B", "t", "", "m"),
        (D0, "c", 5, "C", "t", "u", ""), (D0, "c", 6, "D", "t", "u", ""), (D0, "c", 7, "A", "x", "u1", "m1"),
    ]
    pool = spark.createDataFrame(rows, "date date, candidate_id string, ordinal int, source_id string, title string, url string, metric string")
    assert sorted(r.ordinal for r in evidence.dedupe(pool).collect()) == [1, 2, 3, 5, 6]
    assert [(r.slot, r.source_id) for r in evidence.top_items(pool).orderBy("slot").collect()] == [(1, "A"), (2, "B"), (3, "C")]
    assert [e.source_id for e in evidence.collect_top(pool).first().evidence] == ["A", "A", "B", "C", "D"]


FEATURE = (
    "date date, candidate_id string, candidate_kind string, source_families array<string>, mass_heat double, broad_confirmation double, "
    "constrained_ent double, constrained_beauty double, realtime_support double, public_gate_passed boolean, public_rankability_prob double, public_noise_penalty double"
)


def feature(day, fams, heat=0.1, cid="c", **kw):
    return (D0 + dt.timedelta(day), cid, kw.get("kind", "ENTITY"), fams, heat, 0.0, 0.0, 0.0, 0.0, False, 0.1, 0.6)


def test_label_case(spark):
    df = spark.createDataFrame([feature(0, ["SEARCH"]), feature(7, ["SEARCH", "MUSIC_CHART"], 1.2)], FEATURE)
    r = labels.build_labels(df, labels.label_plan(df, "2024-03-08")).where("date = DATE'2024-03-01'").first()
    assert r.breakout_7d and not r.breakout_1d and r.mass_7d and r.lead_days == 7
    assert r.new_confirmation_families == ["MUSIC_CHART"] and not r.mass_now


def test_label_merge_is_monotone(spark):
    df = spark.createDataFrame([feature(0, ["SEARCH"]), feature(7, ["MUSIC_CHART"], 1.2)], FEATURE)
    early = labels.build_labels(df, labels.label_plan(df, "2024-03-04"))
    late = labels.build_labels(df, labels.label_plan(df, "2024-03-08"))
    merged = labels.merge_labels(early, late)
    r = merged.where("date = DATE'2024-03-01'").first()
    assert r.breakout_7d and r.breakout_horizons == [1, 3, 7]
    again = labels.merge_labels(merged, late)
    assert {tuple(map(str, x)) for x in again.collect()} == {tuple(map(str, x)) for x in merged.collect()}


def test_posterior_case(spark):
    sf = spark.createDataFrame(
        [(D0, c, "S", "HASHTAG", "TOPIC", "DISCOVERY", "SOCIAL_DISCOVERY", ["JP"]) for c in ("a", "b")],
        "date date, candidate_id string, source_id string, candidate_type string, candidate_kind string, source_role string, family_primary string, countries array<string>",
    )
    flags = ", ".join(f"{f} boolean" for f in labels.FLAGS)
    lab = spark.createDataFrame(
        [(D0, "a", *[f == "breakout_7d" for f in labels.FLAGS], 3, [1, 3, 7], [3, 7]), (D0, "b", *[False] * len(labels.FLAGS), None, [1, 3, 7], [3, 7])],
        f"date date, candidate_id string, {flags}, lead_days int, breakout_horizons array<int>, mass_horizons array<int>",
    )
    post = learning.posteriors(learning.accumulate(sf, lab))
    rows = post.collect()
    assert len(rows) == 2 and all(r.observations == 2 and 0 < r.reliability < 1 for r in rows)
    source = next(r for r in rows if r.region_bucket is None)
    assert source.reliability == pytest.approx(5 / 10) and source.mean_lead_days == pytest.approx(15 / 7)
    resolved = learning.resolve_posteriors(sf, post).first()
    assert resolved.posterior_bucket == "S|HASHTAG|DISCOVERY|JP" and resolved.posterior_multiplier > 0.7
    unknown = learning.resolve_posteriors(sf.withColumn("source_id", F.lit("other")), post).first()
    assert (unknown.posterior_reliability, unknown.posterior_multiplier) == (1.0, 1.0)


def test_independence_and_stability(spark):
    recs = [(D0 + dt.timedelta(d), s, not (s == "B" and d == 1)) for d in range(2) for s in "ABC"]
    records = spark.createDataFrame(recs, "date date, source_id string, ok boolean")
    tops = [(D0 + dt.timedelta(d), s, c, 1.0) for d in range(2) for s, cs in (("A", "xy"), ("B", "xy"), ("C", "zw")) for c in cs]
    top = spark.createDataFrame(tops, "date date, source_id string, candidate_id string, momentum double")
    ind = {r.source_id: r.independence for r in weights.independence(records, top).collect()}
    assert ind["A"] < ind["C"] == 1.0 and ind["B"] < ind["C"]
    assert {r.source_id: r.stability for r in weights.stability(records).collect()} == {"A": 1.0, "B": 0.5, "C": 1.0}


def test_predictive_prefers_the_foreteller(spark):
    records = spark.createDataFrame([(D0 + dt.timedelta(d), s, True) for d in (0, 1) for s in "ABC"], "date date, source_id string, ok boolean")
    tops = [(0, "A", "x"), (0, "B", "y"), (0, "C", "q"), (1, "C", "x"), (1, "A", "x"), (1, "B", "x")]
    top = spark.createDataFrame([(D0 + dt.timedelta(d), s, c, 1.0) for d, s, c in tops], "date date, source_id string, candidate_id string, momentum double")
    priors = spark.createDataFrame([(s, 1.0) for s in "ABC"], "source_id string, prior double")
    cfg = dims.WeightingConfig(window_days=1, horizon_days=1, top_k_for_future=1)
    got = {r.source_id: r.predictive for r in weights.predictive_f1(records, top, priors, cfg).collect()}
    assert got["A"] > 0.99 and got["B"] == 0 and got["C"] == 0


def test_predictive_compares_scores_to_nine_digits(spark):
    records = spark.createDataFrame([(D0 + dt.timedelta(d), s, True) for d in (0, 1) for s in "ABCD"], "date date, source_id string, ok boolean")
    # 0.1 + 0.2 is above 0.3 only in its last digit: the tie goes to the smaller id.
    tops = [(0, "A", "a", 1.0), (1, "B", "b", 0.1), (1, "C", "b", 0.2), (1, "D", "a", 0.3)]
    top = spark.createDataFrame([(D0 + dt.timedelta(d), s, c, m) for d, s, c, m in tops], "date date, source_id string, candidate_id string, momentum double")
    priors = spark.createDataFrame([(s, 1.0) for s in "ABCD"], "source_id string, prior double")
    cfg = dims.WeightingConfig(window_days=1, horizon_days=1, top_k_for_future=1)
    got = {r.source_id: r.predictive for r in weights.predictive_f1(records, top, priors, cfg).collect()}
    assert got["A"] > 0.99


def test_settings_defaults(spark):
    rows = [("APPLE_MUSIC_KR", None, None, None, 10, None), ("NETFLIX_TV_JP", None, None, None, None, None), ("X", 0.5, 1.0, 0, None, 7)]
    df = spark.createDataFrame(rows, "source_id string, region_weight double, lag_days double, granularity int, fetch_limit int, top_m int")
    got = {r.source_id: (r.region_weight, r.lag_days, r.granularity, r.top_m) for r in weights.source_settings(df).collect()}
    assert got == {"APPLE_MUSIC_KR": (0.85, 0.5, 10, 10), "NETFLIX_TV_JP": (1.0, 3.5, 50, 20), "X": (0.5, 1.0, 1, 7)}


def test_reliability_bins_and_brier(spark):
    p = spark.createDataFrame([(D0, "v", 0.8, 1.0), (D0, "v", 1.0, 1.0)], "date date, variant string, p double, y double")
    rows = evaluation.reliability(p).orderBy("bin").collect()
    assert [r.n for r in rows] == [0, 0, 0, 0, 2] and rows[4].upper == 1.0
    assert evaluation.brier(p.limit(1), "x").first().x_brier == pytest.approx(0.04)


def test_publish_health_reasons(spark):
    rec = spark.createDataFrame([(D0, "TVER_RANKING_JP", "healthy")], "date date, source_id string, failure_class string")
    items = spark.createDataFrame([(D0, 1, "people_music", "PERSON", 0.9, ["SEARCH"])], "date date, rank int, lane string, candidate_type string, maturity double, source_families array<string>")
    r = health.publish_health(rec, dims.catalog_df(spark), items).first()
    assert "healthy_core_sources<6:1" in r.reasons and "words_behaviors_top20<1:0" in r.reasons and r.shadow_only


def test_availability_of_empty_groups(spark):
    log = spark.createDataFrame([(D0, "APPLE_MUSIC_JP", True, 3), (D0, "BILLBOARD_JAPAN", True, 0)], "date date, source_id string, ok boolean, item_count int")
    plan = dims.catalog_df(spark).where(F.col("source_id").isin("APPLE_MUSIC_JP", "BILLBOARD_JAPAN")).withColumn("enabled", F.lit(True))
    r = health.availability(log, plan).first()
    assert (r.core_availability, r.music_availability, r.show_availability, r.search_availability) == (0.5, 0.5, 1.0, 0.0)


def test_decided_pairs_hold_every_neighbour_of_a_name(spark, tmp_path, monkeypatch):
    from oracle_check import canonical, compare, connect
    from settings import SF_DIR
    from swellcast.plans import queries_ops as Q

    # Small blocks, so that most neighbours lie in different ones.
    monkeypatch.setattr(Q, "_KEYS_AT_ONCE", 4)
    part = spark.read.parquet(f"{SF_DIR}/part.parquet").select("p_name", "p_partkey").collect()
    by_name = {}
    for r in sorted(part, key=lambda r: r.p_partkey):
        by_name.setdefault(r.p_name, []).append(f"c{r.p_partkey}")
    want = {pair for ids in by_name.values() for pair in zip(ids, ids[1:], strict=False)}
    got = Q._namesakes(spark, SF_DIR).collect()
    assert {(r.left_id, r.right_id) for r in got} == want and len(got) == len(want)
    con = connect(SF_DIR)
    for name, rows in (("apply_decisions", None), ("decision_cache", len(want))):
        df = Q.QUERIES[name](spark, SF_DIR)
        cur = con.execute(Q.ORACLES[name])
        found = [tuple(r) for r in df.collect()]
        assert rows is None or len(found) == rows
        assert compare(canonical(df.columns, found), canonical([c[0] for c in cur.description], cur.fetchall())) is None


def test_manual_merge_order(spark):
    cands = spark.createDataFrame([
        cand("a", "Alpha", aliases=["AL"], ext={"p": "1"}, related=["z", "b"]), cand("b", "Beta", aliases=["alpha", "B!"], ext={"p": "2", "q": "3"}),
        cand("c", "Gamma"),
    ], CAND)
    edits = spark.createDataFrame(
        [("e1", "a", "b", "merge", "a", "2024-01-01", "me"), ("e2", "b", "c", "link", None, "2024-01-02", "me")],
        "edit_id string, left_id string, right_id string, action string, winner_id string, decided_at string, decided_by string",
    )
    ready, later = pairs.ready_edits(edits)
    assert [r.edit_id for r in ready.collect()] == ["e1"] and [r.edit_id for r in later.collect()] == ["e2"]
    updated, rel = pairs.apply_edits(ready, cands)
    got = {r.candidate_id: r for r in updated.collect()}
    assert got["a"].aliases == ["AL", "Beta", "B"] and got["a"].related_ids == ["z"] and got["a"].external_ids == {"p": "1", "q": "3"}
    assert got["b"].status == "MERGED" and got["b"].merged_into == "a" and got["a"].manual_lock and rel.count() == 0
    link, rel = pairs.apply_edits(later, cands)
    assert {r.candidate_id: r.related_ids for r in link.collect()} == {"b": ["c"], "c": ["b"]} and rel.count() == 2
    log = pairs.change_log(cands, pairs.overlay(cands, updated)).collect()
    assert {r.candidate_id for r in log} == {"a", "b"}


def test_all_edits_apply_in_order(spark):
    cands = spark.createDataFrame([cand("a", "Alpha"), cand("b", "Beta", aliases=["B2"]), cand("c", "Gamma"), cand("d", "Delta")], CAND)
    edits = spark.createDataFrame(
        [("e2", "a", "c", "merge", "c", "2024-01-02", "me"), ("e1", "a", "b", "merge", "a", "2024-01-01", "me"), ("e3", "c", "d", "link", None, "2024-01-03", "me")],
        "edit_id string, left_id string, right_id string, action string, winner_id string, decided_at string, decided_by string",
    )
    after, rel = pairs.apply_all_edits(edits, cands, new_path(spark, "edits-test"))
    got = {r.candidate_id: r for r in after.collect()}
    assert got["c"].aliases == ["Alpha", "Beta", "B2"] and got["c"].merged_from == ["a"] and got["c"].related_ids == ["d"]
    assert got["a"].status == got["b"].status == "MERGED" and got["a"].merged_into == "c" and got["d"].related_ids == ["c"]
    assert {(r.src_id, r.dst_id) for r in rel.collect()} == {("c", "d"), ("d", "c")}


def test_upsert_keeps_missing_columns(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, s string")
    got = {r.k: (r.s, r.v) for r in tables.upsert(old, new, ["k"]).collect()}
    assert got == {1: ("a", 1.0), 2: ("x", 2.0), 3: ("y", None)}


def test_active_fallback(spark):
    df = spark.createDataFrame([("a", "MERGED")], "candidate_id string, status string")
    assert tables.active_or_all(df).count() == 1


def test_late_rows_leave_the_stream_state_alone(spark):
    base = new_path(spark, "late-test")
    schema = "candidate_id string, source_id string, date date, signal double, family_primary string"
    days = [[(0, 5.0), (2, 7.0)], [(1, 9.0), (3, 6.0)]]
    for i, batch in enumerate(days):
        rows = [("c", "s", D0 + dt.timedelta(d), x, "SEARCH") for d, x in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = SA.anomaly_stream(spark.readStream.schema(schema).parquet(f"{base}/in"))
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    rows = {r.date.day: r for r in spark.read.parquet(f"{base}/out").collect()}
    assert [d for d, r in sorted(rows.items()) if r.late] == [2]
    assert rows[4].n == 3


def test_stream_holds_its_state_over_missing_signals(spark):
    base = new_path(spark, "gap-test")
    schema = "candidate_id string, source_id string, date date, signal double, family_primary string"
    signals = [1.0, None, 2.0, 3.0, None, 9.0, 4.0, 60.0, 2.0, 2.0]
    rows = [("c", "s", D0 + dt.timedelta(i), x, "SEARCH") for i, x in enumerate(signals)]
    daily = spark.createDataFrame(rows, schema)
    want = {r.date: (r.m, r.v, r.n, r.anomaly, r.anomaly_lag1, r.anomaly_lag2) for r in anomaly.fold_history(daily).collect()}
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = SA.anomaly_stream(spark.readStream.schema(schema).parquet(f"{base}/in"))
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {r.date: (r.m, r.v, r.n, r.anomaly, r.anomaly_lag1, r.anomaly_lag2) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)
