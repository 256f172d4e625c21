"""As-of lookup, history scan, event-time front and merge chains against plain walks."""

from __future__ import annotations

import datetime
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from settings import SF_DIR

from swellcast import dims
from swellcast.dims import AlgorithmConfig
from swellcast.functions.numeric import decay_factor
from swellcast.operators import anomaly, asof, chains, health
from swellcast.sources import publications
from swellcast.streaming.days import DayFront

DAY = datetime.date(2020, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


# -- as-of ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("strict", [True, False])
def test_as_of_equals_a_walk(spark, strict):
    rng = random.Random(1)
    history = [(rng.choice("abc"), day(rng.randint(0, 200)), i, f"v{i}") for i in range(60)] + [("a", None, 1, "x"), (None, day(3), 2, "y")]
    asked = [(rng.choice("abcd"), day(rng.randint(0, 220)), i) for i in range(200)] + [("a", None, -1), (None, day(9), -2), ("a", day(9), -3)] * 2
    found = asof.as_of(
        spark.createDataFrame(asked, "k string, date date, tag int"), spark.createDataFrame(history, "k string, date date, x int, y string"),
        ["k"], "date", ["x", "y"], strict=strict, found_time="at", block_days=16).collect()

    def plain(k, d, tag):
        good = [(h[1], h[2], h[3]) for h in history if k and d and h[0] == k and h[1] and (h[1] < d or (not strict and h[1] == d))]
        best = max(good, default=(None, None, None))
        return k, d, tag, best[1], best[2], best[0]

    key = lambda r: str(r)
    assert sorted(map(tuple, found), key=key) == sorted((plain(*r) for r in asked), key=key)


# -- history scan --------------------------------------------------------------------------------------
SERIES = "date date, candidate_id string, source_id string, signal double, family_primary string, tag int"


def series(seed, lengths=(1, 3, 70, 300)):
    rng, rows = random.Random(seed), []
    families = [*AlgorithmConfig().family_params, "other"]
    for c in range(8):
        at = rng.randint(-100, 100)
        for i in range(lengths[c % len(lengths)]):
            at += rng.choice([1, 1, 2, 70])
            rows.append((day(at), f"c{c}", f"s{c % 2}", None if rng.random() < 0.1 else rng.random() * 60, families[c % len(families)], i))
    return rows


def walked(rows):
    cfg, state, out = AlgorithmConfig(), {}, {}
    for date, c, s, x, family, _ in sorted(rows, key=lambda r: r[:3]):
        m, v, n, s1, s2, s3 = state.get((c, s), (0.0, 0.0, 0, 0.0, 0.0, 0.0))
        if x is not None:
            p = cfg.params_for(family)
            a, x = decay_factor(p.half_life_days), min(x, cfg.max_x_clip)
            sig = 0.0 if n + 1 <= p.warmup_days else (x - max(m, cfg.beta)) / (math.sqrt(max(v, 0.0)) + cfg.beta)
            m, v, n, s1, s2, s3 = (1 - a) * m + a * x, (1 - a) * (v + a * (x - m) ** 2), n + 1, sig, s1, s2
        state[c, s] = out[c, s, date] = (m, v, n, s1, s2, s3)
    return out


def states(df):
    return {(r.candidate_id, r.source_id, r.date): (r.m, r.v, r.n, r.anomaly, r.anomaly_lag1, r.anomaly_lag2) for r in df.collect()}


def test_history_scan_equals_a_walk(spark):
    rows = series(2)
    got, want = states(anomaly.fold_history(spark.createDataFrame(rows, SERIES))), walked(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_history_resumes_from_a_state(spark):
    rows = [r for r in series(3, (1, 5, 40, 90)) if r[3] is not None]
    df, cut = spark.createDataFrame(rows, SERIES), day(60)
    early = anomaly.fold_history(df.where(df.date <= cut))
    state = anomaly.next_state(None, anomaly.newest(early))
    late = states(anomaly.fold_history(df.where(df.date > cut), state=state))
    want = walked(rows)
    assert late and all(late[k] == pytest.approx(want[k], abs=1e-9) for k in late)


# -- event-time front ----------------------------------------------------------------------------------
def test_front_closes_days_and_flags_late_rows(spark):
    rng = random.Random(4)
    at = lambda d, h=0: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=d, hours=h)
    batches = [[(at(d + rng.randint(0, 1), rng.randint(0, 23)), rng.choice("xy"), "s", "MUSIC_CHART", rng.random() * 9)
                for d in range(4 * b, 4 * b + 4) for _ in range(6)] for b in range(3)]
    batches[1].append((at(0), "x", "s", "MUSIC_CHART", 100.0))
    batches[2] += [(at(2), "x", "s", "MUSIC_CHART", 100.0), (None, "x", "s", "MUSIC_CHART", 1.0)]
    schema = "ts timestamp, candidate_id string, source_id string, family_primary string, metric_value double"
    front = DayFront(tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/front", delay_days=2)
    for number, rows in enumerate(batches):
        for _ in range(2):  # a repeated batch changes nothing
            front(spark.createDataFrame(rows, schema), number)

    newest, through, sums, late = None, None, {}, []
    for rows in batches:
        for ts, c, s, f, x in rows:
            if ts is None or (through is not None and ts.date() <= through):
                late.append((ts, c, s, f, x))
            else:
                sums.setdefault((ts.date(), c, s, f), []).append(x)
        newest = max([newest] if newest else [], default=None)
        seen = max(r[0] for r in rows if r[0])
        newest = seen if newest is None else max(newest, seen)
        through = (newest - datetime.timedelta(days=2)).date() - datetime.timedelta(days=1)
    want = walked([(d, c, s, sum(x), f, 0) for (d, c, s, f), x in sums.items() if d <= through])
    got = states(spark.read.parquet(f"{front.folder}/closed"))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    columns = ["ts", "candidate_id", "source_id", "family_primary", "metric_value"]
    found = sorted((tuple(r) for r in spark.read.parquet(f"{front.folder}/late").select(*columns).collect()), key=str)
    assert found == sorted(late, key=str) and len(late) == 3


# -- merge chains --------------------------------------------------------------------------------------
def test_survivors_equal_a_walk(spark):
    rng = random.Random(5)
    into = {f"n{i}": f"n{i + 1}" for i in range(40)}  # one long chain
    into |= {f"a{i}": f"a{rng.randint(0, 30)}" for i in range(20)}
    into |= {"x1": "x2", "x2": "x3", "x3": "x1", "y": "x2", "z5": "z4", "z4": "z3", "z3": "z2", "z2": "z1", "z1": "z2", "self": "self"}
    found = {r.candidate_id: (r.survivor, r.hops, r.cyclic) for r in chains.survivors(
        spark.createDataFrame([*into.items(), (None, "x"), ("q", None)], "candidate_id string, into string"),
        tempfile.mkdtemp(prefix="spark-", dir="/tmp")).collect()}

    def walk(start):
        path, here = [start], into[start]
        while here in into and here not in path:
            path.append(here)
            here = into[here]
        return (min(path[path.index(here):]), None, True) if here in path else (here, len(path), False)

    assert found == {k: walk(k) for k in into}


def test_redirects_take_the_last_merge(spark):
    rows = [("e1", "a", "b", "merge", None, "1"), ("e2", "b", "c", "merge", "c", "2"), ("e3", "b", "d", "link", "d", "3"), ("e4", "a", "a", "merge", None, "4")]
    edits = spark.createDataFrame(rows, "edit_id string, left_id string, right_id string, action string, winner_id string, decided_at string")
    assert {(r.candidate_id, r.into) for r in chains.redirects(edits).collect()} == {("b", "c")}


# -- publications --------------------------------------------------------------------------------------
def test_readers_see_committed_runs_only(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/published"
    rows = lambda n, days: spark.createDataFrame([(day(d), i) for d in days for i in range(n)], "date date, item int")
    both = lambda df: {"ranking": df, "shadow": df}
    count = lambda name: {(r.date, r.run_id): r["count"] for r in publications.read(spark, root, name).groupBy("date", "run_id").count().collect()}
    assert publications.publish(root, "a", both(rows(3, [0, 1]))) == {"ranking": 6, "shadow": 6}
    publications.write_collection(rows(9, [0, 1]), root, "ranking", "lost")
    assert count("ranking") == count("shadow") == {(day(0), "a"): 3, (day(1), "a"): 3}
    publications.publish(root, "b", both(rows(5, [1, 2])))
    expected = {(day(0), "a"): 3, (day(1), "b"): 5, (day(2), "b"): 5}
    assert count("ranking") == count("shadow") == expected
    assert {tuple(r) for r in publications.clean(spark, root, ["ranking", "shadow"]).collect()} == {("ranking", day(d), "lost") for d in (0, 1)}
    assert spark.read.parquet(f"{root}/ranking").where("run_id = 'lost'").count() == 0 and count("ranking") == expected
    assert {r.run_id: r.counts for r in publications.commits(spark, root).collect()} == {"a": {"ranking": 6, "shadow": 6}, "b": {"ranking": 10, "shadow": 10}}


def test_rollout_follows_both_variants(spark):
    fine = {"breakout_precision_7d": 0.5, "future_spread_7d": 1.0, "mature_people_music_ratio": 0.2, "healthy_core": 6, "discovery_count": 2,
            "confirmation_count": 2, "words_behaviors": 3, "write_ops": 100}
    rows = []
    for d in range(5):
        rows.append({"date": day(d), "variant": "shadow_v2", **fine, "breakout_precision_7d": 0.3 if d == 3 else 0.5})
        if d != 4:
            rows.append({"date": day(d), "variant": "public_main", **fine})
    rows.append({"date": day(9), "variant": "public_main", **fine})
    schema = "date date, variant string, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in fine.items())
    got = {r.date: (r.ready, list(r.reasons)) for r in health.rollout_by_day(spark.createDataFrame(rows, schema), window_days=2).collect()}
    low = "shadow_breakout_precision<0.5:0.4"
    assert got == {day(0): (False, ["insufficient_shadow_history:1/2"]), day(1): (True, []), day(2): (True, []), day(3): (False, [low]),
                   day(4): (False, ["missing_public_baseline:1/2", "shadow_breakout_precision<0.5:0.4"])}
    none = health.rollout_readiness(spark.createDataFrame([], schema)).first()
    assert (none.ready, none.window_size, list(none.reasons)) == (False, 0, ["insufficient_shadow_history:0/14"])


def test_shuffles_are_cut_by_size(spark):
    # 24 MB of noise: one task must not get a fixed share of whatever the input is.
    noise = spark.range(3_000_000).select(F.xxhash64("id").alias("k"))
    assert noise.repartition("k").rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_metric_details_are_worked_out_once_per_mention(spark):
    from swellcast.operators import source_features as A
    from swellcast.sources import bindings as B

    mentions = A.with_catalog(B.event_mentions(spark, SF_DIR), dims.catalog_df(spark))
    plan = A._facts(mentions)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    # The names are classified below the explode, not once per fact above it.
    assert "AS inferred_pack" not in above and "AS inferred_pack" in below
