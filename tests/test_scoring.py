"""Anomaly, fusion and ranking against hand-made cases and plain-Python walks."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.functions import numeric as N
from swellcast.operators import anomaly, features, fusion, ranking, weights
from swellcast.operators import source_features as A
from swellcast.plans import events as P

DAY = dt.date(2024, 3, 1)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_formula_cases(spark):
    assert N.decay_factor(7) == pytest.approx(0.0943, abs=1e-4)
    assert N.decay_factor(0) == 1.0
    lit = F.lit
    r = one(
        spark,
        N.significance(lit(10.0), lit(5.0), lit(1.0), 0.1).alias("a"),
        N.significance(lit(5.0), lit(0.01), lit(0.01), 0.1).alias("b"),
        N.momentum(lit(3.0), lit(2.0), lit(1.0), lit(0.7)).alias("c"),
        N.momentum(lit(-5.0), lit(-3.0), lit(2.0), lit(0.7)).alias("d"),
        N.multi_source_bonus(lit(5)).alias("e"),
        N.rank_exposure(lit(0)).alias("f"),
    )
    assert r.a == pytest.approx(5 / 1.1) and r.b == pytest.approx(24.5)
    assert r.c == pytest.approx(4.89) and r.d == pytest.approx(0.98)
    assert r.e == 3 and r.f == 1.0


def series(n_keys=20, days=12, seed=3):
    rnd = random.Random(seed)
    rows = []
    for k in range(n_keys):
        family = rnd.choice(["SEARCH", "MUSIC_CHART", "REFERENCE"])
        for d in range(days):
            if rnd.random() < 0.6:
                rows.append((f"c{k}", f"s{k % 3}", DAY + dt.timedelta(days=d), rnd.choice([0.5, 3.0, 1000.0]) * rnd.random(), family))
    return rows


SERIES_SCHEMA = "candidate_id string, source_id string, date date, signal double, family_primary string"


def walk(rows):
    """Plain loop over each series."""
    cfg, state, out = dims.AlgorithmConfig(), {}, {}
    for c, s, d, x, fam in sorted(rows, key=lambda r: r[2]):
        p = cfg.params_for(fam)
        m, v, n, s1 = state.get((c, s), (0.0, 0.0, 0, 0.0))
        a, x = N.decay_factor(p.half_life_days), min(x, 50.0)
        sig = 0.0 if n + 1 <= p.warmup_days else (x - max(m, 0.1)) / (math.sqrt(max(v, 0)) + 0.1)
        state[c, s] = ((1 - a) * m + a * x, (1 - a) * (v + a * (x - m) ** 2), n + 1, sig)
        out[c, s, d] = (state[c, s][0], state[c, s][1], n + 1, sig, s1)
    return out


def test_fold_equals_loop_and_ignores_row_order(spark):
    rows = series()
    expected = walk(rows)
    for seed in (1, 2):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        got = anomaly.fold_history(spark.createDataFrame(shuffled, SERIES_SCHEMA)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.m, r.v, r.n, r.anomaly, r.anomaly_lag1) == pytest.approx(expected[r.candidate_id, r.source_id, r.date])


def test_incremental_steps_equal_fold(spark):
    rows = series(8, 5)
    expected = walk(rows)
    state, seen = None, 0
    for d in sorted({r[2] for r in rows}):
        day = spark.createDataFrame([r for r in rows if r[2] == d], SERIES_SCHEMA)
        stepped = anomaly.advance_state(state, day).cache()
        for r in stepped.collect():
            seen += 1
            assert (r.m, r.v, r.n, r.anomaly, r.anomaly_lag1) == pytest.approx(expected[r.candidate_id, r.source_id, r.date])
        table = anomaly.next_state(state, stepped).collect()
        state = spark.createDataFrame(table, "candidate_id string, source_id string, m double, v double, n long, s1 double, s2 double, last_date date")
    assert seen == len(rows)


def test_missing_signal_keeps_state(spark):
    rows = [("c", "s", DAY, 5.0, "SEARCH"), ("c", "s", DAY + dt.timedelta(1), None, "SEARCH"), ("c", "s", DAY + dt.timedelta(2), 5.0, "SEARCH")]
    got = {r.date: r for r in anomaly.fold_history(spark.createDataFrame(rows, SERIES_SCHEMA)).collect()}
    first, gap = got[DAY], got[DAY + dt.timedelta(1)]
    assert (gap.m, gap.v, gap.n) == (first.m, first.v, first.n)


def test_calibration_is_monotone(spark):
    for knots in (N.BREAKOUT_KNOTS, N.MASS_KNOTS):
        rows = spark.range(0, 1001).select(N.calibrate(F.col("id") / 1000.0, knots).alias("p")).collect()
        values = [r.p for r in rows]
        assert values == sorted(values) and values[0] == 0.0 and values[-1] == 1.0


ENTRY_SCHEMA = (
    "date date, candidate_id string, candidate_type string, work_cluster_id string, direct_support_total double, "
    "selection_score double, lane string"
)


def entries(n=300, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = rnd.choice(["PERSON", "GROUP", "SHOW", "PHRASE", "STYLE", "BRAND"])
        # One cluster holds about half of the person-like rows.
        cluster = rnd.choice(["hot", "hot", "a", "b", ""])
        out.append((DAY, f"k{i:03d}", t, cluster, rnd.choice([0.0, 0.2]), round(rnd.random() * 5, 1), dims.LANE_BY_TYPE[t]))
    return out


@pytest.mark.parametrize("top_k,low,high", [(20, 1, 2), (50, 2, 3)])
def test_cluster_cap_equals_walk(spark, top_k, low, high):
    rows = entries()
    counts, kept = {}, set()
    for r in sorted(rows, key=lambda r: (-r[5], r[1])):
        if r[2] not in dims.PERSON_TYPES or not r[3]:
            kept.add(r[1])
            continue
        cap = high if r[4] >= 0.08 else low
        if counts.get(r[3], 0) < cap:
            counts[r[3]] = counts.get(r[3], 0) + 1
            kept.add(r[1])
    got = ranking.cap_clusters(spark.createDataFrame(rows, ENTRY_SCHEMA), top_k).collect()
    assert {r.candidate_id for r in got} == kept


def greedy(rows, k):
    """Reference walk of the soft-quota pick."""
    q = dims.SOFT_QUOTA
    lanes = {}
    for r in sorted(rows, key=lambda r: (-r[5], r[1])):
        lanes.setdefault(r[6], []).append(r)
    n = dict.fromkeys(dims.LANES, 0)
    out = []
    while len(out) < k:
        need_w = max(0, int(k * q["words_behaviors_min_ratio"] + 0.999) - n["words_behaviors"])
        need_s = max(0, int(k * q["style_products_min_ratio"] + 0.999) - n["style_products"])
        forced = set()
        if k - len(out) <= need_w + need_s:
            forced |= {"words_behaviors"} if need_w and lanes.get("words_behaviors") else set()
            forced |= {"style_products"} if need_s and lanes.get("style_products") else set()
        best = None
        for lane, rest in lanes.items():
            if not rest or (forced and lane not in forced):
                continue
            if lane == "people_music" and n[lane] >= max(1, int(k * q["people_music_max_ratio"])):
                if any(v for o, v in lanes.items() if o != lane):
                    continue
            bonus = 0.0
            if lane == "words_behaviors" and n[lane] == 0:
                bonus = 0.08
            elif lane == "style_products" and n[lane] == 0:
                bonus = 0.06
            elif lane == "shows_formats" and n[lane] < max(1, int(k * q["shows_formats_target_ratio"])):
                bonus = 0.03
            if best is None or rest[0][5] + bonus > best[0]:
                best = (rest[0][5] + bonus, lane)
        if best is None:
            break
        out.append(lanes[best[1]].pop(0)[1])
        n[best[1]] += 1
    return out


@pytest.mark.parametrize("k,n", [(5, 300), (20, 300), (20, 12), (50, 300)])
def test_interleave_equals_greedy(spark, k, n):
    rows = entries(n)
    got = ranking.interleave(spark.createDataFrame(rows, ENTRY_SCHEMA), k).orderBy("rank").collect()
    assert [r.candidate_id for r in got] == greedy(rows, k)
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_ranking_is_dense_and_short_enough(spark):
    from settings import SF_DIR

    rows = ranking.rank_candidates(P.candidate_features(spark, SF_DIR)).groupBy("date").agg(
        F.count("*").alias("n"), F.max("rank").alias("m"), F.countDistinct("rank").alias("d")
    ).collect()
    assert rows and all(r.n <= 20 and r.n == r.m == r.d for r in rows)


def test_weights_average_to_one(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 3.0), ("c", 1.0)], "source_id string, w double")
    assert weights.normalize_mean_one(df, "w", "x").agg(F.avg("x")).first()[0] == pytest.approx(1.0)
    zero = weights.normalize_mean_one(df.withColumn("w", F.lit(0.0)), "w", "x").collect()
    assert {r.x for r in zero} == {1.0}


def mention(ordinal, cand="c1", source="APPLE_MUSIC_JP", **kw):
    row = dict(
        date=DAY, source_id=source, candidate_id=cand, candidate_type="PERSON", candidate_kind="ENTITY",
        metric_value=1.0, rank=1, confidence_rank=0, ordinal=ordinal, countries=["KR", "JP"],
        country_ranks={"JP": 4}, region="JP", regional_score=None, query_variants=None, derived_from_work=False,
        work_cluster_id=None, surface=None, name="n", domain_class="OTHER",
    )
    row.update(kw)
    return row


MENTION_SCHEMA = (
    "date date, source_id string, candidate_id string, candidate_type string, candidate_kind string, metric_value double, "
    "rank int, confidence_rank int, ordinal long, countries array<string>, country_ranks map<string,int>, region string, "
    "regional_score double, query_variants array<string>, derived_from_work boolean, work_cluster_id string, surface string, "
    "name string, domain_class string"
)


def test_mention_rollup(spark):
    rows = [
        mention(3, metric_value=2.0, country_ranks={"JP": 2, "KR": 9}, domain_class="FASHION_BEAUTY", confidence_rank=2),
        mention(1, regional_score=0.5, work_cluster_id="w1", derived_from_work=True, query_variants=["b", "a"]),
        mention(2, domain_class="CONSUMER_CULTURE", work_cluster_id="w2", regional_score=0.9, countries=["TH"]),
    ]
    df = A.with_catalog(spark.createDataFrame(rows, MENTION_SCHEMA), dims.catalog_df(spark))
    r = A.aggregate_mentions(df).first()
    assert (r.signal, r.observation_count, r.confidence, r.domain_class) == (4.0, 3, "HIGH", "CONSUMER_CULTURE")
    assert r.countries == ["JP", "KR", "TH"] and r.country_ranks == {"JP": 2, "KR": 9}
    assert r.work_cluster_id == "w2" and r.derived_from_work and r.regional_score == 0.9
    assert r.query_variants == ["a", "b"] and r.first_ordinal == 1


def test_mention_is_hardly_more_than_one_fact(spark):
    rows = [
        mention(1, countries=["JP"], country_ranks={"JP": 3}, region="Tokyo"),
        mention(2, countries=[], country_ranks={"KR": 5, "US": None}, region=None),
        mention(3, countries=["JP", "TH"], country_ranks={"JP": 2}, region=None),
        mention(4, countries=[], country_ranks=None, region=None),
    ]
    df = A.with_catalog(spark.createDataFrame(rows, MENTION_SCHEMA), dims.catalog_df(spark))
    # A country with its rank is one fact, and the metrics need no fact of their own: 2, 1, 2 and 1.
    assert A._facts(df).count() == 6 and A._facts(df).where("is_metric").count() == 4
    r = A.aggregate_mentions(df).first()
    assert (r.signal, r.observation_count, r.first_ordinal) == (4.0, 4, 1)
    assert r.countries == ["JP", "TH"] and r.country_ranks == {"JP": 2, "KR": 5} and r.regions == ["Tokyo"]


def test_relation_only_person_never_passes(spark):
    rows = [mention(i, source="TVER_RANKING_JP", derived_from_work=True, work_cluster_id="w1", date=DAY + dt.timedelta(i)) for i in range(4)]
    sf = A.build_source_features(spark.createDataFrame(rows, MENTION_SCHEMA), dims.catalog_df(spark))
    agg = features.with_backfill_state(features.aggregate_candidates(sf, dims.domain_fit_df(spark)))
    cand = features.score_candidate_text(
        spark.createDataFrame([("c1", "someone", "ENTERTAINMENT")], "candidate_id string, display_name string, domain_class string")
    )
    df = fusion.fuse(features.derive(features.with_relation_support(features.with_candidate_state(agg, cand), None)))
    got = df.collect()
    assert all(r.relation_only_flag and not r.public_gate_passed for r in got)
    assert df.where("direct_support_total > 0").count() == 0


def test_roll_forward_keeps_seven(spark):
    feats = spark.createDataFrame([("a", 2.0, 1.0, ["SEARCH"])], "candidate_id string, primary_score double, mass_heat double, source_families array<string>")
    state = spark.createDataFrame(
        [("a", 1.0, [float(i) for i in range(7)], ["X"]), ("b", 0.3, [1.0], ["Y"])],
        "candidate_id string, maturity double, history array<double>, source_families array<string>",
    )
    got = {r.candidate_id: r for r in features.roll_forward(state, feats).collect()}
    assert got["a"].history == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 2.0] and got["a"].maturity == pytest.approx(1.0)
    assert got["b"].maturity == 0.3


def test_scoring_plan_stays_in_the_jvm(spark):
    from settings import SF_DIR

    for build in (P.build_source_features, P.derived):
        plan = build(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in plan
