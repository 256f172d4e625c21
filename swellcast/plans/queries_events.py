"""Registered queries over the events binding: anomaly, features, fusion, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.functions import numeric as N
from swellcast.operators import anomaly, evidence, features, fusion, ranking
from swellcast.operators import source_features as A
from swellcast.plans import events as P
from swellcast.plans import oracle_events as O
from swellcast.plans import sqltext as S
from swellcast.plans.shared import joined, r6
from swellcast.sources import bindings as B

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _r(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


# --- anomaly -----------------------------------------------------------------------------


@query("daily_surprise_topk", O.chain(*O.TO_SF, tail="""
SELECT date, candidate_id, round(day_score, 6) AS day_score, discovery, rank FROM (
  SELECT date, candidate_id, day_score, discovery,
    row_number() OVER (PARTITION BY date ORDER BY round(day_score, 9) DESC, candidate_id) AS rank
  FROM (SELECT date, candidate_id, sum(surprise01) AS day_score,
          round(coalesce(sum(surprise01) FILTER (WHERE role = 'DISCOVERY'), 0), 6) AS discovery
        FROM sf GROUP BY ALL))
WHERE rank <= 20"""))
def daily_surprise_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: events to the 20 most surprising candidates of every day."""
    sf = P.source_features(spark, sf_dir)
    day = sf.groupBy("date", "candidate_id").agg(
        F.sum("surprise01").alias("day_score"),
        F.round(
            F.coalesce(F.sum(F.when(F.col("source_role") == "DISCOVERY", F.col("surprise01"))), F.lit(0.0)), 6
        ).alias("discovery"),
    )
    # Nine digits decide the order, so ties do not hang on summation order.
    top = ranking.top_k_per_day(day.withColumn("_s", F.round("day_score", 9)), 20, "_s")
    return top.select("date", "candidate_id", r6("day_score"), "discovery", "rank")


@query("ewma_state", O.chain(O.MENTIONS, O.FOLD, tail=f"""
SELECT date, candidate_id, source_id, rn AS n, {_r('signal', 'm', 'v')} FROM stepped"""))
def ewma_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.source_features(spark, sf_dir).select(
        "date", "candidate_id", "source_id", "n", *r6("signal", "m", "v")
    )


@query("significance_momentum", O.chain(*O.TO_SF, tail=f"""
SELECT date, candidate_id, source_id, {_r('s1', 's2', 's3', 'momentum_raw', 'surprise_base', 'source_score')},
  round(1 / log2(first_ord % 50 + 2), 6) AS exposure FROM sf"""))
def significance_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sf = P.source_features(spark, sf_dir)
    named = {"anomaly": "s1", "anomaly_lag1": "s2", "anomaly_lag2": "s3"}
    return sf.select(
        "date", "candidate_id", "source_id",
        *[F.round(k, 6).alias(v) for k, v in named.items()],
        *r6("momentum_raw", "surprise_base", "source_score"),
        F.round(N.rank_exposure(F.lit(1) + F.col("first_ordinal") % 50), 6).alias("exposure"),
    )


@query("source_features", O.chain(*O.TO_SF, tail="""
SELECT date, candidate_id, source_id, role AS source_role, family AS family_primary, domain AS domain_class,
  round(signal, 6) AS signal, obs AS observation_count, ['LOW', 'MEDIUM', 'HIGH'][conf + 1] AS confidence,
  array_to_string(list_concat(list_filter(countries, lambda c: c = 'JP'), list_filter(countries, lambda c: c <> 'JP')), ',') AS countries,
  coalesce(array_to_string(regions, ','), '') AS regions, coalesce(work, '') AS work_cluster_id, derived AS derived_from_work,
  best_rank, round(surprise01, 6) AS surprise01 FROM sf"""))
def source_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.source_features(spark, sf_dir).select(
        "date", "candidate_id", "source_id", "source_role", "family_primary", "domain_class",
        r6("signal"), "observation_count", "confidence", joined("countries"), joined("regions"),
        F.coalesce("work_cluster_id", F.lit("")).alias("work_cluster_id"), "derived_from_work",
        F.array_min(F.map_values("country_ranks")).alias("best_rank"), r6("surprise01"),
    )


@query("shared_metadata", O.chain(O.MENTIONS, tail="""
SELECT date, candidate_id, source_id, array_to_string(list_sort(list(k || '=' || v)), ';') AS metadata FROM (
  SELECT date, candidate_id, source_id, k, arg_max(v, event_id) AS v FROM (
    SELECT date, candidate_id, source_id, event_id, 'show' AS k, work AS v FROM mentions
    UNION ALL SELECT date, candidate_id, source_id, event_id, 'region', region FROM mentions
    UNION ALL SELECT date, candidate_id, source_id, event_id, 'trendCategory', stated FROM mentions)
  WHERE coalesce(v, '') <> '' GROUP BY ALL)
GROUP BY ALL"""))
def shared_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last non-empty value of each shared metadata key."""
    mentions = B.event_mentions(spark, sf_dir).withColumn(
        "extra",
        F.create_map(
            F.lit("show"), "work_cluster_id", F.lit("region"), "region", F.lit("trendCategory"), "domain_class"
        ),
    )
    merged = A.merge_shared_metadata(mentions)
    text = F.array_join(
        F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"
    )
    return merged.select("date", "candidate_id", "source_id", text.alias("metadata"))


# --- candidate features ---------------------------------------------------------------------

_FAMILY = ("discovery_rise", "broad_confirmation", "editorial_support", "commerce_support",
           "music_confirmation", "show_confirmation", "cross_family_confirm", "lead_lag_bonus",
           "redundancy_penalty")


@query("family_rollup", O.chain(*O.TO_ROLL, tail=f"""
SELECT date, candidate_id, {_r(*_FAMILY)}, source_count, family_count,
  array_to_string(source_families, ',') AS source_families, has_discovery, has_confirmation FROM roll"""))
def family_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.aggregated(spark, sf_dir).select(
        "date", "candidate_id", *r6(*_FAMILY), "source_count", "family_count", joined("source_families"),
        "has_discovery", "has_confirmation",
    )


@query("domain_fit_confidence", O.chain(*O.TO_ROLL, tail=f"""
SELECT date, candidate_id, candidate_type, domain_class, {_r('domain_fit', 'extraction_confidence')} FROM roll"""))
def domain_fit_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.aggregated(spark, sf_dir).select(
        "date", "candidate_id", "candidate_type", F.col("feature_domain").alias("domain_class"),
        *r6("domain_fit", "extraction_confidence"),
    )


@query("novelty_presence", O.chain(*O.TO_DERIVED, tail=f"""
SELECT date, candidate_id, positive_days,
  {_r('positive_sum', 'maturity', 'novelty', 'sustained_presence', 'maturity_penalty', 'mature_mass_only_penalty')} FROM derived"""))
def novelty_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.derived(spark, sf_dir, with_relations=False).select(
        "date", "candidate_id", "positive_days",
        *r6("positive_sum", "maturity", "novelty", "sustained_presence", "maturity_penalty",
            "mature_mass_only_penalty"),
    )


@query("support_metrics", O.chain(*O.TO_DERIVED, tail=f"""
SELECT date, candidate_id, {_r('direct_support_total', 'direct_confirmation_support', 'dominant_work_ratio',
  'omnipresence_penalty', 'same_work_cluster_penalty')}, same_work AS same_work_relation_count,
  distinct_works AS distinct_work_clusters, work_cluster_id, relation_only_flag FROM derived"""))
def support_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidate_features(spark, sf_dir).select(
        "date", "candidate_id",
        *r6("direct_support_total", "direct_confirmation_support", "dominant_work_ratio",
            "omnipresence_penalty", "same_work_cluster_penalty"),
        "same_work_relation_count", "distinct_work_clusters", "work_cluster_id", "relation_only_flag",
    )


@query("region_priority", O.chain(*O.TO_ROLL, tail=f"""
SELECT date, candidate_id, sv_home AS sv_primary_home, coalesce(len(sv_countries), 0) AS sv_country_count,
  coalesce(len(list_filter(sv_countries, lambda c: c <> 'JP')), 0) AS sv_other_country_count,
  {_r('sv_region_score', 'sv_priority_score')}, sv_surfaces AS sv_surface_count, best_surface FROM roll"""))
def region_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.aggregated(spark, sf_dir).select(
        "date", "candidate_id", "sv_primary_home", "sv_country_count", "sv_other_country_count",
        *r6("sv_region_score", "sv_priority_score"), "sv_surface_count", "best_surface",
    )


@query("market_relevance", O.chain(*O.TO_DERIVED, tail=f"""
SELECT date, candidate_id, {_r('home_relevance', 'constrained_ent', 'constrained_beauty', 'realtime_support',
  'home_credibility', 'adjusted_credibility', 'public_noise_penalty', 'topic_specificity', 'behavior_objectness')} FROM derived"""))
def market_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home-market relevance, constrained search support and public noise."""
    return P.derived(spark, sf_dir, with_relations=False).select(
        "date", "candidate_id",
        *r6("home_relevance", "constrained_ent", "constrained_beauty", "realtime_support",
            "home_credibility", "adjusted_credibility", "public_noise_penalty", "topic_specificity",
            "behavior_objectness"),
    )


@query("relation_support", O.chain(*O.TO_SF, O.RELATIONS, tail=f"""
SELECT date, candidate_id, {_r(*features.SUPPORT_COLUMNS)} FROM support"""))
def relation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.relation_support(spark, sf_dir).select(
        "date", "candidate_id", *r6(*features.SUPPORT_COLUMNS)
    )


# --- fusion --------------------------------------------------------------------------------------


@query("fusion_probabilities", O.chain(*O.TO_CF, tail=f"""
SELECT date, candidate_id, {_r('breakout_prob_1d', 'breakout_prob_3d', 'breakout_prob_7d', 'breakout_prob_14d', 'mass_prob')} FROM cf"""))
def fusion_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidate_features(spark, sf_dir).select(
        "date", "candidate_id",
        *r6("breakout_prob_1d", "breakout_prob_3d", "breakout_prob_7d", "breakout_prob_14d", "mass_prob"),
    )


def _vector_sql() -> str:
    topic = "CASE WHEN candidate_kind = 'TOPIC' THEN 1.0 ELSE 0.0 END"
    value = {n: topic if n == "candidate_kind_topic" else f"1.0 - {topic}" if c is None else c for n, c in fusion.VECTOR.items()}
    return ", ".join(f"round(CAST({e} AS DOUBLE), 4) AS {n}" for n, e in value.items())


@query("fusion_vector", O.chain(*O.TO_DERIVED, tail=f"SELECT date, candidate_id, {_vector_sql()} FROM derived"))
def fusion_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named feature vector, every entry of it."""
    df = P.candidate_features(spark, sf_dir).withColumn("vector", fusion.fusion_vector())
    return df.select("date", "candidate_id", *[F.col("vector")[n].alias(n) for n in fusion.VECTOR])


@query("calibration", f"""
WITH p AS (SELECT event_id, (event_id % 4999) / 4999 AS p FROM events)
SELECT event_id, round({O.calibrate('p', N.BREAKOUT_KNOTS)}, 6) AS breakout, round({O.calibrate('p', N.MASS_KNOTS)}, 6) AS mass FROM p""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("event_id") % 4999 / 4999
    return B.table(spark, sf_dir, "events").select(
        "event_id",
        F.round(N.calibrate(p, N.BREAKOUT_KNOTS), 6).alias("breakout"),
        F.round(N.calibrate(p, N.MASS_KNOTS), 6).alias("mass"),
    )


@query("public_scores", O.chain(*O.TO_CF, tail=f"""
SELECT date, candidate_id, {_r('public_rankability_prob', 'coming_score', 'mass_heat', 'public_score', 'model_primary_score')} FROM cf"""))
def public_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidate_features(spark, sf_dir).select(
        "date", "candidate_id",
        *r6("public_rankability_prob", "coming_score", "mass_heat", "public_score", "model_primary_score"),
    )


@query("ranking_gate", O.chain(*O.TO_CF, tail=f"""
SELECT date, candidate_id, candidate_type, lane, ranking_gate_passed, public_gate_passed, {_r('primary_score')} FROM cf"""))
def ranking_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidate_features(spark, sf_dir).select(
        "date", "candidate_id", "candidate_type", "lane", "ranking_gate_passed", "public_gate_passed",
        r6("primary_score"),
    )


# --- ranking --------------------------------------------------------------------------------------

_SELECTION = """
sel AS (
  SELECT *, CASE
    WHEN public_gate_passed THEN base + 0.9 + breakout_prob_7d + public_rankability_prob * 0.6 + sv_priority_score * 0.08 - omnipresence_penalty * 0.4
    WHEN ranking_gate_passed THEN base + 0.8 + breakout_prob_7d + sv_priority_score * 0.05 - omnipresence_penalty * 0.3
    WHEN role_discovery > 0 AND candidate_kind = 'TOPIC' THEN base + 0.2 + breakout_prob_7d * 0.4
    WHEN role_discovery = 0 AND family_count = 1 AND source_families[1] IN ('MUSIC_CHART', 'SHOW_CHART')
      THEN greatest(0.0, base - 0.35 + mass_prob * 0.1)
    ELSE base + breakout_prob_7d * 0.15 END AS selection_score
  FROM (SELECT *, CASE WHEN public_score <> 0 THEN public_score ELSE primary_score END AS base FROM cf)
),
main AS (SELECT * FROM sel WHERE domain_class IN ('ENTERTAINMENT', 'FASHION_BEAUTY', 'CONSUMER_CULTURE')),
eligible AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY public_gate_passed DESC, primary_score DESC, candidate_id) AS fill_rn FROM main)
  WHERE public_gate_passed OR fill_rn <= 20
)
"""


@query("selection_backfill", O.chain(*O.TO_CF, _SELECTION, tail=f"""
SELECT date, candidate_id, public_gate_passed, {_r('selection_score', 'primary_score')} FROM eligible"""))
def selection_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = P.candidate_features(spark, sf_dir).withColumn("selection_score", ranking.selection_score())
    return ranking.select_eligible(scored).select(
        "date", "candidate_id", "public_gate_passed", *r6("selection_score", "primary_score")
    )


@query("cluster_cap", O.chain(*O.TO_CF, _SELECTION, f"""
capped AS (
  SELECT *, row_number() OVER (PARTITION BY date, cluster ORDER BY selection_score DESC, candidate_id) AS pos,
    CASE WHEN direct_support_total >= 0.08 THEN 2 ELSE 1 END AS cap_n
  FROM (SELECT *, 'w' || (hash_no % 5) AS cluster FROM (SELECT *, CAST(substr(candidate_id, 2) AS INT) AS hash_no FROM eligible))
  WHERE {S.one_of('candidate_type', dims.PERSON_TYPES)}
),
walk AS (
  SELECT date, cluster, pos, candidate_id, 1 AS accepted, TRUE AS kept FROM capped WHERE pos = 1
  UNION ALL
  SELECT c.date, c.cluster, c.pos, c.candidate_id,
    CASE WHEN w.accepted < c.cap_n THEN w.accepted + 1 ELSE w.accepted END, w.accepted < c.cap_n
  FROM walk w JOIN capped c ON c.date = w.date AND c.cluster = w.cluster AND c.pos = w.pos + 1
)""", tail="SELECT date, cluster, candidate_id FROM walk WHERE kept"))
def cluster_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted person-like rows per work cluster; clusters by candidate number here."""
    scored = P.candidate_features(spark, sf_dir).withColumn("selection_score", ranking.selection_score())
    number = F.substring("candidate_id", 2, 10).cast("int")
    entries = ranking.select_eligible(scored).withColumn(
        "work_cluster_id", F.concat(F.lit("w"), (number % 5).cast("string"))
    )
    persons = entries.where(F.col("candidate_type").isin(*dims.PERSON_TYPES))
    return ranking.cap_clusters(persons).select("date", F.col("work_cluster_id").alias("cluster"), "candidate_id")


_LANE_STATE = {"people_music": "tp", "shows_formats": "ts", "words_behaviors": "tw", "style_products": "ty", "shadow": "tx"}
_TAKEN = "CASE lane " + " ".join(f"WHEN '{lane}' THEN {t}" for lane, t in _LANE_STATE.items()) + " END"
_ROW_OWED = "CASE lane WHEN 'words_behaviors' THEN greatest(4 - tw, 0) WHEN 'style_products' THEN greatest(3 - ty, 0) ELSE 0 END"
# One walk over the clusters, then one step per place of the list: the rules as they read, row by row.
_INTERLEAVE = f"""
clustered AS (
  SELECT *, {S.one_of('candidate_type', dims.PERSON_TYPES)} AND coalesce(work_cluster_id, '') <> '' AS held FROM eligible),
queued AS (
  SELECT *, row_number() OVER (PARTITION BY date, work_cluster_id ORDER BY selection_score DESC, candidate_id) AS pos,
    CASE WHEN direct_support_total >= 0.08 THEN 2 ELSE 1 END AS cap_n FROM clustered WHERE held),
taken_ AS (
  SELECT date, work_cluster_id, pos, candidate_id, 1 AS accepted, TRUE AS kept FROM queued WHERE pos = 1
  UNION ALL
  SELECT c.date, c.work_cluster_id, c.pos, c.candidate_id, CASE WHEN w.accepted < c.cap_n THEN w.accepted + 1 ELSE w.accepted END, w.accepted < c.cap_n
  FROM taken_ w JOIN queued c ON c.date = w.date AND c.work_cluster_id = w.work_cluster_id AND c.pos = w.pos + 1),
entered AS (SELECT * FROM clustered c WHERE NOT held OR EXISTS (SELECT 1 FROM taken_ t WHERE t.kept AND t.date = c.date AND t.candidate_id = c.candidate_id)),
lined AS (SELECT date, lane, candidate_id, selection_score, row_number() OVER (PARTITION BY date, lane ORDER BY selection_score DESC, candidate_id) AS n FROM entered),
lane_order AS (SELECT date, lane, row_number() OVER (PARTITION BY date ORDER BY selection_score DESC, candidate_id, lane) AS ord FROM lined WHERE n = 1),
picks AS (
  SELECT DISTINCT date, 0 AS step, {', '.join(f'0 AS {t}' for t in _LANE_STATE.values())}, '' AS candidate_id FROM lined
  UNION ALL
  SELECT date, step + 1, {', '.join(f"{t} + CASE WHEN lane = '{lane}' THEN 1 ELSE 0 END" for lane, t in _LANE_STATE.items())}, candidate_id FROM (
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY bid DESC, ord) AS place FROM (
      SELECT *, count(*) OVER (PARTITION BY date) AS open_lanes, max(CASE WHEN owed > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY date) = 1 AS owing FROM (
        SELECT date, step, {', '.join(_LANE_STATE.values())}, lane, l.candidate_id, ord, {_ROW_OWED} AS owed,
          20 - step <= greatest(4 - tw, 0) + greatest(3 - ty, 0) AS pressed, lane = 'people_music' AND tp >= 9 AS full_,
          selection_score + CASE WHEN lane = 'words_behaviors' AND tw = 0 THEN {O.d(0.08)} WHEN lane = 'style_products' AND ty = 0 THEN {O.d(0.06)}
            WHEN lane = 'shows_formats' AND ts < 4 THEN {O.d(0.03)} ELSE 0.0 END AS bid
        FROM (SELECT date, step, {', '.join(_LANE_STATE.values())} FROM picks WHERE step < 20) p JOIN lane_order USING (date) JOIN lined l USING (date, lane)
        WHERE l.n = {_TAKEN} + 1))
    WHERE (NOT (pressed AND owing) OR owed > 0) AND NOT (open_lanes > 1 AND full_))
  WHERE place = 1)
"""


@query("interleave_topk", O.chain(*O.TO_CF, _SELECTION, _INTERLEAVE, tail="""
SELECT date, p.step AS rank, candidate_id, e.lane, e.candidate_type, round(CAST(e.selection_score AS DOUBLE), 6) AS selection_score,
  round(CAST(CASE WHEN e.public_score <> 0 THEN e.public_score ELSE e.primary_score END AS DOUBLE), 6) AS primary_score
FROM picks p JOIN entered e USING (date, candidate_id) WHERE p.step > 0"""))
def interleave_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published ranking of every day, lane by lane under soft quotas."""
    ranked = ranking.rank_candidates(P.candidate_features(spark, sf_dir))
    return ranked.select(
        "date", "rank", "candidate_id", "lane", "candidate_type", *r6("selection_score", "primary_score")
    )


@query("legacy_bucket_score", O.chain(*O.TO_SF, tail=f"""
SELECT date, candidate_id, round(sum(score) + bonus, 6) AS trend_score, bonus AS multi_bonus,
  coalesce(string_agg(bucket, ',' ORDER BY round(score, 9) DESC, bucket) FILTER (WHERE score > 0), '') AS buckets
FROM (SELECT *, CAST(greatest(0, least(sum(active) OVER (PARTITION BY date, candidate_id) - 1, 3)) AS DOUBLE) AS bonus FROM (
  SELECT date, candidate_id, {S.case('source_id', {k: v for k, v in dims.BUCKET_BY_SOURCE.items()}, 'SEARCH')} AS bucket,
    sum(greatest(0, s1) + 0.7 * greatest(0, s2) + 0.7 * 0.7 * greatest(0, s3)) AS score,
    count(*) FILTER (WHERE s1 >= 2) AS active FROM sf GROUP BY ALL))
GROUP BY date, candidate_id, bonus"""))
def legacy_bucket_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranking.legacy_scores(P.source_features(spark, sf_dir))
    names = F.transform("breakdown", lambda b: b["bucket"])
    return df.select(
        "date", "candidate_id", r6("trend_score"), "multi_bonus", F.array_join(names, ",").alias("buckets")
    )


@query("breakdown_share", O.chain(*O.TO_ROLL, tail=f"""
SELECT date, candidate_id, row_number() OVER (PARTITION BY date, candidate_id ORDER BY score DESC, bucket) AS position,
  bucket, round(score, 6) AS score, round(score / sum(score) OVER (PARTITION BY date, candidate_id), 6) AS share
FROM (UNPIVOT (SELECT date, candidate_id, {', '.join(f'fam_{f.lower()} AS "{f}"' for f in dims.FAMILIES)} FROM roll)
  ON {', '.join(f'"{f}"' for f in dims.FAMILIES)} INTO NAME bucket VALUE score) WHERE score > 0"""))
def breakdown_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.breakdown_rows(P.aggregated(spark, sf_dir)).select(
        "date", "candidate_id", "position", "bucket", *r6("score", "share")
    )


@query("sparkline", O.chain(*O.TO_ROLL, tail="""
SELECT date, candidate_id, len(h) AS points, round(list_min(h), 6) AS low, round(list_max(h), 6) AS high,
  CASE WHEN len(h) = 0 THEN NULL WHEN list_max(h) > list_min(h) THEN round((h[-1] - list_min(h)) / (list_max(h) - list_min(h)), 6) ELSE 0.0 END AS latest_scaled
FROM (SELECT date, candidate_id, list(day_total) OVER (PARTITION BY candidate_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS h FROM agg)"""))
def sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-value score history with its min-max scaled last point."""
    df = features.with_backfill_state(P.aggregated(spark, sf_dir))
    grown = F.concat("history", F.array("day_total"))
    h = F.when(F.size(grown) > 7, F.slice(grown, -7, 7)).otherwise(grown)
    df = df.select("date", "candidate_id", h.alias("h"))
    return df.select(
        "date", "candidate_id", F.size("h").alias("points"), F.round(F.array_min("h"), 6).alias("low"),
        F.round(F.array_max("h"), 6).alias("high"),
        F.round(F.element_at(ranking.sparkline(F.col("h")), -1), 6).alias("latest_scaled"),
    )


_POOL = """
pool AS (
  SELECT doc_id, 'c' || (doc_id % 97) AS candidate_id, source AS source_id, text AS title,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://e.example/' || (doc_id % 11) END AS url,
    CASE WHEN doc_id % 2 = 0 THEN 'chars:' || (n_chars % 7) ELSE '' END AS metric FROM documents),
keyed AS (
  SELECT *, CASE WHEN url <> '' AND metric <> '' THEN source_id || '|' || url || '|' || metric
    WHEN url <> '' THEN source_id || '|' || url || '|' ELSE source_id || '|' || trim(title) || '|' || metric END AS key FROM pool)
"""


def _document_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return B.table(spark, sf_dir, "documents").select(
        doc.alias("ordinal"),
        F.concat(F.lit("c"), doc % 97).alias("candidate_id"),
        F.col("source").alias("source_id"),
        F.col("text").alias("title"),
        F.when(doc % 3 == 0, "").otherwise(F.concat(F.lit("https://e.example/"), doc % 11)).alias("url"),
        F.when(doc % 2 == 0, F.concat(F.lit("chars:"), F.col("n_chars") % 7)).otherwise("").alias("metric"),
    )


@query("evidence_dedupe", f"""WITH {_POOL}
SELECT candidate_id, source_id, url, metric, min(doc_id) AS ordinal FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id, key ORDER BY doc_id) AS rn FROM keyed) WHERE rn = 1 GROUP BY ALL""")
def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = evidence.dedupe(_document_pool(spark, sf_dir), keys=("candidate_id",))
    return kept.groupBy("candidate_id", "source_id", "url", "metric").agg(F.min("ordinal").alias("ordinal"))


@query("evidence_top3", f"""WITH {_POOL}
SELECT candidate_id, slot, source_id, doc_id AS ordinal FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY doc_id) AS slot FROM (
    SELECT *, row_number() OVER (PARTITION BY candidate_id, source_id ORDER BY doc_id) AS rn FROM keyed) WHERE rn = 1)
WHERE slot <= 3""")
def evidence_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = evidence.top_items(_document_pool(spark, sf_dir), keys=("candidate_id",))
    return top.select("candidate_id", "slot", "source_id", "ordinal")
