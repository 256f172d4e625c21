"""Registered queries: hindsight labels, source learning, weights, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.operators import evaluation as V
from swellcast.operators import labels as L
from swellcast.operators import learning, weights
from swellcast.operators import source_features as A
from swellcast.plans import events as P
from swellcast.plans import oracle_events as O
from swellcast.plans import sqltext as S
from swellcast.plans.shared import joined, r6
from swellcast.plans.stages import stage
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


# --- labels -----------------------------------------------------------------------------------

_NEW = {f: f"CASE WHEN NOT list_contains(a.source_families, '{f}') THEN off_{f} END" for f in L.CONFIRM_FAMILIES}


def labels_cte(source: str = "cf", name: str = "labels_", target: str | None = None) -> str:
    """Label CTEs by a range window; ``target`` limits anchors to one run's label plan."""
    if target is None:
        plan = """
plan_ AS (SELECT date, list_filter([1, 3, 7, 14], lambda h: h <= reach) AS bh, list_filter([3, 7], lambda h: h <= reach) AS mh
  FROM (SELECT DISTINCT date, (SELECT max(date) FROM cf) - date AS reach FROM cf))"""
    else:
        plan = f"""
plan_ AS (SELECT DATE '{target}' - back AS date, bh, mh FROM (VALUES
  (1, [1], CAST([] AS INT[])), (3, [1, 3], [3]), (7, [1, 3, 7], [3, 7]), (14, [1, 3, 7, 14], [3, 7])) t(back, bh, mh))"""
    mass = (
        "(mass_heat >= 0.9 OR broad_confirmation >= 0.6 OR len(list_intersect(source_families, "
        "['MUSIC_CHART', 'SHOW_CHART', 'VIDEO_CONFIRM', 'EDITORIAL', 'COMMERCE'])) >= 2)"
    )
    within = lambda col, h: f"coalesce({col} <= {h}, FALSE)"
    topic = "a.candidate_kind = 'TOPIC'"
    offers = {"mass": "is_mass", **{f: f"list_contains(source_families, '{f}')" for f in L.CONFIRM_FAMILIES},
              "multi": "len(source_families) >= 2", "home": "home", "public": "public_ok"}
    return f"""{plan.strip()},
flags_ AS MATERIALIZED (SELECT date, candidate_id, candidate_kind, source_families, {mass} AS is_mass,
  constrained_ent > 0 OR constrained_beauty > 0 OR realtime_support > 0 AS home,
  public_gate_passed OR public_rankability_prob >= 0.5 AS public_ok, public_noise_penalty, public_rankability_prob FROM {source}),
offs_ AS MATERIALIZED (
  SELECT date, candidate_id, {', '.join(f"min(CASE WHEN {flag} THEN day END) OVER ahead - day AS off_{name}" for name, flag in offers.items())}
  FROM (SELECT *, date - DATE '1970-01-01' AS day FROM flags_)
  WINDOW ahead AS (PARTITION BY candidate_id ORDER BY day RANGE BETWEEN 1 FOLLOWING AND 14 FOLLOWING)),
wide_ AS (
  SELECT a.*, bh, mh, off_mass, off_multi, off_home, off_public,
    {', '.join(f'{e} AS new_{f}' for f, e in _NEW.items())}
  FROM flags_ a JOIN plan_ USING (date) LEFT JOIN offs_ USING (date, candidate_id)),
{name} AS (
  SELECT *, list_sort(list_filter([{', '.join(f"CASE WHEN new_{f} <= 14 THEN '{f}' END" for f in L.CONFIRM_FAMILIES)}], lambda x: x IS NOT NULL)) AS new_families,
    len(list_filter([{', '.join(f'new_{f}' for f in L.CONFIRM_FAMILIES)}], lambda x: x <= 7)) AS new_families_7d,
    len(list_filter([{', '.join(f'new_{f}' for f in L.CONFIRM_FAMILIES)}], lambda x: x <= 14)) AS new_families_14d,
    {', '.join(f"list_contains(bh, {h}) AND ({within('off_new', h)} OR {within('off_mass', h)} OR ({topic} AND {within('off_multi', h)})) AS breakout_{h}d" for h in (1, 3, 7, 14))},
    is_mass AS mass_now, list_contains(mh, 3) AND {within('off_mass', 3)} AS mass_3d, list_contains(mh, 7) AND {within('off_mass', 7)} AS mass_7d,
    {within('off_home', 3)} AS home_confirm_3d, {within('off_home', 7)} AS home_confirm_7d, {within('off_public', 7)} AS public_confirm_7d,
    {topic} AND NOT {within('off_home', 7)} AND NOT {within('off_public', 7)} AND len(source_families) <= 1
      AND public_noise_penalty >= 0.55 AND public_rankability_prob < 0.5 AS trivial_noise_7d,
    least(off_new, off_mass) AS lead_days
  FROM (SELECT *, least({', '.join(f'new_{f}' for f in L.CONFIRM_FAMILIES)}) AS off_new FROM wide_) a)
"""


_FLAG_LIST = ", ".join(L.FLAGS)


@query("hindsight_labels", O.chain(*O.TO_CF, labels_cte(), tail=f"""
SELECT date, candidate_id, {_FLAG_LIST}, array_to_string(new_families, ',') AS new_confirmation_families,
  new_families_7d, new_families_14d, array_to_string(bh, ',') AS breakout_horizons FROM labels_"""))
def hindsight_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labels(spark, sf_dir).select(
        "date", "candidate_id", *L.FLAGS, joined("new_confirmation_families"), "new_families_7d",
        "new_families_14d", joined("breakout_horizons"),
    )


@query("lead_days", O.chain(*O.TO_CF, labels_cte(), tail="""
SELECT date, count(*) AS labelled, count(lead_days) AS led, round(avg(lead_days), 6) AS mean_lead, min(lead_days) AS min_lead
FROM labels_ GROUP BY ALL"""))
def lead_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labels(spark, sf_dir).groupBy("date").agg(
        F.count("*").alias("labelled"), F.count("lead_days").alias("led"),
        F.round(F.avg("lead_days"), 6).alias("mean_lead"), F.min("lead_days").alias("min_lead"),
    )


_T1, _T2 = "2024-01-24", "2024-01-30"


@query("label_merge", O.chain(*O.TO_CF, labels_cte(name="lab_a", target=_T1), tail="SELECT 1").rsplit("SELECT 1", 1)[0].rstrip()
       + ",\n" + labels_cte(name="lab_b", target=_T2).replace("plan_ ", "plan2_ ").replace("JOIN plan_", "JOIN plan2_")
       .replace("flags_", "flags2_").replace("offs_", "offs2_").replace("wide_", "wide2_") + f"""
SELECT coalesce(a.date, b.date) AS date, coalesce(a.candidate_id, b.candidate_id) AS candidate_id,
  {', '.join(f'coalesce(a.{x}, FALSE) OR coalesce(b.{x}, FALSE) AS {x}' for x in L.FLAGS)},
  array_to_string(list_sort(list_distinct(list_concat(coalesce(a.bh, []), coalesce(b.bh, [])))), ',') AS breakout_horizons,
  least(a.lead_days, b.lead_days) AS lead_days
FROM lab_a a FULL OUTER JOIN lab_b b ON a.date = b.date AND a.candidate_id = b.candidate_id""")
def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of two run days merged: outcomes that became known later are added."""
    cf = P.candidate_features(spark, sf_dir)
    first = L.build_labels(cf, L.label_plan(cf, _T1))
    second = L.build_labels(cf, L.label_plan(cf, _T2))
    return L.merge_labels(first, second).select(
        "date", "candidate_id", *L.FLAGS, joined("breakout_horizons"), "lead_days"
    )


# --- posteriors ---------------------------------------------------------------------------------

_REGION = (
    "(CASE WHEN list_contains(countries, 'JP') THEN 'JP' WHEN len(list_intersect(countries, "
    + O._ASIA + ")) > 0 THEN 'ASIA' WHEN source_id LIKE '%\\_JP' ESCAPE '\\' THEN 'JP'"
    " WHEN source_id LIKE '%\\_KR' ESCAPE '\\' THEN 'ASIA' WHEN source_id LIKE '%\\_GLOBAL' ESCAPE '\\' THEN 'GLOBAL'"
    " ELSE 'DEFAULT' END)"
)
_PRIOR = {
    n: "(CASE WHEN source_role = 'CONFIRMATION' THEN {0} WHEN source_role = 'EDITORIAL' THEN {1} "
    "WHEN source_role = 'COMMERCE' THEN {2} WHEN family_primary = 'SOCIAL_DISCOVERY' THEN {3} ELSE {4} END)".format(
        *[learning.PRIORS[k][i] for k in ("CONFIRMATION", "EDITORIAL", "COMMERCE", "SOCIAL_DISCOVERY", "OTHER")])
    for i, n in enumerate(learning.PRIOR_FIELDS)
}


def _mult(rel: str, lead: str, per: str, reg: str) -> str:
    base = f"({O.d(0.45)} + {O.d(0.55)} * {rel} + {O.d(0.12)} * {per} + {O.d(0.1)} * {lead})"
    return O.clamp(f"{base} * (CASE WHEN {reg} < 1 THEN {O.d(0.85)} + {O.d(0.15)} * {reg} ELSE 1 END)", 0.65, 1.35)


_POSTERIORS = f"""
prow AS (
  SELECT sf.source_id, sf.candidate_type, sf.role AS source_role, sf.family AS family_primary, {_REGION} AS region_bucket,
    l.breakout_7d OR l.mass_now AS pos, l.public_confirm_7d OR l.home_confirm_3d AS pub, sf.candidate_kind = 'TOPIC' AS topic,
    sf.candidate_kind = 'TOPIC' AND NOT l.trivial_noise_7d AND (l.home_confirm_3d OR l.public_confirm_7d OR l.breakout_7d) AS topic_pos,
    list_contains(l.mh, 7) AS known, l.mass_7d, l.lead_days
  FROM sf JOIN labels_ l USING (date, candidate_id) WHERE list_contains(l.bh, 7)),
pcount AS (
  SELECT source_id, source_role, family_primary, candidate_type, region_bucket, count(*) AS observations,
    count(*) FILTER (WHERE pos) AS positives, count(*) FILTER (WHERE NOT pos) AS negatives, count(*) FILTER (WHERE pub) AS public_pos,
    count(*) FILTER (WHERE topic) AS topic_total, count(*) FILTER (WHERE topic_pos) AS topic_pos,
    count(*) FILTER (WHERE known) AS persistence_total, count(*) FILTER (WHERE known AND mass_7d) AS persistence_pos,
    count(*) FILTER (WHERE rb <> 'JP') AS region_total, count(*) FILTER (WHERE rb <> 'JP' AND pos) AS region_pos,
    coalesce(sum(lead_days), 0) AS lead_sum, count(lead_days) AS lead_count
  FROM (SELECT *, region_bucket AS rb FROM prow)
  GROUP BY GROUPING SETS ((source_id, source_role, family_primary), (source_id, source_role, family_primary, candidate_type, region_bucket))),
post0 AS (
  SELECT *, ({_PRIOR['rel_a']} + positives) / ({_PRIOR['rel_a']} + {_PRIOR['rel_b']} + observations) AS reliability,
    ({_PRIOR['per_a']} + persistence_pos) / ({_PRIOR['per_a']} + {_PRIOR['per_b']} + persistence_total) AS persistence,
    ({_PRIOR['rel_a']} + public_pos) / ({_PRIOR['rel_a']} + {_PRIOR['rel_b']} + observations) AS public_precision,
    ({_PRIOR['rel_a']} + topic_pos) / ({_PRIOR['rel_a']} + {_PRIOR['rel_b']} + topic_total) AS topic_precision,
    CASE WHEN region_bucket = 'JP' THEN 1.0 ELSE ({_PRIOR['reg_a']} + region_pos) / ({_PRIOR['reg_a']} + {_PRIOR['reg_b']} + region_total) END AS region_fit,
    ({_PRIOR['lead_days']} * {_PRIOR['lead_weight']} + lead_sum) / ({_PRIOR['lead_weight']} + lead_count) AS mean_lead_days
  FROM pcount),
post AS (SELECT *, 1 / (1 + greatest(0, mean_lead_days)) AS lead_score FROM post0)
"""


#: The multiplier of a feature row with bucket ``b`` and source ``s``.
_MULT_SQL = _mult(*(f"coalesce(b.{n}, s.{n})" for n in ("reliability", "lead_score", "persistence", "region_fit")))


def _posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = learning.accumulate(P.source_features(spark, sf_dir), P.labels(spark, sf_dir))
    return learning.posteriors(counts)


@query("source_posteriors", O.chain(*O.TO_CF, labels_cte(), _POSTERIORS, tail=f"""
SELECT source_id, coalesce(candidate_type, '*') AS candidate_type, coalesce(region_bucket, '*') AS region_bucket, observations,
  positives, negatives, public_pos, topic_total, topic_pos, persistence_pos, region_total, region_pos, lead_sum, lead_count,
  {_r('reliability', 'persistence', 'public_precision', 'topic_precision', 'region_fit', 'mean_lead_days', 'lead_score')},
  round({_mult('reliability', 'lead_score', 'persistence', 'region_fit')}, 6) AS multiplier FROM post"""))
def source_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = lambda c: F.coalesce(c, F.lit("*")).alias(c)
    return _posteriors(spark, sf_dir).select(
        "source_id", star("candidate_type"), star("region_bucket"), "observations", "positives", "negatives",
        "public_pos", "topic_total", "topic_pos", "persistence_pos", "region_total", "region_pos", "lead_sum",
        "lead_count",
        *r6("reliability", "persistence", "public_precision", "topic_precision", "region_fit",
            "mean_lead_days", "lead_score", "multiplier"),
    )


@query("posterior_resolution", O.chain(*O.TO_CF, labels_cte(), _POSTERIORS, tail=f"""
SELECT date, candidate_id, source_id, posterior_bucket, {_r('reliability', 'lead_score', 'persistence', 'region_fit')},
  round({_mult('reliability', 'lead_score', 'persistence', 'region_fit')}, 6) AS multiplier FROM (
  SELECT f.date, f.candidate_id, f.source_id, f.source_id || '|' || f.candidate_type || '|' || f.role || '|' || f.rb AS posterior_bucket,
    {', '.join(f'coalesce(b.{n}, s.{n}) AS {n}' for n in ('reliability', 'lead_score', 'persistence', 'region_fit'))}
  FROM (SELECT *, {_REGION} AS rb FROM sf) f
  LEFT JOIN post b ON b.source_id = f.source_id AND b.candidate_type = f.candidate_type AND b.region_bucket = f.rb
  LEFT JOIN post s ON s.source_id = f.source_id AND s.candidate_type IS NULL)"""))
def posterior_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.source_features(spark, sf_dir).drop(
        "posterior_reliability", "posterior_lead", "posterior_persistence", "posterior_region_fit",
        "posterior_multiplier",
    )
    df = learning.resolve_posteriors(rows, _posteriors(spark, sf_dir))
    return df.select(
        "date", "candidate_id", "source_id", "posterior_bucket",
        F.round("posterior_reliability", 6).alias("reliability"),
        F.round("posterior_lead", 6).alias("lead_score"),
        F.round("posterior_persistence", 6).alias("persistence"),
        F.round("posterior_region_fit", 6).alias("region_fit"),
        F.round("posterior_multiplier", 6).alias("multiplier"),
    )


# --- weights ----------------------------------------------------------------------------------------

# Per-source settings come from the data: the event count of a source sets its limit.
_SETTINGS = """
settings AS (
  SELECT source_id, CASE WHEN source_id LIKE 'NETFLIX%' THEN 3.5 WHEN source_id = 'YOUTUBE_TREND_JP' THEN 0.25 ELSE 0.5 END AS lag_days,
    1.0 AS region_weight, 5 + n % 60 AS granularity, least(20, 5 + n % 60) AS top_m
  FROM (SELECT source_id, count(*) AS n FROM mentions GROUP BY ALL)),
priors AS (
  SELECT source_id, region_weight AS R, power(2, -lag_days / 7) AS F, least(1.0, ln(1 + granularity) / ln(51)) AS G FROM settings),
prior_ AS (SELECT *, R * F * G AS prior FROM priors),
top_ AS (
  SELECT date, source_id, candidate_id, momentum, position FROM (
    SELECT date, source_id, candidate_id, surprise01 AS momentum,
      row_number() OVER (PARTITION BY date, source_id ORDER BY surprise01 DESC, candidate_id) AS position FROM sf WHERE surprise01 > 0)
  JOIN settings USING (source_id) WHERE position <= top_m),
records AS (SELECT date, source_id, (date_diff('day', DATE '2024-01-01', date) + length(source_id)) % 7 <> 0 AS ok FROM sf GROUP BY ALL)
"""


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.event_mentions(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"))
    config = n.select(
        "source_id", F.lit(None).cast("double").alias("region_weight"), F.lit(None).cast("double").alias("lag_days"),
        F.lit(None).cast("int").alias("granularity"), (F.lit(5) + F.col("n") % 60).cast("int").alias("fetch_limit"),
        F.lit(None).cast("int").alias("top_m"),
    )
    return weights.source_settings(config)


def _records(sf: DataFrame) -> DataFrame:
    """A run record per (date, source); about one day in seven counts as failed."""
    day = F.datediff("date", F.lit("2024-01-01").cast("date"))
    return sf.select("date", "source_id").distinct().withColumn(
        "ok", (day + F.length("source_id")) % 7 != 0
    )


def _weight_inputs(spark: SparkSession, sf_dir: str):
    """Run records, stored daily top rows and source settings."""
    sf = P.source_features(spark, sf_dir)
    settings = stage(spark, sf_dir, "source_settings", lambda: _settings(spark, sf_dir))
    top = stage(spark, sf_dir, "source_top", lambda: weights.top_per_source(sf, settings))
    records = stage(spark, sf_dir, "source_records", lambda: _records(sf))
    return records, top, settings


@query("source_top_m", O.chain(*O.TO_SF, _SETTINGS, tail="SELECT date, source_id, candidate_id, position, round(momentum, 6) AS momentum FROM top_"))
def source_top_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, top, _ = _weight_inputs(spark, sf_dir)
    return top.select("date", "source_id", "candidate_id", "position", r6("momentum"))


@query("prior_weights", O.chain(O.MENTIONS, _SETTINGS.split("top_ AS")[0].rstrip().rstrip(","), tail=f"""
SELECT source_id, {_r('R', 'F', 'G', 'prior')}, round(prior * count(*) OVER () / sum(prior) OVER (), 6) AS weight FROM prior_"""))
def prior_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    pri = weights.prior_weights(_settings(spark, sf_dir))
    return weights.normalize_mean_one(pri, "prior", "weight").select("source_id", *r6("R", "F", "G", "prior", "weight"))


_F1 = """
ok_items AS (SELECT t.* FROM top_ t JOIN records r USING (date, source_id) WHERE r.ok),
bounds AS (SELECT max(date) AS as_of FROM records),
anchor_ AS (SELECT source_id, candidate_id, date + 7 AS fdate FROM ok_items, bounds WHERE date BETWEEN as_of - 36 AND as_of - 7),
loo AS (
  SELECT s.fdate, s.source_id, i.candidate_id, sum(coalesce(p.prior, 1) * i.momentum) AS score
  FROM (SELECT DISTINCT fdate, source_id FROM anchor_) s
  JOIN ok_items i ON i.date = s.fdate AND i.source_id <> s.source_id LEFT JOIN prior_ p ON p.source_id = i.source_id
  GROUP BY ALL),
future_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fdate, source_id ORDER BY round(score, 9) DESC, candidate_id) AS rn FROM loo) WHERE rn <= 20),
day_ AS (
  SELECT source_id, fdate, count(*) AS a, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM future_ f WHERE f.fdate = x.fdate AND f.source_id = x.source_id AND f.candidate_id = x.candidate_id)) AS hit
  FROM anchor_ x GROUP BY ALL),
fsize AS (SELECT fdate, source_id, count(*) AS b FROM future_ GROUP BY ALL),
f1 AS (SELECT source_id, avg(hit / a) AS precision, avg(hit / b) AS recall, count(*) AS evaluated_days FROM day_ JOIN fsize USING (fdate, source_id) GROUP BY ALL),
pred AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS predictive FROM f1)
"""
_INDEP = """
iset AS (SELECT i.* FROM top_ i JOIN records r USING (date, source_id), bounds2 WHERE r.ok AND i.date BETWEEN as_of - 29 AND as_of),
isize AS (SELECT date, source_id, count(*) AS n FROM iset GROUP BY ALL),
ipair AS (
  SELECT a.date, a.source_id, b.source_id AS other, any_value(a.n) AS n, any_value(b.n) AS m,
    (SELECT count(*) FROM iset x JOIN iset y ON x.date = y.date AND x.candidate_id = y.candidate_id
     WHERE x.date = a.date AND x.source_id = a.source_id AND y.source_id = b.source_id) AS both_
  FROM isize a JOIN isize b ON a.date = b.date AND a.source_id <> b.source_id GROUP BY ALL),
iday AS (SELECT date, source_id, avg(both_ / (n + m - both_)) AS overlap FROM ipair GROUP BY ALL),
indep AS (SELECT source_id, avg(overlap) AS redundancy, greatest(CAST(0.2 AS DOUBLE), 1 - avg(overlap)) AS independence FROM iday GROUP BY ALL)
"""
_BOUNDS2 = "bounds2 AS (SELECT max(date) AS as_of FROM records)"
_STAB = """
stab AS (SELECT source_id, greatest(0.5, 1 - avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END)) AS stability, count(*) AS days
  FROM records, bounds3 WHERE date BETWEEN as_of - 29 AND as_of GROUP BY ALL)"""
_BOUNDS3 = "bounds3 AS (SELECT max(date) AS as_of FROM records)"


@query("predictive_f1", O.chain(*O.TO_SF, _SETTINGS, _F1, tail=f"SELECT source_id, evaluated_days, {_r('precision', 'recall', 'predictive')} FROM pred"))
def predictive_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, top, settings = _weight_inputs(spark, sf_dir)
    f1 = weights.predictive_f1(records, top, weights.prior_weights(settings))
    return f1.select("source_id", "evaluated_days", *r6("precision", "recall", "predictive"))


@query("independence_jaccard", O.chain(*O.TO_SF, _SETTINGS, _BOUNDS2, _INDEP, tail=f"SELECT source_id, {_r('redundancy', 'independence')} FROM indep"))
def independence_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, top, _ = _weight_inputs(spark, sf_dir)
    return weights.independence(records, top).select("source_id", *r6("redundancy", "independence"))


@query("stability", O.chain(*O.TO_SF, _SETTINGS, _BOUNDS3, _STAB, tail="SELECT source_id, days, round(stability, 6) AS stability FROM stab"))
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _, _ = _weight_inputs(spark, sf_dir)
    return weights.stability(records).select("source_id", "days", r6("stability"))


@query("weights", O.chain(*O.TO_SF, _SETTINGS, _F1, _BOUNDS2, _INDEP, _BOUNDS3, _STAB, tail=f"""
SELECT source_id, {_r('prior', 'predictive', 'independence', 'stability', 'calibration')},
  round(count(*) OVER () * prior * calibration / sum(prior * calibration) OVER (), 6) AS weight FROM (
  SELECT p.source_id, prior, coalesce(predictive, 1) AS predictive, coalesce(independence, 1) AS independence, coalesce(stability, 1) AS stability,
    count(*) OVER () * coalesce(predictive, 1) * coalesce(independence, 1) / sum(coalesce(predictive, 1) * coalesce(independence, 1)) OVER () AS calibration
  FROM prior_ p LEFT JOIN pred USING (source_id) LEFT JOIN indep USING (source_id) LEFT JOIN stab USING (source_id))"""))
def source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = weights.weight_snapshot(*_weight_inputs(spark, sf_dir))
    return snap.select("source_id", *r6("prior", "predictive", "independence", "stability", "calibration", "weight"))


@query("current_weights", O.chain(*O.TO_SF, _SETTINGS, tail="""
SELECT source_id, round(count(*) OVER () * w / sum(w) OVER (), 6) AS weight FROM (
  SELECT source_id, coalesce(s.stored, pw) AS w FROM (SELECT source_id, prior * count(*) OVER () / sum(prior) OVER () AS pw FROM prior_)
  LEFT JOIN (SELECT source_id, 0.5 + count(*) % 10 / 10 AS stored FROM mentions WHERE event_type <> 'error' GROUP BY ALL) s USING (source_id))"""))
def current_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored weights first, prior for the sources without one, rescaled to mean 1."""
    stored = B.event_mentions(spark, sf_dir).where(
        ~F.col("source_id").isin("EDITORIAL_MODELPRESS", "WEAR_WORDS")
    ).groupBy("source_id").agg((0.5 + F.count("*") % 10 / 10).alias("weight"))
    return weights.current_weights(_settings(spark, sf_dir), stored=stored).select("source_id", r6("weight"))


# --- evaluation -----------------------------------------------------------------------------------------

_ENTRIES = """
e_all AS (
  SELECT date, 'shadow_v2' AS variant, candidate_id, candidate_type, lane, mass_heat AS maturity, breakout_prob_7d, mass_prob, novelty, primary_score FROM cf
  UNION ALL SELECT date, 'public_main', candidate_id, candidate_type, lane, mass_heat, breakout_prob_7d, mass_prob, novelty, public_score FROM cf WHERE public_gate_passed),
e_rank AS (SELECT *, row_number() OVER (PARTITION BY date, variant ORDER BY primary_score DESC, candidate_id) AS rank FROM e_all),
e_lab AS (
  SELECT e.*, l.bh, l.mh, l.breakout_1d, l.breakout_3d, l.breakout_7d, l.breakout_14d, l.mass_7d, l.lead_days, l.new_families_7d, l.new_families_14d
  FROM e_rank e LEFT JOIN labels_ l USING (date, candidate_id)),
e_rel AS (
  SELECT *, greatest(0.0, (CASE WHEN breakout_7d THEN 1.0 ELSE 0.0 END) + least(coalesce(new_families_7d, 0), 3) * 0.25 + novelty * 0.15
    - (CASE WHEN candidate_type IN ('PERSON', 'GROUP', 'MUSIC_ARTIST', 'MUSIC_TRACK') THEN maturity * 0.35 ELSE 0 END)) AS rel
  FROM e_lab WHERE rank <= 20),
e_ndcg AS (
  SELECT date, variant, coalesce(sum(rel / log2(rank + 1)) / nullif(sum(rel / log2(ideal + 1)), 0), 0) AS ndcg_7d
  FROM (SELECT *, row_number() OVER (PARTITION BY date, variant ORDER BY rel DESC, candidate_id) AS ideal FROM e_rel) GROUP BY ALL),
e_met AS (
  SELECT date, variant, count(*) AS listed,
""" + ",\n".join(
    f"coalesce(avg(CAST(breakout_{h}d AS INT)) FILTER (WHERE list_contains(bh, {h})), 0) AS breakout_precision_{h}d, "
    f"count(*) FILTER (WHERE list_contains(bh, {h})) AS breakout_evaluated_{h}d" for h in (1, 3, 7, 14)
) + """,
    avg(coalesce(new_families_7d, 0)) AS future_spread_7d, avg(coalesce(new_families_14d, 0)) AS future_spread_14d,
    coalesce(avg(lead_days), 0) AS lead_gain, count(lead_days) / count(*) AS lead_coverage, count(lead_days) AS lead_count,
""" + ", ".join(f"count(*) FILTER (WHERE lane = '{x}') AS lane_{x}" for x in dims.TARGET_LANES) + """,
    count(DISTINCT candidate_type) / count(*) AS type_diversity,
    avg(CASE WHEN candidate_type IN ('PERSON', 'GROUP', 'MUSIC_ARTIST', 'MUSIC_TRACK') AND maturity >= 0.8 THEN 1.0 ELSE 0.0 END) AS mature_people_music_ratio,
    count(DISTINCT lane) FILTER (WHERE lane <> 'shadow') / 4 AS lane_coverage
  FROM e_lab WHERE rank <= 20 GROUP BY ALL)
"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cf = P.candidate_features(spark, sf_dir)
    public = cf.where("public_gate_passed").withColumn("primary_score", F.col("public_score"))
    return V.entries_from_features(cf, "shadow_v2").unionByName(V.entries_from_features(public, "public_main"))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_outcomes(V.rank_entries(_entries(spark, sf_dir), 20), P.labels(spark, sf_dir))


_EVAL = (*O.TO_CF, labels_cte(), _ENTRIES)
_PRECISION = [f"breakout_precision_{h}d" for h in (1, 3, 7, 14)]
_EVALUATED = [f"breakout_evaluated_{h}d" for h in (1, 3, 7, 14)]


@query("precision_at_k", O.chain(*_EVAL, tail=f"SELECT date, variant, listed, {_r(*_PRECISION, 'future_spread_7d', 'future_spread_14d')}, {', '.join(_EVALUATED)} FROM e_met"))
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.list_metrics(_top(spark, sf_dir)).select(
        "date", "variant", "listed", *r6(*_PRECISION, "future_spread_7d", "future_spread_14d"), *_EVALUATED
    )


@query("ndcg_at_k", O.chain(*_EVAL, tail="SELECT date, variant, round(ndcg_7d, 6) AS ndcg_7d FROM e_ndcg"))
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ndcg(_top(spark, sf_dir)).select("date", "variant", r6("ndcg_7d"))


@query("lead_gain", O.chain(*_EVAL, tail=f"SELECT date, variant, lead_count, {_r('lead_gain', 'lead_coverage')} FROM e_met"))
def lead_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.list_metrics(_top(spark, sf_dir)).select("date", "variant", "lead_count", *r6("lead_gain", "lead_coverage"))


_LANES = [f"lane_{x}" for x in dims.TARGET_LANES]


@query("lane_mix", O.chain(*_EVAL, tail=f"SELECT date, variant, {', '.join(_LANES)}, {_r('lane_coverage', 'type_diversity', 'mature_people_music_ratio')} FROM e_met"))
def lane_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.list_metrics(_top(spark, sf_dir)).select(
        "date", "variant", *_LANES, *r6("lane_coverage", "type_diversity", "mature_people_music_ratio")
    )


@query("brier_reliability", O.chain(*_EVAL, """
pairs_ AS (SELECT date, variant, breakout_prob_7d AS p, CAST(breakout_7d AS INT) AS y FROM e_lab WHERE list_contains(bh, 7)),
bins_ AS (SELECT *, CAST(least(floor(greatest(p, 0) * 5), 4) AS INT) AS bin FROM pairs_),
frame_ AS (SELECT DISTINCT date, variant, b.bin FROM bins_, (VALUES (0), (1), (2), (3), (4)) b(bin))
""", tail="""
SELECT f.date, f.variant, f.bin, count(p) AS n, round(coalesce(avg(p), 0), 4) AS avg_pred, round(coalesce(avg(y), 0), 4) AS avg_outcome,
  round(any_value(brier), 6) AS brier
FROM frame_ f LEFT JOIN bins_ b ON b.date = f.date AND b.variant = f.variant AND b.bin = f.bin
JOIN (SELECT date, variant, avg((p - y) * (p - y)) AS brier FROM pairs_ GROUP BY ALL) s ON s.date = f.date AND s.variant = f.variant
GROUP BY f.date, f.variant, f.bin"""))
def brier_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = V.probability_pairs(V.with_outcomes(_entries(spark, sf_dir), P.labels(spark, sf_dir)), "breakout")
    score = V.brier(pairs, "breakout").select("date", "variant", F.round("breakout_brier", 6).alias("brier"))
    return V.reliability(pairs).join(score, ["date", "variant"]).select(
        "date", "variant", "bin", "n", "avg_pred", "avg_outcome", "brier"
    )


@query("variant_compare", O.chain(*_EVAL, tail=f"""
SELECT date, variant, {', '.join(f'round(sign * {n}, 4) + 0.0 AS {n}_delta' for n in V.COMPARED)} FROM (
  SELECT s.date, {', '.join(f'round(round(s.{n}, 4) - round(p.{n}, 4), 4) AS {n}' for n in V.COMPARED)}
  FROM e_met s JOIN e_met p ON p.date = s.date AND s.variant = 'shadow_v2' AND p.variant = 'public_main'),
  (VALUES ('shadow_v2', 1), ('public_main', -1)) v(variant, sign)"""))
def variant_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = V.evaluate(_entries(spark, sf_dir), P.labels(spark, sf_dir))
    df = V.compare(metrics)
    return df.select("date", "variant", *[(F.col(f"{n}_delta") + 0.0).alias(f"{n}_delta") for n in V.COMPARED])


@query("small_list_metrics", O.chain(*O.TO_CF, tail=f"""
SELECT date, {_r('lead_spread', 'family_presence', 'type_diversity', 'novelty_precision')}, {', '.join(_LANES)} FROM (
  SELECT date, avg(CASE WHEN cross_family_confirm > 0 THEN 1.0 ELSE 0.0 END) AS lead_spread, avg(len(source_families)) AS family_presence,
    count(DISTINCT candidate_type) / count(*) AS type_diversity, {', '.join(f"count(*) FILTER (WHERE lane = '{x}') AS lane_{x}" for x in dims.TARGET_LANES)}
  FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY primary_score DESC, candidate_id) AS rn FROM cf) WHERE rn <= 20 GROUP BY ALL)
JOIN (SELECT date, coalesce(avg(CASE WHEN primary_score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE novelty >= 0.5), 0) AS novelty_precision FROM cf GROUP BY ALL) USING (date)"""))
def small_list_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.small_list_metrics(P.candidate_features(spark, sf_dir)).select(
        "date", *r6("lead_spread", "family_presence", "type_diversity", "novelty_precision"), *_LANES
    )


@query("stored_item_entries", O.chain(*O.TO_CF, tail="""
SELECT date, candidate_id, rank, coalesce(lane, 'shadow') AS lane, round(coalesce(nullif(score, 0), primary_score, 0), 6) AS primary_score,
  round(coalesce(mass_heat, 0), 6) AS maturity, known AS has_anchor FROM (
  SELECT i.date, i.candidate_id, i.rank, i.score, c.lane, c.primary_score, c.mass_heat, c.candidate_id IS NOT NULL AS known
  FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, candidate_id) AS rank FROM (
      SELECT CAST(ts AS DATE) AS date, 'k' || json_extract_string(props, '$.k') AS candidate_id, CAST(count(*) - 1 AS DOUBLE) AS score FROM events GROUP BY ALL)) i
  LEFT JOIN cf c ON c.date = i.date AND c.candidate_id = i.candidate_id WHERE i.rank <= 20)"""))
def stored_item_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored ranking rows completed from features; gaps fall back to defaults."""
    ev = B.table(spark, sf_dir, "events")
    counted = ev.groupBy(
        F.to_date("ts").alias("date"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("candidate_id")
    ).agg((F.count("*") - 1).cast("double").alias("primary_score"))
    from swellcast.operators.ranking import top_k_per_day

    items = top_k_per_day(counted, 20, "primary_score").select(
        "*", F.lit("").alias("candidate_type"), F.lit("").alias("lane"),
        F.array().cast("array<string>").alias("source_families"), F.lit(None).cast("double").alias("maturity"),
    )
    return V.entries_from_items(items, P.candidate_features(spark, sf_dir), "stored").select(
        "date", "candidate_id", "rank", "lane", *r6("primary_score", "maturity"), "has_anchor"
    )
