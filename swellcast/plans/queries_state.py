"""Registered queries: state before a day, the event-time front, merge chains."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.operators import anomaly, asof, chains, features, fusion, health, weights
from swellcast.operators import evaluation as V
from swellcast.operators import source_features as A
from swellcast.plans import events as P
from swellcast.plans import oracle_events as O
from swellcast.plans.queries_learning import (
    _ENTRIES, _MULT_SQL, _POSTERIORS, _REGION, _SETTINGS, _posteriors, _records, _top, labels_cte,
)
from swellcast.plans.queries_ops import _HEALTH_CTES, _LOG, _PLAN_SQL, _TOP_SQL, _publish_health, _ranked_items, _run_log
from swellcast.plans.shared import r6
from swellcast.plans.stages import new_path, stage
from swellcast.session import spread
from swellcast.sources import bindings as B
from swellcast.sources import catalog as K
from swellcast.sources import publications as PB
from swellcast.streaming.days import COLUMNS, DayFront

QUERIES = {}
ORACLES = {}
_RUN = itertools.count()


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _r(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


# --- as-of lookup ---------------------------------------------------------------------------------------


@query("state_before_day", O.chain(O.MENTIONS, O.FOLD, tail=f"""
SELECT a.candidate_id, a.source_id, a.date, s.date AS state_date, s.rn AS n, {_r('s.m', 's.v', 's.s1').replace('AS s.', 'AS ')}
FROM (SELECT p.candidate_id, p.source_id, d.date FROM (SELECT DISTINCT candidate_id, source_id FROM daily) p
      JOIN (SELECT DISTINCT candidate_id, date FROM daily) d USING (candidate_id)) a
ASOF LEFT JOIN stepped s ON a.candidate_id = s.candidate_id AND a.source_id = s.source_id AND a.date > s.date"""))
def state_before_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline before today of every source of a candidate, on every day the candidate is seen anywhere."""
    sf = P.source_features(spark, sf_dir)
    asked = sf.select("candidate_id", "source_id").distinct().join(sf.select("candidate_id", "date").distinct(), "candidate_id")
    history = sf.select("candidate_id", "source_id", "date", "n", "m", "v", F.col("anomaly").alias("s1"))
    found = asof.as_of(asked, history, ["candidate_id", "source_id"], "date", ["n", "m", "v", "s1"], found_time="state_date")
    return found.select("candidate_id", "source_id", "date", "state_date", "n", *r6("m", "v", "s1"))


_EVERY = 5
_WEIGHTED = f"""
snaps AS (SELECT DISTINCT date AS day FROM records WHERE date_diff('day', DATE '1970-01-01', date) % {_EVERY} = 0),
stable AS (SELECT day, source_id, greatest(0.5, 1 - avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END)) AS s FROM snaps JOIN records ON date BETWEEN day - 29 AND day GROUP BY ALL),
wh AS (SELECT day, source_id, s * count(*) OVER (PARTITION BY day) / sum(s) OVER (PARTITION BY day) AS weight FROM stable),
looked AS (
  SELECT f.date, f.candidate_id, f.source_id, f.cap, f.surprise_base, f.momentum_raw, w.weight,
    CASE WHEN s.reliability IS NULL THEN 1.0 ELSE {_MULT_SQL} END AS multiplier
  FROM (SELECT *, {_REGION} AS rb FROM sf) f
  LEFT JOIN post b ON b.source_id = f.source_id AND b.candidate_type = f.candidate_type AND b.region_bucket = f.rb
  LEFT JOIN post s ON s.source_id = f.source_id AND s.candidate_type IS NULL
  ASOF LEFT JOIN wh w ON f.source_id = w.source_id AND f.date > w.day)
"""


@query("weighted_scores", O.chain(*O.TO_CF, labels_cte(), _POSTERIORS, _SETTINGS, _WEIGHTED, tail=f"""
SELECT date, candidate_id, source_id, round(coalesce(weight, 1), 6) AS source_weight, round(multiplier, 6) AS posterior_multiplier,
  round(least(1.0, least(cap, greatest({O.d(0.25)}, coalesce(weight, 1)))
    * least(1.0, (surprise_base + least({O.d(0.25)}, momentum_raw * {O.d(0.08)})) * multiplier)), 6) AS surprise01 FROM looked"""))
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source scores with the newest source weights before each day and the learned posteriors fed back."""
    stepped = anomaly.fold_history(P.daily_signals(spark, sf_dir))
    records = stage(spark, sf_dir, "source_records", lambda: _records(P.source_features(spark, sf_dir)))
    days = stepped.select("date", "source_id").distinct()
    before = asof.as_of(days, weights.stability_history(records, _EVERY), ["source_id"], "date", ["weight"])
    scored = A.finish_features(stepped, weights=before, posteriors=_posteriors(spark, sf_dir))
    return scored.select("date", "candidate_id", "source_id", *r6("source_weight", "posterior_multiplier", "surprise01"))


# --- event-time front -----------------------------------------------------------------------------------

_DELAY, _SPAN = 3, 8
_ARRIVED = f"""
arrived AS (
  SELECT c.date, c.event_id, c.candidate_id, c.source_id, c.family, c.value, e.ts,
    (date_diff('day', DATE '2024-01-01', c.date) + c.event_id % 3) // {_SPAN} + CASE WHEN c.event_id % 53 = 0 THEN 2 ELSE 0 END AS arrival
  FROM catalogued c JOIN events e USING (event_id)),
marks AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival) AS newest FROM arrived GROUP BY arrival),
closing AS (SELECT arrival, CAST(newest - INTERVAL {_DELAY} DAY AS DATE) - 1 AS through, lag(CAST(newest - INTERVAL {_DELAY} DAY AS DATE) - 1) OVER (ORDER BY arrival) AS before FROM marks),
judged AS (SELECT a.*, coalesce(a.date <= c.before, FALSE) AS late FROM arrived a JOIN closing c USING (arrival))
"""


@query("stream_days", O.chain(O.MENTIONS.rsplit("daily AS (", 1)[0].rstrip().rstrip(","), _ARRIVED, """
daily AS (SELECT date, candidate_id, source_id, family, sum(value) AS signal, count(*) AS obs FROM judged
  WHERE NOT late AND date <= (SELECT max(through) FROM closing) GROUP BY ALL)""", O.FOLD, tail="""
SELECT date, candidate_id, source_id, obs AS rows_, CAST(rn AS BIGINT) AS n, round(m, 6) AS m, round(v, 6) AS v, round(s1, 6) AS anomaly, FALSE AS late FROM stepped
UNION ALL SELECT date, candidate_id, source_id, count(*), NULL, NULL, NULL, NULL, TRUE FROM judged WHERE late GROUP BY ALL"""))
def stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events in arrival order, some days late, through the front: closed days, and the rows that came too late."""
    ev = A.with_catalog(spread(B.event_mentions(spark, sf_dir)), dims.catalog_df(spark)).join(
        B.table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), "ts"), "ordinal")
    number = F.floor((F.datediff("date", F.lit("2024-01-01")) + F.col("ordinal") % 3) / _SPAN)
    base = new_path(spark, f"days-{next(_RUN)}", sf_dir)
    ev.withColumn("arrival", (number + F.when(F.col("ordinal") % 53 == 0, 2).otherwise(0)).cast("int")).select(
        "arrival", *COLUMNS).write.partitionBy("arrival").parquet(f"{base}/arrivals")
    arrivals = spark.read.parquet(f"{base}/arrivals")
    front = DayFront(f"{base}/front", _DELAY)
    for arrival in sorted(r.arrival for r in arrivals.select("arrival").distinct().collect()):
        arrivals.where(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(arrivals.drop("arrival").schema).option("maxFilesPerTrigger", 100_000).parquet(f"{base}/in")
        front.start(stream, f"{base}/checkpoint").awaitTermination()
    keys = ("date", "candidate_id", "source_id")
    closed = spark.read.parquet(f"{front.folder}/closed").select(
        *keys, F.col("observation_count").alias("rows_"), F.col("n").cast("long").alias("n"), *r6("m", "v", "anomaly"), F.lit(False).alias("late"))
    late = spark.read.parquet(f"{front.folder}/late").groupBy(*keys).agg(F.count("*").alias("rows_"))
    return closed.unionByName(late.withColumn("late", F.lit(True)), allowMissingColumns=True)


# --- merge chains ---------------------------------------------------------------------------------------

_CHAINED = """
top_key AS (SELECT max(p_partkey) AS last FROM part),
redirect AS (SELECT 'c' || k AS id, 'c' || into_ AS into_ FROM (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 200 = 120 THEN p_partkey - 7 WHEN p_partkey % 100 = 50 THEN p_partkey - 1
    WHEN p_partkey % 13 <> 12 AND p_partkey < last THEN p_partkey + 1
    WHEN p_partkey % 5 = 0 AND p_partkey + 2 <= last THEN p_partkey + 2 END AS into_ FROM part, top_key) WHERE into_ IS NOT NULL),
walk AS (
  SELECT id, into_ AS here, [id] AS path FROM redirect
  UNION ALL SELECT w.id, r.into_, list_append(w.path, w.here) FROM walk w JOIN redirect r ON r.id = w.here WHERE NOT list_contains(w.path, w.here)),
ended AS (
  SELECT id, here AS survivor, CAST(len(path) AS BIGINT) AS hops, FALSE AS cyclic FROM walk WHERE here NOT IN (SELECT id FROM redirect)
  UNION ALL SELECT id, list_min(path[list_position(path, here):]), NULL, TRUE FROM walk WHERE list_contains(path, here))
"""


def _chain_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual edits over all parts: chains of a dozen merges, earlier merges that later ones replace, cycles, links."""
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    last = part.agg(F.max("k").alias("last"))
    k = F.col("k")

    def edit(where, other, winner, at: str, action: str = "merge"):
        name = lambda c: F.concat(F.lit("c"), c)
        return F.when(where, F.struct(
            F.concat_ws(":", F.lit(at), k, other).alias("edit_id"), name(k).alias("left_id"), name(other).alias("right_id"),
            F.lit(action).alias("action"), name(winner).alias("winner_id"), F.lit(at).alias("decided_at")))

    edits = [
        edit((k % 5 == 0) & (k + 2 <= F.col("last")), k + 2, k + 2, "1"),
        edit((k % 13 != 12) & (k < F.col("last")), k + 1, k + 1, "2"),
        edit(k % 100 == 50, k - 1, k - 1, "3"),
        edit(k % 200 == 120, k - 7, k - 7, "3"),
        edit(k % 7 == 0, k + 1, k, "4", "link"),
    ]
    return part.join(last).select(F.explode(F.array(*edits)).alias("e")).where("e IS NOT NULL").select("e.*")


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return chains.survivors(chains.redirects(_chain_edits(spark, sf_dir)), new_path(spark, f"chains-{next(_RUN)}", sf_dir))

    return stage(spark, sf_dir, "survivors", build)


@query("merge_chains", f"WITH RECURSIVE {_CHAINED} SELECT id AS candidate_id, survivor, hops, cyclic FROM ended")
def merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every merged candidate has become, over chains of any length."""
    return _survivors(spark, sf_dir)


@query("followed_lines", f"""WITH RECURSIVE {_CHAINED}
SELECT coalesce(survivor, 'c' || l_partkey) AS candidate_id, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity
FROM lineitem LEFT JOIN ended ON id = 'c' || l_partkey GROUP BY ALL""")
def followed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items per candidate after all merges."""
    lines = B.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), "l_partkey").alias("candidate_id"), "l_quantity")
    # Sums first: a part that holds many lines asks for its survivor once.
    per_part = lines.groupBy("candidate_id").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    return chains.follow(per_part, _survivors(spark, sf_dir), "candidate_id").groupBy("candidate_id").agg(
        F.sum("lines").alias("lines"), F.sum("quantity").cast("double").alias("quantity"))


# --- roll-out, publication ------------------------------------------------------------------------------

_WINDOW = 5
_NUM = lambda e: f"regexp_replace(format('{{:.4f}}', {e}), '(\\.\\d+?)0+$', '\\1')"
_SHADOW = ("breakout_precision_7d", "future_spread_7d", "mature_people_music_ratio")
_CHECKED = {"healthy_core": ("healthy_core_sources", 6), "discovery_count": ("discovery_families", 2),
            "confirmation_count": ("confirmation_families", 2), "words_behaviors": ("words_behaviors_top20", 3)}
_ROLLOUT = f"""
sides AS (
  SELECT s.date, p.date IS NOT NULL AS known, {', '.join(f's.{n} AS s_{n}, p.{n} AS p_{n}' for n in _SHADOW)},
    {', '.join(f'coalesce(h.{n}, 0) AS {n}' for n in _CHECKED)}, coalesce(h.top_items, 0) * 3 AS ops
  FROM (SELECT * FROM e_met WHERE variant = 'shadow_v2') s LEFT JOIN (SELECT * FROM e_met WHERE variant = 'public_main') p USING (date) LEFT JOIN hall h USING (date)),
rolled AS (
  SELECT date, count(*) OVER w AS window_size, count(*) FILTER (WHERE known) OVER w AS public_size,
    {', '.join(f'avg(s_{n}) OVER w AS s_{n}, coalesce(avg(p_{n}) OVER w, 0.0) AS p_{n}' for n in _SHADOW)},
    {', '.join(f'min({n}) OVER w AS {n}' for n in _CHECKED)}, max(ops) OVER w AS ops
  FROM sides WINDOW w AS (ORDER BY date ROWS BETWEEN {_WINDOW - 1} PRECEDING AND CURRENT ROW)),
said AS (
  SELECT *, list_filter([
    CASE WHEN window_size < {_WINDOW} THEN 'insufficient_shadow_history:' || window_size || '/{_WINDOW}' END,
    CASE WHEN public_size < window_size THEN 'missing_public_baseline:' || public_size || '/' || window_size END,
    {', '.join(f"CASE WHEN {n} < {m} THEN '{label}<{m}:' || {n} END" for n, (label, m) in _CHECKED.items())},
    CASE WHEN ops > 5000 THEN 'write_ops>5000:' || ops END,
    CASE WHEN public_size > 0 AND s_breakout_precision_7d < p_breakout_precision_7d THEN 'shadow_breakout_precision<' || {_NUM('p_breakout_precision_7d')} || ':' || {_NUM('s_breakout_precision_7d')} END,
    CASE WHEN public_size > 0 AND s_mature_people_music_ratio > p_mature_people_music_ratio THEN 'shadow_mature_ratio>' || {_NUM('p_mature_people_music_ratio')} || ':' || {_NUM('s_mature_people_music_ratio')} END
  ], lambda x: x IS NOT NULL) AS reasons FROM rolled)
"""


@query("rollout_by_day", O.chain(*_HEALTH_CTES, labels_cte().replace("plan_", "label_plan_"), _ENTRIES, _ROLLOUT, tail=f"""
SELECT date, window_size, public_size, {', '.join(f'round(s_{n}, 4) AS avg_shadow_{n}, round(p_{n}, 4) AS avg_public_{n}' for n in _SHADOW)},
  array_to_string(reasons, ';') AS reasons, len(reasons) = 0 AS ready FROM said"""))
def rollout_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At every date, whether the shadow ranking may replace the public one: both variants' own metrics and the day's health."""
    health_rows = _publish_health(spark, sf_dir).select(
        "date", "healthy_core", "discovery_count", "confirmation_count", "words_behaviors", (F.col("top_items") * 3).alias("write_ops"))
    rows = V.list_metrics(_top(spark, sf_dir)).select("date", "variant", *_SHADOW).join(health_rows, "date", "left")
    out = health.rollout_by_day(rows, window_days=_WINDOW)
    return out.select("date", "window_size", "public_size", *[c for n in _SHADOW for c in (f"avg_shadow_{n}", f"avg_public_{n}")],
                      F.array_join("reasons", ";").alias("reasons"), "ready")


_COLLECTIONS = ("daily_rankings", "daily_rankings_v2_shadow")


@query("committed_runs", O.chain(*O.TO_CF, _TOP_SQL.split("hsrc AS")[0].rstrip().rstrip(","), tail="""
SELECT c.collection, date, CASE WHEN day(date) % 2 = 0 THEN 'r3' ELSE 'r1' END AS run_id, count(*) AS n,
  (SELECT count(*) FROM top20 x WHERE day(t.date) % 2 = 1 OR day(x.date) % 2 = 0) AS observed
FROM top20 t, (VALUES ('daily_rankings'), ('daily_rankings_v2_shadow')) c(collection) GROUP BY ALL"""))
def committed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs: one commits, one breaks off between its collections, one commits some days only. What a reader sees."""
    root = new_path(spark, f"published-{next(_RUN)}", sf_dir)
    items = stage(spark, sf_dir, "ranked_items", lambda: _ranked_items(spark, sf_dir))
    both = lambda df: dict.fromkeys(_COLLECTIONS, df)
    PB.publish(root, "r1", both(items))
    PB.write_collection(items, root, _COLLECTIONS[0], "r2")  # and then the run is lost
    PB.publish(root, "r3", both(items.where(F.dayofmonth("date") % 2 == 0)))
    PB.clean(spark, root, list(_COLLECTIONS))
    counts = PB.commits(spark, root).select("date", "run_id", "counts")
    out = None
    for name in _COLLECTIONS:
        seen = PB.read(spark, root, name).groupBy("date", "run_id").agg(F.count("*").alias("n")).withColumn("collection", F.lit(name))
        seen = seen.join(counts, ["date", "run_id"]).withColumn("observed", F.col("counts")[name]).drop("counts")
        out = seen if out is None else out.unionByName(seen)
    return out.select("collection", "date", "run_id", "n", "observed")


# --- availability below one, candidate state ------------------------------------------------------------

_AVAILABLE = """
grid_ AS (SELECT d.date, p.*, coalesce(l.ok AND l.item_count > 0, FALSE) AS live FROM (SELECT DISTINCT date FROM log_) d CROSS JOIN plan_ p
  LEFT JOIN log_ l ON l.date = d.date AND l.source_id = p.source_id),
avail_ AS (SELECT date, count(DISTINCT family) FILTER (WHERE live AND family IN ('SEARCH', 'SOCIAL_DISCOVERY')) / 2 AS search_availability FROM grid_ GROUP BY ALL)
"""


def _with_availability(sql: str) -> str:
    """The scoring chain with the day's search availability in the two places that read it."""
    plain = "round(greatest(constrained_ent, constrained_beauty, realtime_support), 4) AS adjusted_credibility"
    scarce = """round(greatest(constrained_ent, constrained_beauty, realtime_support) / greatest(0.5, coalesce(search_availability, 1.0)), 4) AS adjusted_credibility,
    coalesce(search_availability, 1.0) AS search_live"""
    low = "(CASE best_surface WHEN 'song' THEN 0.62 WHEN 'hashtag' THEN 0.70 ELSE 0.78 END)"
    for old, new in ((plain, scarce), (f"breakout_prob_7d < {low}", f"breakout_prob_7d < round({low} * greatest(0.5, search_live), 4)"),
                     ("  FROM der1\n", "  FROM der1 LEFT JOIN avail_ USING (date)\n")):
        if sql.count(old) != 1:
            raise ValueError(f"not once in the chain: {old}")
        sql = sql.replace(old, new)
    return sql


@query("scarce_search_gate", _with_availability(O.chain(_LOG, _PLAN_SQL, _AVAILABLE, *O.TO_CF, tail=f"""
SELECT date, candidate_id, round(search_live, 4) AS search_availability, {_r('adjusted_credibility')}, ranking_gate_passed, public_gate_passed, {_r('primary_score')} FROM cf""")))
def scarce_search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credibility and gates on days when search sources were missing."""
    live = health.availability(_run_log(spark, sf_dir), K.source_plan(dims.catalog_df(spark))).select("date", "search_availability")
    cf = fusion.fuse(P.derived(spark, sf_dir, availability=live))
    return cf.select("date", "candidate_id", F.round("search_availability", 4).alias("search_availability"),
                     r6("adjusted_credibility"), "ranking_gate_passed", "public_gate_passed", r6("primary_score"))


@query("candidate_state", O.chain(*O.TO_CF, """
cseq AS (SELECT date, candidate_id, primary_score, mass_heat, source_families, row_number() OVER (PARTITION BY candidate_id ORDER BY date) AS rn FROM cf),
cstate AS (
  SELECT candidate_id, rn, round(least(1.5, mass_heat * 0.4), 4) AS maturity FROM cseq WHERE rn = 1
  UNION ALL SELECT q.candidate_id, q.rn, round(least(1.5, s.maturity * 0.6 + q.mass_heat * 0.4), 4)
  FROM cstate s JOIN cseq q ON q.candidate_id = s.candidate_id AND q.rn = s.rn + 1),
newest_ AS (SELECT candidate_id, max(rn) AS rn FROM cseq GROUP BY ALL)
""", tail="""
SELECT n.candidate_id, round(c.maturity, 3) AS maturity, len(h.scores) AS days, round(list_sum(h.scores), 5) AS history_sum, round(h.scores[-1], 6) AS last_score,
  array_to_string(q.source_families, ',') AS source_families
FROM newest_ n JOIN cstate c USING (candidate_id, rn) JOIN cseq q USING (candidate_id, rn)
JOIN (SELECT s.candidate_id, list(s.primary_score ORDER BY s.rn) AS scores FROM cseq s JOIN newest_ m ON m.candidate_id = s.candidate_id AND s.rn > m.rn - 7 GROUP BY ALL) h USING (candidate_id)"""))
def candidate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate state stepped day by day from nothing to the last day; each day's state is a stored table of its own."""
    cf = P.candidate_features(spark, sf_dir).select("date", "candidate_id", "primary_score", "mass_heat", "source_families")
    base, state = new_path(spark, f"candidates-{next(_RUN)}", sf_dir), None
    # One step per calendar day; a step that is repeated reads the day before and writes the same.
    for day in sorted(r.date for r in cf.select("date").distinct().collect()):
        features.roll_forward(state, cf.where(F.col("date") == F.lit(day))).write.mode("overwrite").parquet(f"{base}/{day}")
        state = spark.read.parquet(f"{base}/{day}")
    return state.select(
        "candidate_id", F.round("maturity", 3).alias("maturity"), F.size("history").alias("days"),
        F.round(F.aggregate("history", F.lit(0.0), lambda a, x: a + x), 5).alias("history_sum"),
        F.round(F.element_at("history", -1), 6).alias("last_score"), F.array_join("source_families", ",").alias("source_families"))
