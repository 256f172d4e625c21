"""The scoring chain over ``events`` as SQL common table expressions.

Written from the definitions, stage by stage, so each registered query can be
checked against an independent engine.
"""

from __future__ import annotations

from swellcast import dims
from swellcast.dims import AlgorithmConfig
from swellcast.functions import numeric as N
from swellcast.operators import fusion as X
from swellcast.plans import sqltext as S
from swellcast.sources import bindings as B

CFG = AlgorithmConfig()
_ROWS = {r[0]: r for r in dims.catalog_rows()}
_USED = tuple(B.SOURCE_BY_EVENT.values())


def d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def clamp(e: str, lo: float, hi: float) -> str:
    return f"greatest({d(lo)}, least({d(hi)}, {e}))"


def round4(e: str) -> str:
    """Half-up on the shortest decimal form, where exact ties are common."""
    return f"CAST(CAST(CAST(({e}) AS VARCHAR) AS DECIMAL(30, 4)) AS DOUBLE)"


MENTIONS = f"""
raw AS (
  SELECT CAST(ts AS DATE) AS date, event_id, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INT) + 100 * (user_id // 150) AS k
  FROM events
),
mentions AS (
  SELECT *, 'k' || k AS candidate_id,
    {S.pick(dims.CANDIDATE_TYPES, f'k % {len(dims.CANDIDATE_TYPES)}')} AS candidate_type,
    {S.case("event_type || ':' || (user_id % 2)", {f'{e}:{p}': s for (e, p), s in B.SOURCE_BY_EVENT.items()}, None)} AS source_id,
    event_id % 3 AS conf, 1 + event_id % 50 AS rank,
    {S.pick(B.COUNTRIES, 'user_id % 5')} AS country,
    CASE WHEN user_id % 7 = 0 THEN 'JP' END AS region,
    (event_type = 'signup' AND event_id % 4 = 0) AS derived,
    CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'w' || (event_id % 5) END AS work,
    {S.pick(('OTHER', 'ENTERTAINMENT', 'FASHION_BEAUTY', 'CONSUMER_CULTURE'), 'event_id % 4')} AS stated,
    'k' || k || {S.pick(B.NAME_TAILS, f'k % {len(B.NAME_TAILS)}')} AS name
  FROM raw
),
catalogued AS (
  SELECT *, CASE WHEN {S.one_of('candidate_type', dims.TOPIC_TYPES)} THEN 'TOPIC' ELSE 'ENTITY' END AS candidate_kind,
    {S.case('source_id', {s: _ROWS[s][1] for s in _USED}, None)} AS role,
    {S.case('source_id', {s: _ROWS[s][2] for s in _USED}, None)} AS family,
    {S.case('source_id', {s: _ROWS[s][9] for s in _USED}, None)} AS cap
  FROM mentions
),
daily AS (
  SELECT date, candidate_id, candidate_type, candidate_kind, source_id, role, family, cap,
    sum(value) AS signal, count(*) AS obs, max(conf) AS conf, min(event_id) AS first_ord,
    max(CAST(derived AS INT)) = 1 AS derived,
    arg_max(work, event_id) FILTER (WHERE work IS NOT NULL) AS work,
    list_sort(list_distinct(list(country))) AS countries,
    min(rank) AS best_rank,
    list_sort(list_distinct(list(region) FILTER (WHERE region IS NOT NULL))) AS regions,
    coalesce(arg_min(stated, event_id) FILTER (WHERE stated <> 'OTHER'),
             arg_min({S.classify('candidate_type', 'family', 'name')}, event_id)) AS domain
  FROM catalogued GROUP BY ALL
)
"""

_ALPHA = S.case("family", {f: N.decay_factor(p.half_life_days) for f, p in CFG.family_params.items()},
                N.decay_factor(CFG.half_life_days))
_WARM = S.case("family", {f: p.warmup_days for f, p in CFG.family_params.items()}, CFG.warmup_days)
_LAM = S.case("family", {f: p.momentum_lambda for f, p in CFG.family_params.items()}, CFG.momentum_lambda)

FOLD = f"""
seq AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_id, source_id ORDER BY date) AS rn,
    least(signal, {d(50.0)}) AS x, {_ALPHA} AS alpha, {_WARM} AS warm, {_LAM} AS lam
  FROM daily
),
st AS (
  SELECT candidate_id, source_id, rn, CAST(alpha * x AS DOUBLE) AS m,
    CAST((1 - alpha) * (alpha * x * x) AS DOUBLE) AS v,
    CAST(CASE WHEN 1 <= warm THEN 0 ELSE (x - {d(0.1)}) / {d(0.1)} END AS DOUBLE) AS s1,
    CAST(0 AS DOUBLE) AS s2, CAST(0 AS DOUBLE) AS s3
  FROM seq WHERE rn = 1
  UNION ALL
  SELECT q.candidate_id, q.source_id, q.rn, (1 - alpha) * m + alpha * x,
    (1 - alpha) * (v + alpha * (x - m) * (x - m)),
    CASE WHEN q.rn <= warm THEN 0 ELSE (x - greatest(m, {d(0.1)})) / (sqrt(greatest(v, 0)) + {d(0.1)}) END,
    s1, s2
  FROM st JOIN seq q ON q.candidate_id = st.candidate_id AND q.source_id = st.source_id AND q.rn = st.rn + 1
),
stepped AS (
  SELECT q.*, st.m, st.v, st.s1, st.s2, st.s3
  FROM seq q JOIN st USING (candidate_id, source_id, rn)
)
"""


def scored(multiplier: str = "1.0") -> str:
    return f"""
sf AS (
  SELECT *, least(1.0, least(cap, greatest({d(0.25)}, 1.0)) * source_score) AS surprise01 FROM (
    SELECT *, least(1.0, (surprise_base + least({d(0.25)}, momentum_raw * {d(0.08)})) * {multiplier}) AS source_score
    FROM (SELECT *, CASE WHEN s1 > 0 THEN 1 / (1 + exp(-(s1 - 1))) ELSE 0 END AS surprise_base,
      greatest(0, s1) + lam * greatest(0, s2) + lam * lam * greatest(0, s3) AS momentum_raw
      FROM stepped))
)
"""


SF = scored()
_FIT_ARMS = " ".join(
    f"WHEN '{t}:{f}' THEN {v!r}" for t, f, v in dims.domain_fit_rows()
)
_SURFACE = (
    "(CASE WHEN source_id LIKE '%\\_SONGS' ESCAPE '\\' THEN 'song'"
    " WHEN source_id LIKE '%\\_HASHTAGS' ESCAPE '\\' THEN 'hashtag' ELSE '' END)"
)
_SHORT = "starts_with(source_id, 'TIKTOK_CREATIVE_CENTER')"
_ASIA = "[" + ", ".join(f"'{c}'" for c in dims.ASIA_COUNTRIES) + "]"


def _total(cond: str) -> str:
    return f"coalesce(sum(surprise01) FILTER (WHERE {cond}), 0.0)"


_FAM_COLS = ",\n".join(
    f"{_total(f'family = {S.lit(f)}')} AS fam_{f.lower()}, count(*) FILTER (WHERE family = '{f}') AS cnt_{f.lower()},"
    f" count(*) FILTER (WHERE family = '{f}' AND support) AS sup_{f.lower()}"
    for f in dims.FAMILIES
)
_ROLE_COLS = ",\n".join(
    f"{_total(f'role = {S.lit(r)}')} AS role_{r.lower()}, count(*) FILTER (WHERE role = '{r}') AS n_{r.lower()}"
    for r in dims.ROLES[:4]
)
_PRESENT = "list_sort(list_filter([" + ", ".join(
    f"CASE WHEN cnt_{f.lower()} > 0 THEN '{f}' END" for f in dims.FAMILIES
) + "], lambda x: x IS NOT NULL))"

AGG = f"""
rows_ AS (
  SELECT *, role IN ('CONFIRMATION', 'EDITORIAL', 'COMMERCE') AS support,
    [CAST(0.4 AS DOUBLE), 0.7, 1.0][conf + 1] AS conf_w,
    coalesce(CASE candidate_type || ':' || family {_FIT_ARMS} END, 0.0) AS fit,
    {S.one_of('source_id', dims.HOME_SOURCES)} OR list_contains(countries, 'JP') AS home,
    len(list_intersect(countries, {_ASIA})) AS asia_hits,
    list_contains(countries, 'JP') OR len(list_intersect(countries, {_ASIA})) >= 2 AS asia_priority,
    {_SHORT} AS short, {_SURFACE} AS surface,
    (CASE WHEN list_contains(countries, 'JP') THEN 1.0 ELSE 0.0 END)
      + {d(0.6)} * len(list_filter(countries, lambda c: c <> 'JP')) AS region_raw
  FROM sf
),
prio AS (
  SELECT *, CASE WHEN short THEN (CASE surface WHEN 'song' THEN {d(1.15)} ELSE 1.0 END) * region_raw
      * (1 / log2(best_rank + 1)) * conf_w ELSE 0 END AS priority
  FROM rows_
),
agg0 AS (
  SELECT date, candidate_id, candidate_type, candidate_kind, count(*) AS source_count,
    avg(fit) AS domain_fit, avg(conf_w) AS extraction_confidence,
    sum(CAST(home AS INT)) AS home_sources, sum(asia_hits) AS asia_hits,
    max(CAST(asia_priority AS INT)) = 1 AS asia_priority,
    max(CAST(role = 'DISCOVERY' AND short AND asia_priority AND conf = 2 AS INT)) = 1 AS sv_flag,
    max(CAST(role = 'DISCOVERY' AND short AND conf = 2 AND (list_contains(countries, 'JP') OR len(countries) >= 2) AS INT)) = 1 AS sv_signal,
    max(CAST({S.one_of('source_id', dims.DIRECT_CHART_SOURCES)} AND NOT derived AS INT)) = 1 AS direct_chart,
    {_total("source_id = 'SEARCH_JP_24H_ENT'")} AS ent_raw,
    {_total("source_id = 'SEARCH_JP_24H_BEAUTY_FASHION'")} AS beauty_raw,
    {_total("source_id = 'YAHOO_REALTIME'")} AS realtime_raw,
    {_total("NOT derived")} AS direct_raw, {_total("NOT derived AND role = 'CONFIRMATION'")} AS direct_confirm_raw,
    count(*) FILTER (WHERE NOT derived) AS direct_rows, count(*) FILTER (WHERE derived) AS derived_rows,
    arg_min(domain, first_ord) AS domain_class,
    coalesce(max(region_raw) FILTER (WHERE short), 0.0) AS region_score,
    coalesce(max(CAST(list_contains(countries, 'JP') AS INT)) FILTER (WHERE short), 0) = 1 AS sv_home,
    max(priority) AS priority,
    coalesce(arg_max(surface, {{'p': priority, 'o': -first_ord}}) FILTER (WHERE priority > 0), '') AS best_surface,
    list_distinct(flatten(list(countries))) AS all_countries, list_distinct(flatten(list(regions))) AS all_regions,
    list_distinct(flatten(list(countries) FILTER (WHERE short))) AS sv_countries,
    count(DISTINCT surface) FILTER (WHERE short AND surface <> '') AS sv_surfaces,
    list(work) FILTER (WHERE derived AND work IS NOT NULL) AS works,
    coalesce(arg_min(work, first_ord) FILTER (WHERE derived AND work IS NOT NULL), '') AS work_cluster_id,
    {_ROLE_COLS},
    {_FAM_COLS}
  FROM prio GROUP BY ALL
),
agg AS (
  SELECT *, {_PRESENT} AS source_families, len({_PRESENT}) AS family_count,
    {' + '.join(f'CAST(sup_{f.lower()} > 0 AS INT)' for f in dims.FAMILIES)} AS support_families,
    ({' + '.join(f'greatest(0, cnt_{f.lower()} - 1)' for f in dims.FAMILIES)}) * {d(0.08)} AS redundancy_penalty,
    {' + '.join(f'fam_{f.lower()}' for f in dims.FAMILIES)} AS day_total,
    coalesce(list_max(list_transform(list_distinct(works), lambda w: len(list_filter(works, lambda x: x = w)))), 0) AS same_work,
    coalesce(len(list_distinct(works)), 0) AS distinct_works
  FROM agg0
),
roll AS (
  SELECT *, role_discovery AS discovery_rise, role_confirmation AS broad_confirmation,
    role_editorial AS editorial_support, role_commerce AS commerce_support,
    fam_music_chart AS music_confirmation, fam_show_chart AS show_confirmation,
    ln(1 + support_families) AS cross_family_confirm,
    CASE WHEN n_discovery > 0 THEN 1.0 ELSE 0.0 END AS has_discovery,
    CASE WHEN support_families > 0 THEN 1.0 ELSE 0.0 END AS has_confirmation,
    CASE WHEN n_discovery > 0 AND support_families > 0 THEN 0.25 ELSE 0.0 END AS lead_lag_bonus,
    least(1.0, (len(all_countries) + len(all_regions)) / 4.0) AS regional_overlap,
    CASE WHEN asia_priority THEN 1.0 ELSE 0.0 END AS regional_priority,
    CASE WHEN sv_flag THEN 1.0 ELSE 0.0 END AS short_video_priority,
    CASE WHEN derived_rows > 0 THEN round(same_work / derived_rows, 4) ELSE 0.0 END AS dominant_work_ratio,
    round(priority, 4) AS sv_priority_score, round(region_score, 4) AS sv_region_score,
    round(direct_raw, 4) AS direct_support_total, round(direct_confirm_raw, 4) AS direct_confirmation_support,
    CASE WHEN family_count <= 1 AND source_count <= 1 THEN 1.0 WHEN family_count <= 1 THEN 0.6
      WHEN source_count <= 2 THEN 0.35 ELSE 0.1 END AS locality,
    round(least(1.5, coalesce(avg(day_total) OVER w7, 0)), 4) AS maturity,
    count(*) FILTER (WHERE day_total > 0) OVER w7 AS positive_days,
    coalesce(sum(day_total) FILTER (WHERE day_total > 0) OVER w7, 0) AS positive_sum
  FROM agg WINDOW w7 AS (PARTITION BY candidate_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
)
"""

_TYPES_W = S.case("relation_type", dims.RELATION_WEIGHTS, dims.RELATION_WEIGHTS["associated_with_work"])
_REL_TYPES = (*dims.PROPAGATING_RELATIONS, "has_cast")
RELATIONS = f"""
edges AS (
  SELECT 'k' || (l_partkey % 100) AS src_id, {S.pick(_REL_TYPES, f'(l_partkey % 100) % {len(_REL_TYPES)}')} AS relation_type,
    'k' || (((l_partkey % 100) * 7 + 3) % 100) AS dst_id,
    max(round({d(0.2)} + l_discount * 5, 4)) AS confidence
  FROM lineitem GROUP BY ALL
),
base_signal AS (
  SELECT date, candidate_id, max(surprise01) AS base,
    max(CAST({S.one_of('source_id', dims.STREAM_SOURCES)} AS INT)) = 1 AS via_stream,
    max(CAST({S.one_of('source_id', dims.CATCHUP_SOURCES)} AS INT)) = 1 AS via_catchup,
    max(CAST(role = 'CONFIRMATION' AS INT)) = 1 AS confirmed
  FROM sf GROUP BY ALL HAVING max(surprise01) > 0
),
propagated AS (
  SELECT date, dst_id, relation_type, via_stream, via_catchup, confirmed,
    least(1.0, base * {_TYPES_W} * greatest(0.25, confidence)) AS p
  FROM base_signal JOIN edges ON src_id = candidate_id
  WHERE {S.one_of('relation_type', dims.PROPAGATING_RELATIONS)}
),
support AS (
  SELECT date, dst_id AS candidate_id, least(1.0, sum(p)) AS relation_support_total,
    least(1.0, coalesce(sum(p) FILTER (WHERE confirmed), 0)) AS relation_confirmed_support,
    least(1.0, coalesce(sum(p * {d(0.8)}) FILTER (WHERE via_catchup), 0)) AS catchup_relation_support,
    least(1.0, coalesce(sum(p) FILTER (WHERE via_stream), 0)) AS stream_relation_support_show,
    least(1.0, coalesce(sum(p) FILTER (WHERE via_stream AND relation_type = 'theme_song_of'), 0)) AS stream_relation_support_music,
    least(1.0, coalesce(sum(p) FILTER (WHERE via_stream AND relation_type IN ('features_in', 'voice_acts_in', 'appears_in_reality_show')), 0)) AS stream_relation_support_people
  FROM propagated GROUP BY ALL
)
"""

_N1, _N2, _N3 = "n1", "n2", "n3"
CANDIDATES = f"""
cand_names AS (SELECT DISTINCT candidate_id, name FROM mentions),
cand1 AS (SELECT *, {S.norm_topic('name')} AS n1 FROM cand_names),
cand2 AS (SELECT *, {S.norm_topic('n1')} AS n2 FROM cand1),
cand3 AS (SELECT *, {S.norm_topic('n2')} AS n3 FROM cand2),
cands AS (
  SELECT candidate_id, name AS display_name, {S.specificity('n1', 'n2')} AS topic_specificity,
    {S.objectness('n1')} AS behavior_objectness, {S.genericity('n1', 'n2', 'n3')} AS genericity,
    {S.live_bias('n2')} AS live_bias
  FROM cand3
)
"""

_PERSON = S.one_of("candidate_type", dims.PERSON_TYPES)
DERIVED = f"""
joined AS (
  SELECT r.*, c.display_name, c.topic_specificity, c.behavior_objectness, c.genericity, c.live_bias,
    round(coalesce(s.relation_support_total, 0), 4) AS relation_support_total,
    round(coalesce(s.relation_confirmed_support, 0), 4) AS relation_confirmed_support,
    round(coalesce(s.catchup_relation_support, 0), 4) AS catchup_relation_support
  FROM roll r LEFT JOIN support s USING (date, candidate_id) LEFT JOIN cands c USING (candidate_id)
),
der1 AS (
  SELECT *, {clamp(f'1 / (1 + ln(1 + positive_days + maturity * 5))', 0.0, 1.0)} AS novelty,
    CASE WHEN positive_days > 0 THEN least(1.0, positive_sum / greatest(1.0, positive_days * 4.0)) ELSE 0.0 END AS sustained_presence,
    maturity * {d(0.6)} + CASE WHEN has_discovery > 0 THEN 0.0 ELSE 0.25 END AS maturity_penalty,
    round({clamp(f"least(1.0, home_sources * {d(0.24)} + least(asia_hits, 4) * {d(0.08)}) + CASE WHEN domain_class IN ('ENTERTAINMENT', 'FASHION_BEAUTY') THEN {d(0.08)} ELSE 0.0 END", 0.0, 1.0)}, 4) AS home_relevance,
    round(least(1.0, CASE WHEN domain_class = 'ENTERTAINMENT' THEN least(1.0, ent_raw * {d(1.1)}) ELSE ent_raw END), 4) AS constrained_ent,
    round(least(1.0, CASE WHEN domain_class = 'FASHION_BEAUTY' THEN least(1.0, beauty_raw * {d(1.1)}) ELSE beauty_raw END), 4) AS constrained_beauty,
    round(least(1.0, realtime_raw), 4) AS realtime_support,
    CASE WHEN candidate_kind <> 'TOPIC' THEN {d(0.05)} ELSE round({clamp(
        f"{d(0.34)} * locality + {d(0.28)} * genericity + {d(0.22)} * live_bias + {d(0.12)} * (1 - topic_specificity)"
        f" + CASE WHEN candidate_type = 'BEHAVIOR' THEN {d(0.14)} * (1 - behavior_objectness) ELSE 0.0 END", 0.0, 1.0)}, 4) END AS public_noise_penalty,
    CASE WHEN maturity < 0.8 OR has_discovery > 0 OR music_confirmation + show_confirmation <= 0 THEN 0.0
      ELSE round(least(1.0, {d(0.28)} + maturity * {d(0.35)} + (music_confirmation + show_confirmation) * {d(0.18)}), 4) END AS mature_mass_only_penalty,
    {_PERSON} AND direct_raw < 0.08 AND direct_rows = 0 AND (relation_support_total > 0 OR derived_rows > 0) AS relation_only_flag,
    CASE WHEN {_PERSON} THEN {round4(f"least({d(0.35)}, greatest(0, distinct_works - 1) * {d(0.12)} + greatest(0.0, maturity - {d(0.7)}) * 0.25)")} ELSE 0.0 END AS omnipresence_penalty,
    least(1.0, greatest(0, same_work - 1) * 0.5 + dominant_work_ratio * {d(0.35)}) AS same_work_cluster_penalty
  FROM joined
),
derived AS (
  SELECT *, greatest(constrained_ent, constrained_beauty) AS constrained_support,
    greatest(constrained_ent, constrained_beauty, realtime_support) AS home_credibility,
    round(greatest(constrained_ent, constrained_beauty, realtime_support), 4) AS adjusted_credibility,
    CASE WHEN relation_only_flag THEN 1.0 ELSE 0.0 END AS relation_only_penalty,
    1.0 AS posterior_reliability, 0.0 AS posterior_lead, 0.0 AS posterior_persistence
  FROM der1
)
"""


def linear(coefs: dict[str, float], intercept: float) -> str:
    return f"{d(intercept)} + " + " + ".join(f"{d(v)} * {k}" for k, v in coefs.items())


def calibrate(p: str, knots) -> str:
    arms = [f"WHEN {p} <= {d(knots[0][0])} THEN {d(knots[0][1])}"]
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        arms.append(f"WHEN {p} < {d(x1)} THEN {d(y0)} + ({p} - {d(x0)}) / {d(x1 - x0)} * {d(y1 - y0)}")
    return f"(CASE {' '.join(arms)} ELSE {d(knots[-1][1])} END)"


def _logistic(e: str) -> str:
    return f"(1 / (1 + exp(-({e}))))"


_GAMMA = clamp(
    "(CASE WHEN candidate_type IN ('PHRASE', 'HASHTAG', 'BEHAVIOR', 'STYLE') THEN CAST(0.18 AS DOUBLE)"
    " WHEN candidate_type IN ('SHOW', 'REALITY_SHOW', 'WORK', 'MUSIC_TRACK') THEN 0.31"
    f" WHEN {_PERSON} THEN 0.22 ELSE 0.24 END)"
    " + (CASE domain_class WHEN 'ENTERTAINMENT' THEN CAST(0.03 AS DOUBLE) WHEN 'BUSINESS_PROFESSIONAL' THEN -0.02 ELSE 0 END)",
    0.12, 0.38,
)
FUSED = f"""
prob0 AS (
  SELECT *, {', '.join(f"{_logistic(linear(X.BREAKOUT, X.BREAKOUT_INTERCEPT) + f' + {d(b)}')} AS bp{h}" for h, b in X.HORIZON_BIAS.items())},
    {_logistic(linear(X.MASS, X.MASS_INTERCEPT))} AS mp
  FROM derived
),
prob AS (
  SELECT *, {', '.join(f"{calibrate(f'bp{h}', N.BREAKOUT_KNOTS)} AS breakout_prob_{h}d" for h in X.HORIZON_BIAS)},
    {calibrate('mp', N.MASS_KNOTS)} AS mass_prob,
    least(1.0, {d(0.6)} + extraction_confidence * {d(0.2)} + least(1.0, family_count / 3.0) * {d(0.2)}) AS source_credibility,
    least(1.0, family_count * {d(0.35)} + source_count * {d(0.08)}) AS evidence_diversity,
    greatest(constrained_support, realtime_support * {d(0.8)}, home_relevance * 0.75) AS category_fit,
    CASE WHEN family_count <= 1 AND source_count <= 1 THEN 1.0 ELSE 0.0 END AS single_source_domination
  FROM prob0
),
pub0 AS (SELECT *, {_logistic(linear(X.PUBLIC, X.PUBLIC_INTERCEPT))} AS pp FROM prob),
pub AS (
  SELECT *, {calibrate('pp', N.BREAKOUT_KNOTS)} AS public_rankability_prob,
    breakout_prob_7d * 4 AS coming_score, mass_prob * 4 AS mass_heat,
    round(4 * breakout_prob_7d + 4 * {_GAMMA} * mass_prob, 4) AS model_primary_score
  FROM pub0
),
score AS (
  SELECT *, round({d(0.62)} * coming_score + {d(0.18)} * mass_heat + {d(0.2)} * (4 * public_rankability_prob)
    - {d(0.35)} * same_work_cluster_penalty - {d(0.28)} * omnipresence_penalty, 4) AS public_score
  FROM pub
),
gate0 AS (
  SELECT *, CASE
    WHEN public_noise_penalty >= 0.70 THEN FALSE
    WHEN public_rankability_prob < 0.50 THEN FALSE
    WHEN mature_mass_only_penalty > 0.85 THEN FALSE
    WHEN relation_only_flag THEN FALSE
    WHEN catchup_relation_support > 0.18 AND direct_support_total < 0.08 THEN FALSE
    WHEN candidate_kind = 'TOPIC' AND has_discovery > 0 AND family_count >= 2
      THEN breakout_prob_7d >= 0.52 AND (adjusted_credibility > 0 OR relation_support_total > 0.18)
    WHEN candidate_kind = 'TOPIC' AND has_discovery > 0 AND family_count = 1 THEN
      CASE WHEN NOT sv_signal THEN FALSE
        WHEN breakout_prob_7d < (CASE best_surface WHEN 'song' THEN 0.62 WHEN 'hashtag' THEN 0.70 ELSE 0.78 END) THEN FALSE
        WHEN adjusted_credibility <= 0.08 THEN FALSE
        WHEN best_surface = 'song' THEN sv_home AND sv_region_score >= 2.2 AND public_noise_penalty <= 0.25
          AND (direct_chart OR constrained_ent > 0)
        WHEN best_surface = 'hashtag' THEN sv_region_score >= 1.6 AND topic_specificity >= 0.55
          AND NOT (candidate_type = 'BEHAVIOR' AND behavior_objectness < 0.45) AND public_noise_penalty <= 0.40
          AND (constrained_support > 0 OR realtime_support > 0)
        ELSE FALSE END
    WHEN candidate_kind = 'TOPIC' THEN FALSE
    WHEN relation_support_total > 0 AND has_discovery = 0 AND home_credibility <= 0
      THEN public_rankability_prob >= 0.60 AND relation_support_total >= 0.25 AND direct_support_total >= 0.08
    WHEN has_discovery > 0 AND breakout_prob_7d >= 0.55 THEN TRUE
    ELSE {S.one_of('candidate_type', dims.CHART_TYPES)} AND novelty >= 0.4 AND source_count >= 2
      AND public_noise_penalty <= 0.5
      AND (music_confirmation > 0.35 OR show_confirmation > 0.35 OR direct_confirmation_support > 0.2)
    END AS ranking_gate_passed
  FROM score
),
cf AS (
  SELECT *, ranking_gate_passed AND public_rankability_prob >= 0.5 AS public_gate_passed,
    (coming_score + {d(0.35)} * mass_heat) * (CASE WHEN ranking_gate_passed THEN 1.0
      WHEN candidate_kind = 'TOPIC' AND has_discovery > 0 AND family_count = 1 THEN 0.25
      WHEN has_discovery = 0 AND family_count = 1 AND (music_confirmation > 0 OR show_confirmation > 0) THEN {d(0.2)}
      WHEN family_count >= 2 THEN {d(0.45)} ELSE {d(0.35)} END) AS primary_score,
    {S.case('candidate_type', dims.LANE_BY_TYPE, 'shadow')} AS lane
  FROM gate0
)
"""


def chain(*parts: str, tail: str) -> str:
    """One statement from CTE blocks and the final select."""
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + tail.strip()


TO_SF = (MENTIONS, FOLD, SF)
TO_ROLL = (*TO_SF, AGG)
TO_DERIVED = (*TO_ROLL, RELATIONS, CANDIDATES, DERIVED)
TO_CF = (*TO_DERIVED, FUSED)
