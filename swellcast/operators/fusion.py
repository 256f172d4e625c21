"""Logit fusion, calibration, scores and the ranking gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.dims import AlgorithmConfig
from swellcast.functions import numeric as N

# --- Fixed values: logit coefficients by feature column --------------------------------
BREAKOUT = {
    "discovery_rise": 1.9, "broad_confirmation": 0.42, "cross_family_confirm": 0.38,
    "lead_lag_bonus": 0.34, "novelty": 0.52, "domain_fit": 0.28, "extraction_confidence": 0.22,
    "posterior_reliability": 0.44, "posterior_lead": 0.18, "posterior_persistence": 0.12,
    "regional_overlap": 0.22, "regional_priority": 0.18, "short_video_priority": 0.25,
    "direct_support_total": 0.22, "direct_confirmation_support": 0.18, "sv_priority_score": 0.18,
    "adjusted_credibility": 0.14, "home_relevance": 0.26, "constrained_support": 0.24,
    "realtime_support": 0.18, "relation_confirmed_support": 0.16, "family_count": 0.12,
    "public_noise_penalty": -0.22, "relation_only_penalty": -0.24,
    "same_work_cluster_penalty": -0.18, "omnipresence_penalty": -0.20,
    "maturity_penalty": -0.84, "redundancy_penalty": -0.72,
}
BREAKOUT_INTERCEPT = -1.34
HORIZON_BIAS = {1: -0.42, 3: -0.18, 7: 0.0, 14: 0.14}
MASS = {
    "discovery_rise": 0.42, "broad_confirmation": 1.35, "editorial_support": 0.62,
    "commerce_support": 0.54, "sustained_presence": 0.58, "posterior_reliability": 0.34,
    "posterior_persistence": 0.26, "regional_overlap": 0.18, "has_confirmation": 0.24,
    "music_confirmation": 0.12, "show_confirmation": 0.12, "direct_confirmation_support": 0.10,
    "home_relevance": 0.18, "relation_confirmed_support": 0.12, "novelty": -0.38,
    "public_noise_penalty": -0.32, "same_work_cluster_penalty": -0.08, "redundancy_penalty": -0.28,
}
MASS_INTERCEPT = -0.92
PUBLIC = {
    "breakout_prob_7d": 2.1, "constrained_support": 0.52, "realtime_support": 0.48,
    "home_relevance": 0.44, "source_credibility": 0.35, "evidence_diversity": 0.28,
    "category_fit": 0.24, "relation_confirmed_support": 0.22, "direct_confirmation_support": 0.18,
    "sv_priority_score": 0.16, "adjusted_credibility": 0.12, "public_noise_penalty": -0.95,
    "mature_mass_only_penalty": -0.72, "relation_only_penalty": -0.42,
    "same_work_cluster_penalty": -0.28, "omnipresence_penalty": -0.32,
    "single_source_domination": -0.4,
}
PUBLIC_INTERCEPT = -1.12

# The feature vector of the fusion model: name -> column.
VECTOR = {
    "candidate_kind_topic": None, "candidate_kind_entity": None,
    **{n: n for n in (
        "discovery_rise", "broad_confirmation", "editorial_support", "commerce_support",
        "cross_family_confirm", "lead_lag_bonus", "redundancy_penalty", "has_discovery",
        "has_confirmation", "music_confirmation", "show_confirmation", "novelty", "domain_fit",
        "extraction_confidence", "maturity_penalty", "sustained_presence", "source_count",
        "family_count",
    )},
    "discovery_source_count": "n_discovery", "confirmation_source_count": "n_confirmation",
    "editorial_source_count": "n_editorial", "commerce_source_count": "n_commerce",
    **{n: n for n in (
        "posterior_reliability", "posterior_lead", "posterior_persistence", "regional_overlap",
        "regional_priority", "short_video_priority", "direct_support_total",
        "direct_confirmation_support", "relation_support_total", "relation_confirmed_support",
        "catchup_relation_support", "relation_only_penalty", "same_work_cluster_penalty",
        "omnipresence_penalty", "sv_priority_score", "adjusted_credibility",
    )},
    "search_family_score": "fam_search", "social_family_score": "fam_social_discovery",
    "music_family_score": "fam_music_chart", "show_family_score": "fam_show_chart",
    "editorial_family_score": "fam_editorial", "commerce_family_score": "fam_commerce",
    "discovery_role_score": "role_discovery", "confirmation_role_score": "role_confirmation",
    "editorial_role_score": "role_editorial", "commerce_role_score": "role_commerce",
    "search_family_count": "cnt_search", "social_family_count": "cnt_social_discovery",
    "music_family_count": "cnt_music_chart", "show_family_count": "cnt_show_chart",
    "editorial_family_count": "cnt_editorial", "commerce_family_count": "cnt_commerce",
    "home_relevance": "home_relevance", "constrained_support": "constrained_support",
    "realtime_support": "realtime_support", "public_noise_penalty": "public_noise_penalty",
}


def fusion_vector() -> Column:
    """The named feature vector as a map of doubles rounded to 4 digits."""
    topic = F.when(F.col("candidate_kind") == "TOPIC", 1.0).otherwise(0.0)
    entries = []
    for name, column in VECTOR.items():
        value = topic if name == "candidate_kind_topic" else 1.0 - topic if column is None else F.col(column)
        entries += [F.lit(name), F.round(value.cast("double"), 4)]
    return F.create_map(*entries)


def breakout_probability(horizon_days: int) -> Column:
    logit = N.linear(BREAKOUT, BREAKOUT_INTERCEPT + HORIZON_BIAS.get(horizon_days, 0.0))
    return N.calibrate(N.logistic(logit), N.BREAKOUT_KNOTS)


def with_probabilities(df: DataFrame, horizons: tuple[int, ...] = (1, 3, 7, 14)) -> DataFrame:
    c = F.col
    # One linear form serves every horizon; only the bias differs.
    df = df.withColumns({
        "breakout_logit": N.linear(BREAKOUT, BREAKOUT_INTERCEPT),
        "mass_p": N.logistic(N.linear(MASS, MASS_INTERCEPT)),
    })
    df = df.withColumns(
        {f"breakout_p{h}": N.logistic(c("breakout_logit") + HORIZON_BIAS[h]) for h in horizons}
    )
    calibrated = {
        f"breakout_prob_{h}d": N.calibrate(c(f"breakout_p{h}"), N.BREAKOUT_KNOTS) for h in horizons
    }
    calibrated["mass_prob"] = N.calibrate(c("mass_p"), N.MASS_KNOTS)
    return df.withColumns(calibrated).drop("mass_p", *[f"breakout_p{h}" for h in horizons])


def with_public_probability(df: DataFrame) -> DataFrame:
    c = F.col
    df = df.withColumns({
        "source_credibility": F.least(
            F.lit(1.0),
            c("posterior_reliability") * 0.6 + c("extraction_confidence") * 0.2
            + F.least(F.lit(1.0), c("family_count") / 3.0) * 0.2,
        ),
        "evidence_diversity": F.least(
            F.lit(1.0), c("family_count") * 0.35 + c("source_count") * 0.08
        ),
        "category_fit": F.greatest(
            c("constrained_support"), c("realtime_support") * 0.8, c("home_relevance") * 0.75
        ),
        "single_source_domination": F.when(
            (c("family_count") <= 1) & (c("source_count") <= 1), 1.0
        ).otherwise(0.0),
    }).withColumn("public_p", N.logistic(N.linear(PUBLIC, PUBLIC_INTERCEPT)))
    return df.withColumn(
        "public_rankability_prob", N.calibrate(c("public_p"), N.BREAKOUT_KNOTS)
    ).drop("public_p")


def mass_gamma() -> Column:
    t, d = F.col("candidate_type"), F.col("domain_class")
    base = (
        F.when(t.isin("PHRASE", "HASHTAG", "BEHAVIOR", "STYLE"), 0.18)
        .when(t.isin("SHOW", "REALITY_SHOW", "WORK", "MUSIC_TRACK"), 0.31)
        .when(t.isin(*dims.PERSON_TYPES), 0.22)
        .otherwise(0.24)
    )
    shift = F.when(d == "ENTERTAINMENT", 0.03).when(d == "BUSINESS_PROFESSIONAL", -0.02).otherwise(0.0)
    return N.clamp(base + shift, 0.12, 0.38)


def with_scores(df: DataFrame) -> DataFrame:
    c = F.col
    df = df.withColumns({
        "coming_score": c("breakout_prob_7d") * 4.0,
        "mass_heat": c("mass_prob") * 4.0,
        "model_primary_score": F.round(
            4.0 * c("breakout_prob_7d") + 4.0 * mass_gamma() * c("mass_prob"), 4
        ),
        "heuristic_coming": F.greatest(
            F.lit(0.0),
            c("discovery_rise") + c("cross_family_confirm") + c("lead_lag_bonus") + c("novelty")
            + c("domain_fit") + c("extraction_confidence") - c("maturity_penalty")
            - c("redundancy_penalty"),
        ),
        "heuristic_mass": F.greatest(
            F.lit(0.0),
            c("broad_confirmation") + c("editorial_support") * 0.5 + c("commerce_support") * 0.35
            + c("sustained_presence") + F.when(c("maturity") > 0.8, 0.35).otherwise(0.0),
        ),
    })
    return df.withColumn(
        "public_score",
        F.round(
            0.62 * c("coming_score") + 0.18 * c("mass_heat")
            + 0.20 * (4.0 * c("public_rankability_prob"))
            - 0.35 * c("same_work_cluster_penalty") - 0.28 * c("omnipresence_penalty"),
            4,
        ),
    )


def availability_threshold(base: Column, ratio: Column, floor: float = 0.5) -> Column:
    return F.round(base * F.greatest(F.lit(floor), ratio), 4)


def ranking_gate(cfg: AlgorithmConfig, rules: dict) -> Column:
    """Ordered decision list; the order of the branches is part of the meaning."""
    c = F.col
    person = c("candidate_type").isin(*dims.PERSON_TYPES)
    topic = c("candidate_kind") == "TOPIC"
    found = c("has_discovery") > 0
    p7, noise, surface = c("breakout_prob_7d"), c("public_noise_penalty"), c("best_surface")
    single_threshold = (
        F.when(surface == "song", rules["short_video_song_threshold"])
        .when(surface == "hashtag", rules["short_video_topic_threshold"])
        .when(surface == "video", rules["short_video_video_threshold"])
        .when(surface == "creator", 1.0)
        .otherwise(rules["topic_single_family_public_threshold"])
    )
    min_credibility = (
        F.when(surface == "song", rules["short_video_song_credibility_min"])
        .when(surface == "hashtag", rules["short_video_topic_credibility_min"])
        .when(surface == "video", rules["short_video_video_credibility_min"])
        .when(surface == "creator", rules["short_video_creator_credibility_min"])
        .otherwise(0.08)
    )
    video = surface == "video"
    song_ok = (
        c("sv_primary_home") & (c("sv_region_score") >= 2.2) & (noise <= 0.25)
        & (c("direct_chart_row") | (c("constrained_ent") > 0))
    )
    tag_ok = (
        (c("sv_region_score") >= F.when(video, rules["short_video_video_region_min"]).otherwise(
            rules["short_video_hashtag_region_min"]))
        & (c("topic_specificity") >= 0.55)
        & ~((c("candidate_type") == "BEHAVIOR") & (c("behavior_objectness") < 0.45))
        & (noise <= F.when(video, rules["short_video_video_noise_max"]).otherwise(
            rules["short_video_topic_noise_max"]))
        & ((c("constrained_support") > 0) | (c("realtime_support") > 0))
    )
    single_family = (
        F.when(~c("sv_priority_signal") | (surface == "creator"), False)
        .when(p7 < availability_threshold(single_threshold, c("search_availability")), False)
        .when(c("adjusted_credibility") <= min_credibility, False)
        .when(surface == "song", song_ok)
        .when(surface.isin("hashtag", "video"), tag_ok)
        .otherwise(False)
    )
    chart_ok = (
        c("candidate_type").isin(*dims.CHART_TYPES) & (c("novelty") >= 0.4)
        & (c("source_count") >= 2) & (noise <= 0.5)
        & ((c("music_confirmation") > 0.35) | (c("show_confirmation") > 0.35)
           | (c("direct_confirmation_support") > 0.2))
    )
    return (
        F.when(noise >= rules["low_value_penalty_block_threshold"], False)
        .when(c("public_rankability_prob") < rules["public_rankability_min"], False)
        .when(c("mature_mass_only_penalty") > 0.85, False)
        .when(c("relation_only_flag") & person, False)
        .when(
            (c("catchup_relation_support") > rules["capped_relation_support"])
            & (c("direct_support_total") < 0.08),
            False,
        )
        .when(
            topic & found & (c("family_count") >= 2),
            (p7 >= rules["topic_multi_family_public_threshold"])
            & ((c("adjusted_credibility") > 0) | (c("relation_support_total") > 0.18)),
        )
        .when(topic & found & (c("family_count") == 1), single_family)
        .when(topic, False)
        .when(
            (c("relation_support_total") > 0) & ~found & (c("home_credibility") <= 0),
            (c("public_rankability_prob") >= rules["relation_only_public_threshold"])
            & (c("relation_support_total") >= 0.25) & (c("direct_support_total") >= 0.08),
        )
        .when(found & (p7 >= cfg.gate_discovery_threshold), True)
        .otherwise(chart_ok)
    )


def ungated_multiplier() -> Column:
    c = F.col
    found = c("has_discovery") > 0
    return (
        F.when((c("candidate_kind") == "TOPIC") & found & (c("family_count") == 1), 0.25)
        .when(
            ~found & (c("family_count") == 1)
            & ((c("music_confirmation") > 0) | (c("show_confirmation") > 0)),
            0.2,
        )
        .when(c("family_count") >= 2, 0.45)
        .otherwise(0.35)
    )


def with_gates(df: DataFrame, cfg: AlgorithmConfig | None = None, rules: dict | None = None) -> DataFrame:
    cfg, rules, c = cfg or AlgorithmConfig(), rules or dims.RULES, F.col
    return (
        df.withColumn("ranking_gate_passed", ranking_gate(cfg, rules))
        .withColumn(
            "public_gate_passed",
            c("ranking_gate_passed")
            & (c("public_rankability_prob") >= rules["public_rankability_min"]),
        )
        .withColumn(
            "primary_score",
            (c("coming_score") + cfg.mass_heat_weight * c("mass_heat"))
            * F.when(c("ranking_gate_passed"), 1.0).otherwise(ungated_multiplier()),
        )
        .withColumn("lane", N.by_key(c("candidate_type"), dims.LANE_BY_TYPE, "shadow"))
    )


def fuse(derived: DataFrame, cfg: AlgorithmConfig | None = None) -> DataFrame:
    """From derived candidate columns to probabilities, scores and gates."""
    return with_gates(with_scores(with_public_probability(with_probabilities(derived))), cfg)
