"""Candidate features: one wide aggregate per (date, candidate), then projections.

A (date, candidate) group has at most one row per catalogued source, so every
collected list below is bounded by the catalog, whatever the raw volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.functions import numeric as N
from swellcast.functions import text as T

KEYS = ("date", "candidate_id")
_RADIX = 8

# Columns of the relation support table; absent candidates get zeros.
SUPPORT_COLUMNS = (
    "relation_support_total", "relation_confirmed_support", "catchup_relation_support",
    "stream_relation_support_show", "stream_relation_support_music",
    "stream_relation_support_people",
)


def surface_of(source_id: Column, surface: Column) -> Column:
    """Short-video surface: stated, else read off the source id."""
    stated = F.lower(F.trim(F.coalesce(surface, F.lit(""))))
    return (
        F.when(stated != "", stated)
        .when(source_id.endswith("_SONGS"), "song")
        .when(source_id.endswith("_HASHTAGS"), "hashtag")
        .when(source_id.endswith("_VIDEOS"), "video")
        .when(source_id.endswith("_CREATORS"), "creator")
        .when(source_id == dims.SHORT_VIDEO_PREFIX, "hashtag")
        .otherwise("")
    )


def _is_short_video(source_id: Column) -> Column:
    return (source_id == dims.SHORT_VIDEO_PREFIX) | source_id.startswith(
        dims.SHORT_VIDEO_PREFIX + "_"
    )


def prepare_rows(source_features: DataFrame) -> DataFrame:
    """Per-source-row inputs of the candidate aggregate."""
    role, sid = F.col("source_role"), F.col("source_id")
    asia = F.array(*[F.lit(c) for c in dims.ASIA_COUNTRIES])
    upper = F.transform("countries", lambda c: F.upper(c))
    has_home = F.array_contains(F.col("countries"), dims.HOME_COUNTRY)
    asia_hits = F.size(F.array_intersect(upper, asia))
    short = _is_short_video(sid)
    ranked = F.map_keys("country_ranks")
    sv_countries = F.array_union(F.col("countries"), ranked)
    sv_home = F.array_contains(sv_countries, dims.HOME_COUNTRY)
    region_score = F.when(sv_home, 1.0).otherwise(0.0) + 0.6 * (
        F.size(sv_countries) - F.when(sv_home, 1).otherwise(0)
    )
    best_rank = F.coalesce(F.array_min(F.map_values("country_ranks")), F.lit(50))
    conf_weight = N.by_key(F.col("confidence"), dims.CONFIDENCE_WEIGHT, 0.0)
    df = source_features.withColumn("surface", surface_of(sid, F.col("surface")))
    surface_weight = N.by_key(F.col("surface"), dims.SURFACE_WEIGHT, 1.0)
    df = (
        df.withColumn("is_support", role.isin(*dims.SUPPORT_ROLES))
        .withColumn("is_short", short)
        .withColumn("conf_weight", conf_weight)
        .withColumn(
            "is_home",
            sid.isin(*dims.HOME_SOURCES) | F.array_contains(upper, dims.HOME_COUNTRY),
        )
        .withColumn("asia_hits", asia_hits)
        .withColumn("asia_priority", has_home | (F.size(F.array_intersect(F.col("countries"), asia)) >= 2))
        .withColumn("region_score", F.when(short, region_score))
        .withColumn("sv_home", short & sv_home)
        .withColumn("sv_countries", F.when(short, sv_countries))
    )
    return df.withColumn(
        "priority_score",
        F.when(
            short,
            surface_weight * F.col("region_score") * N.rank_exposure(best_rank) * F.col("conf_weight"),
        ),
    ).withColumn(
        "sv_priority_signal",
        short & (role == "DISCOVERY") & (F.col("confidence") == "HIGH")
        & (has_home | F.array_contains(ranked, dims.HOME_COUNTRY) | (F.size("countries") >= 2)),
    )


def aggregate_candidates(source_features: DataFrame, fit: DataFrame) -> DataFrame:
    """The one wide ``groupBy(date, candidate)`` behind every candidate-level operator."""
    rows = prepare_rows(source_features).join(
        F.broadcast(fit), ["candidate_type", "family_primary"], "left"
    )
    s, role, fam, sid = (
        F.col("surprise01"), F.col("source_role"), F.col("family_primary"), F.col("source_id"),
    )
    direct = ~F.coalesce(F.col("derived_from_work"), F.lit(False))
    cluster = F.when(
        ~direct & (F.trim(F.coalesce("work_cluster_id", F.lit(""))) != ""),
        F.trim("work_cluster_id"),
    )
    total = lambda cond: F.coalesce(F.sum(F.when(cond, s)), F.lit(0.0))
    aggs: list[Column] = [
        F.count("*").alias("source_count"),
        F.avg(F.coalesce("fit", F.lit(0.0))).alias("domain_fit"),
        F.avg("conf_weight").alias("extraction_confidence"),
        F.coalesce(
            F.avg(F.when(F.col("posterior_reliability") != 0, F.col("posterior_reliability"))),
            F.lit(0.0),
        ).alias("posterior_reliability"),
        F.avg("posterior_lead").alias("posterior_lead"),
        F.avg("posterior_persistence").alias("posterior_persistence"),
        F.sum(F.col("is_home").cast("int")).alias("home_sources"),
        F.sum("asia_hits").alias("asia_hits"),
        F.max("asia_priority").alias("asia_priority"),
        F.max(
            (role == "DISCOVERY") & sid.startswith(dims.SHORT_VIDEO_PREFIX)
            & F.col("asia_priority") & (F.col("confidence") == "HIGH")
        ).alias("short_video_flag"),
        F.max("sv_priority_signal").alias("sv_priority_signal"),
        F.max(sid.isin(*dims.DIRECT_CHART_SOURCES) & direct).alias("direct_chart_row"),
        total(sid == dims.SEARCH_ENT).alias("ent_raw"),
        total(sid == dims.SEARCH_BEAUTY).alias("beauty_raw"),
        total(sid == dims.REALTIME).alias("realtime_raw"),
        total(direct).alias("direct_raw"),
        total(direct & (role == "CONFIRMATION")).alias("direct_confirm_raw"),
        F.count(F.when(direct, 1)).alias("direct_rows"),
        F.count(F.when(~direct, 1)).alias("derived_rows"),
        F.min(
            F.when(
                F.col("domain_class") != "OTHER",
                F.col("first_ordinal") * _RADIX
                + sum(
                    F.when(F.col("domain_class") == d, i).otherwise(0)
                    for i, d in enumerate(dims.DOMAINS)
                ),
            )
        ).alias("domain_pack"),
        F.max("region_score").alias("region_score"),
        F.max("sv_home").alias("sv_home"),
        F.max(F.coalesce("priority_score", F.lit(0.0))).alias("priority_score"),
        F.max_by(
            "surface", F.when(F.col("priority_score") > 0, F.struct("priority_score", -F.col("first_ordinal")))
        ).alias("best_surface"),
        F.flatten(F.collect_list("countries")).alias("_countries"),
        F.flatten(F.collect_list("regions")).alias("_regions"),
        F.flatten(F.collect_list("sv_countries")).alias("_sv_countries"),
        F.collect_set(F.when(F.col("is_short") & (F.col("surface") != ""), F.col("surface"))).alias(
            "_sv_surfaces"
        ),
        F.collect_list(cluster).alias("_clusters"),
        F.min_by(cluster, F.when(cluster.isNotNull(), F.col("first_ordinal"))).alias(
            "work_cluster_id"
        ),
    ]
    for r in dims.ROLES[:4]:
        aggs.append(total(role == r).alias(f"role_{r.lower()}"))
        aggs.append(F.count(F.when(role == r, 1)).alias(f"n_{r.lower()}"))
    for f in dims.FAMILIES:
        aggs.append(total(fam == f).alias(f"fam_{f.lower()}"))
        aggs.append(F.count(F.when(fam == f, 1)).alias(f"cnt_{f.lower()}"))
        aggs.append(F.count(F.when((fam == f) & F.col("is_support"), 1)).alias(f"sup_{f.lower()}"))
    grouped = rows.groupBy(*KEYS, "candidate_type", "candidate_kind").agg(*aggs)
    return _rollup(grouped)


def _rollup(g: DataFrame) -> DataFrame:
    """Family and role roll-up plus everything else that needs only the aggregate."""
    c = F.col
    fams = [f.lower() for f in dims.FAMILIES]
    present = F.array_sort(
        F.filter(
            F.array(*[F.when(c(f"cnt_{f.lower()}") > 0, F.lit(f)) for f in dims.FAMILIES]),
            lambda v: v.isNotNull(),
        )
    )
    n_support = sum(F.when(c(f"sup_{f}") > 0, 1).otherwise(0) for f in fams)
    redundancy = sum(F.greatest(F.lit(0), c(f"cnt_{f}") - 1) for f in fams) * 0.08
    clusters = F.array_distinct("_clusters")
    same_work = F.coalesce(
        F.array_max(
            F.transform(clusters, lambda d: F.size(F.filter("_clusters", lambda x: x == d)))
        ),
        F.lit(0),
    )
    sv_set = F.array_distinct("_sv_countries")
    sv_home = F.when(F.array_contains(sv_set, dims.HOME_COUNTRY), 1).otherwise(0)
    domains = F.array(*[F.lit(d) for d in dims.DOMAINS])
    df = g.withColumns({
        "source_families": present,
        "support_families": n_support,
        "discovery_rise": c("role_discovery"),
        "broad_confirmation": c("role_confirmation"),
        "editorial_support": c("role_editorial"),
        "commerce_support": c("role_commerce"),
        "music_confirmation": c("fam_music_chart"),
        "show_confirmation": c("fam_show_chart"),
        "has_discovery": F.when(c("n_discovery") > 0, 1.0).otherwise(0.0),
        "redundancy_penalty": redundancy,
        "regional_overlap": F.least(
            F.lit(1.0),
            (F.size(F.array_distinct("_countries")) + F.size(F.array_distinct("_regions"))) / 4.0,
        ),
        "regional_priority": F.when(c("asia_priority"), 1.0).otherwise(0.0),
        "short_video_priority": F.when(c("short_video_flag"), 1.0).otherwise(0.0),
        "same_work_relation_count": same_work,
        "distinct_work_clusters": F.size(clusters),
        "work_cluster_id": F.coalesce("work_cluster_id", F.lit("")),
        "sv_primary_home": F.coalesce("sv_home", F.lit(False)),
        "sv_country_count": F.size(sv_set),
        "sv_other_country_count": F.size(sv_set) - sv_home,
        "sv_region_score": F.round(F.coalesce("region_score", F.lit(0.0)), 4),
        "sv_surface_count": F.size("_sv_surfaces"),
        "sv_priority_score": F.round("priority_score", 4),
        "best_surface": F.coalesce("best_surface", F.lit("")),
        "direct_support_total": F.round("direct_raw", 4),
        "direct_confirmation_support": F.round("direct_confirm_raw", 4),
        "feature_domain": F.element_at(domains, (c("domain_pack") % _RADIX + 1).cast("int")),
    })
    few = c("source_count") <= 1
    df = df.withColumns({
        "family_count": F.size("source_families"),
        "cross_family_confirm": F.log1p(c("support_families").cast("double")),
        "has_confirmation": F.when(c("support_families") > 0, 1.0).otherwise(0.0),
        "lead_lag_bonus": F.when(
            (c("n_discovery") > 0) & (c("support_families") > 0), 0.25
        ).otherwise(0.0),
        "dominant_work_ratio": F.when(
            c("derived_rows") > 0, F.round(c("same_work_relation_count") / c("derived_rows"), 4)
        ).otherwise(0.0),
        "locality": F.when((F.size("source_families") <= 1) & few, 1.0)
        .when(F.size("source_families") <= 1, 0.6)
        .when(c("source_count") <= 2, 0.35)
        .otherwise(0.1),
    })
    dropped = [x for x in df.columns if x.startswith("_")]
    return df.drop(*dropped, "region_score", "priority_score", "sv_home", "domain_pack")


def score_candidate_text(candidates: DataFrame, name: str = "display_name") -> DataFrame:
    """Text scores of every candidate, once per candidate rather than once per day."""
    named = {"topic_specificity": "specificity", "behavior_objectness": "objectness", "genericity": "genericity", "live_bias": "live_bias"}
    scored = candidates.withColumn("_scores", T.topic_scores_nf(F.col(name)))
    return scored.withColumns({c: F.col(f"_scores.{s}") for c, s in named.items()}).drop("_scores")


def with_backfill_state(aggregated: DataFrame) -> DataFrame:
    """State for replaying many days at once: the totals of up to 7 earlier days.

    A production day joins the stored state instead (:func:`with_candidate_state`),
    because the true history holds the scores of the days before.
    """
    families = [F.col(f"fam_{f.lower()}") for f in dims.FAMILIES]
    before = Window.partitionBy("candidate_id").orderBy("date").rowsBetween(-7, -1)
    df = aggregated.withColumn("day_total", N.balanced_sum(families))
    return df.withColumn("history", F.collect_list("day_total").over(before)).withColumn(
        "maturity",
        F.round(
            F.least(F.lit(1.5), F.coalesce(F.avg("day_total").over(before), F.lit(0.0))), 4
        ),
    )


def with_candidate_state(
    aggregated: DataFrame, candidates: DataFrame, state: DataFrame | None = None
) -> DataFrame:
    """Join candidate attributes (by id) and the stored state (by id, before the day).

    ``candidates``: candidate_id, display_name, domain_class and the text scores.
    ``state``: candidate_id, maturity, history; without it the columns must be there.
    """
    cand = candidates.select(
        "candidate_id", "display_name", F.col("domain_class").alias("own_domain"),
        "topic_specificity", "behavior_objectness", "genericity", "live_bias",
    )
    df = aggregated
    if state is not None:
        df = df.join(state.select("candidate_id", "maturity", "history"), "candidate_id", "left")
    df = df.join(cand, "candidate_id", "left")
    return (
        df.withColumn("maturity", F.coalesce("maturity", F.lit(0.0)))
        .withColumn("history", F.coalesce("history", F.array().cast("array<double>")))
        .withColumn("domain_class", F.coalesce("feature_domain", "own_domain", F.lit("OTHER")))
    )


def with_relation_support(df: DataFrame, support: DataFrame | None) -> DataFrame:
    if support is not None:
        df = df.join(support, list(KEYS), "left")
    known = support is not None
    return df.withColumns({
        n: F.round(F.coalesce(F.col(n) if known else F.lit(0.0), F.lit(0.0)), 4)
        for n in SUPPORT_COLUMNS
    })


def derive(df: DataFrame, availability: DataFrame | None = None) -> DataFrame:
    """Novelty, relevance, noise and penalty columns.

    ``availability`` has one row per date (``search_availability``); its size is the
    number of days, so the join broadcasts.
    """
    c = F.col
    if availability is None:
        df = df.withColumn("search_availability", F.lit(1.0))
    else:
        df = df.join(
            availability.select("date", "search_availability"), "date", "left"
        ).withColumn("search_availability", F.coalesce("search_availability", F.lit(1.0)))
    positives = F.filter("history", lambda x: x > 0)
    person = c("candidate_type").isin(*dims.PERSON_TYPES)
    capped = lambda raw, boost: F.round(
        F.least(F.lit(1.0), F.when(boost, F.least(F.lit(1.0), c(raw) * 1.1)).otherwise(c(raw))), 4
    )
    noise = (
        0.34 * c("locality") + 0.28 * c("genericity") + 0.22 * c("live_bias")
        + 0.12 * (1.0 - c("topic_specificity"))
        + F.when(c("candidate_type") == "BEHAVIOR", 0.14 * (1.0 - c("behavior_objectness"))).otherwise(0.0)
    )
    mass = c("music_confirmation") + c("show_confirmation")
    home = F.least(
        F.lit(1.0), c("home_sources") * 0.24 + F.least(c("asia_hits"), F.lit(4)) * 0.08
    ) + F.when(c("domain_class").isin("ENTERTAINMENT", "FASHION_BEAUTY"), 0.08).otherwise(0.0)
    df = df.withColumns({
        "positive_days": F.size(positives),
        "positive_sum": F.aggregate(positives, F.lit(0.0), lambda a, x: a + x),
        "maturity_penalty": c("maturity") * 0.6
        + F.when(c("has_discovery") > 0, 0.0).otherwise(0.25),
        "home_relevance": F.round(N.clamp(home, 0.0, 1.0), 4),
        "constrained_ent": capped("ent_raw", c("domain_class") == "ENTERTAINMENT"),
        "constrained_beauty": capped("beauty_raw", c("domain_class") == "FASHION_BEAUTY"),
        "realtime_support": F.round(F.least(F.lit(1.0), c("realtime_raw")), 4),
        "public_noise_penalty": F.when(c("candidate_kind") != "TOPIC", 0.05).otherwise(
            F.round(N.clamp(noise, 0.0, 1.0), 4)
        ),
        "mature_mass_only_penalty": F.when(
            (c("maturity") < 0.8) | (c("has_discovery") > 0) | (mass <= 0), 0.0
        ).otherwise(F.round(F.least(F.lit(1.0), 0.28 + c("maturity") * 0.35 + mass * 0.18), 4)),
        "relation_only_flag": person & (c("direct_raw") < 0.08) & (c("direct_rows") == 0)
        & ((c("relation_support_total") > 0) | (c("derived_rows") > 0)),
        "omnipresence_penalty": F.when(
            person,
            F.round(
                F.least(
                    F.lit(0.35),
                    F.greatest(F.lit(0), c("distinct_work_clusters") - 1) * 0.12
                    + F.greatest(F.lit(0.0), c("maturity") - 0.70) * 0.25,
                ),
                4,
            ),
        ).otherwise(0.0),
        "same_work_cluster_penalty": F.least(
            F.lit(1.0),
            F.greatest(F.lit(0), c("same_work_relation_count") - 1) * 0.5
            + c("dominant_work_ratio") * 0.35,
        ),
    })
    df = df.withColumns({
        "novelty": N.clamp(
            1.0 / (1.0 + F.log1p(c("positive_days") + c("maturity") * 5.0)), 0.0, 1.0
        ),
        "sustained_presence": F.when(
            c("positive_days") > 0,
            F.least(F.lit(1.0), c("positive_sum") / F.greatest(F.lit(1.0), c("positive_days") * 4.0)),
        ).otherwise(0.0),
        "constrained_support": F.greatest("constrained_ent", "constrained_beauty"),
        "home_credibility": F.greatest("constrained_ent", "constrained_beauty", "realtime_support"),
        "relation_only_penalty": F.when(c("relation_only_flag"), 1.0).otherwise(0.0),
    })
    return df.withColumn(
        "adjusted_credibility",
        F.round(c("home_credibility") / F.greatest(F.lit(0.5), c("search_availability")), 4),
    )


def roll_forward(state: DataFrame | None, features: DataFrame) -> DataFrame:
    """Candidate state after a day: 7-value score history and decayed maturity."""
    empty = F.array().cast("array<double>")
    new = features.select("candidate_id", "primary_score", "mass_heat", "source_families")
    if state is None:
        df = new.withColumn("maturity", F.lit(0.0)).withColumn("history", empty)
    else:
        df = new.join(state.select("candidate_id", "maturity", "history"), "candidate_id", "left")
    grown = F.concat(F.coalesce("history", empty), F.array("primary_score"))
    kept = F.when(F.size(grown) > 7, F.slice(grown, -7, 7)).otherwise(grown)
    updated = df.select(
        "candidate_id",
        F.round(
            F.least(F.lit(1.5), F.coalesce("maturity", F.lit(0.0)) * 0.6 + F.col("mass_heat") * 0.4), 4
        ).alias("maturity"),
        kept.alias("history"),
        "source_families",
    )
    if state is None:
        return updated
    untouched = state.join(new.select("candidate_id"), "candidate_id", "left_anti")
    return untouched.select(*updated.columns).unionByName(updated)


def propagate_relations(source_features: DataFrame, relations: DataFrame) -> DataFrame:
    """Relation support per (date, destination candidate).

    The destination sums keep partial aggregation, so a destination that many edges
    point at shrinks before the shuffle. Terms are never negative, so clamping the
    sum equals clamping every step.
    """
    s = F.col("surprise01")
    base = source_features.groupBy(*KEYS).agg(
        F.max(s).alias("base_signal"),
        F.max(F.col("source_id").isin(*dims.STREAM_SOURCES)).alias("via_stream"),
        F.max(F.col("source_id").isin(*dims.CATCHUP_SOURCES)).alias("via_catchup"),
        F.max(F.col("source_role") == "CONFIRMATION").alias("confirmed"),
    ).where(F.col("base_signal") > 0)
    weight = N.by_key(
        F.col("relation_type"), dims.RELATION_WEIGHTS, dims.RELATION_WEIGHTS["associated_with_work"]
    )
    edges = relations.where(F.col("relation_type").isin(*dims.PROPAGATING_RELATIONS)).select(
        F.col("src_id").alias("candidate_id"), "dst_id", "relation_type",
        (weight * F.greatest(F.lit(0.25), F.col("confidence"))).alias("edge_weight"),
    )
    p = base.join(edges, "candidate_id").withColumn(
        "propagated", F.least(F.lit(1.0), F.col("base_signal") * F.col("edge_weight"))
    )
    v, stream, kind = F.col("propagated"), F.col("via_stream"), F.col("relation_type")
    cast_kinds = ("features_in", "voice_acts_in", "appears_in_reality_show")
    cap = lambda e: F.least(F.lit(1.0), F.coalesce(F.sum(e), F.lit(0.0)))
    return p.groupBy("date", F.col("dst_id").alias("candidate_id")).agg(
        cap(v).alias("relation_support_total"),
        cap(F.when(F.col("confirmed"), v)).alias("relation_confirmed_support"),
        cap(F.when(F.col("via_catchup"), v * 0.8)).alias("catchup_relation_support"),
        cap(F.when(stream, v)).alias("stream_relation_support_show"),
        cap(F.when(stream & (kind == "theme_song_of"), v)).alias("stream_relation_support_music"),
        cap(F.when(stream & kind.isin(*cast_kinds), v)).alias("stream_relation_support_people"),
    )
