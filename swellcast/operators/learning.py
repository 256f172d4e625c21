"""Source trust learned from hindsight labels (beta posteriors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.functions import numeric as N

BUCKET = ("source_id", "candidate_type", "source_role", "region_bucket")

# --- Fixed values: priors (reliability a/b, persistence a/b, region a/b, lead days, weight)
PRIOR_FIELDS = ("rel_a", "rel_b", "per_a", "per_b", "reg_a", "reg_b", "lead_days", "lead_weight")
PRIORS = {
    "CONFIRMATION": (6.0, 3.0, 5.0, 4.0, 4.0, 2.0, 1.0, 6.0),
    "EDITORIAL": (5.0, 4.0, 5.0, 4.0, 4.0, 3.0, 2.0, 5.0),
    "COMMERCE": (5.0, 5.0, 6.0, 4.0, 4.0, 3.0, 2.5, 5.0),
    "SOCIAL_DISCOVERY": (4.0, 4.0, 4.0, 5.0, 4.0, 3.0, 2.0, 6.0),
    "OTHER": (4.0, 5.0, 4.0, 5.0, 4.0, 3.0, 3.0, 5.0),
}


def region_bucket(source_id: Column, countries: Column, region: Column | None = None) -> Column:
    up = F.transform(countries, lambda c: F.upper(c))
    asia = F.array(*[F.lit(c) for c in dims.ASIA_COUNTRIES])
    code = F.lit("") if region is None else F.upper(F.coalesce(region, F.lit("")))
    return (
        F.when(F.array_contains(up, dims.HOME_COUNTRY), "JP")
        .when(F.arrays_overlap(up, asia), "ASIA")
        .when((code == "JP") | source_id.endswith("_JP"), "JP")
        .when(code.isin(*dims.ASIA_COUNTRIES) | source_id.endswith("_KR"), "ASIA")
        .when(source_id.endswith("_GLOBAL"), "GLOBAL")
        .otherwise("DEFAULT")
    )


def bucket_key() -> Column:
    return F.concat_ws("|", *BUCKET)


def _prior(name: str) -> Column:
    i = PRIOR_FIELDS.index(name)
    role, family = F.col("source_role"), F.col("family_primary")
    return (
        F.when(role == "CONFIRMATION", PRIORS["CONFIRMATION"][i])
        .when(role == "EDITORIAL", PRIORS["EDITORIAL"][i])
        .when(role == "COMMERCE", PRIORS["COMMERCE"][i])
        .when(family == "SOCIAL_DISCOVERY", PRIORS["SOCIAL_DISCOVERY"][i])
        .otherwise(PRIORS["OTHER"][i])
    )


def multiplier(rel: Column, lead: Column, per: Column, region: Column) -> Column:
    base = 0.45 + 0.55 * rel + 0.12 * per + 0.1 * lead
    damped = F.when(region < 1.0, base * (0.85 + 0.15 * region)).otherwise(base)
    return N.clamp(damped, 0.65, 1.35)


def accumulate(source_features: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome counts per source and per bucket in one grouping-sets pass.

    A NULL bucket marks the source level. Counting aggregates combine map-side, so a
    source holding most rows is no hot spot.
    """
    c = F.col
    ready = labels.where(F.array_contains("breakout_horizons", 7)).select(
        "date", "candidate_id", "breakout_7d", "mass_now", "mass_7d", "home_confirm_3d",
        "public_confirm_7d", "trivial_noise_7d", "lead_days",
        F.array_contains("mass_horizons", 7).alias("persistence_known"),
    )
    topic = c("candidate_kind") == "TOPIC"
    confirmed = c("home_confirm_3d") | c("public_confirm_7d")
    rows = source_features.join(ready, ["date", "candidate_id"]).select(
        "source_id", "candidate_type", "source_role", "family_primary",
        region_bucket(c("source_id"), c("countries")).alias("region_bucket"),
        (c("breakout_7d") | c("mass_now")).alias("pos"),
        (c("public_confirm_7d") | c("home_confirm_3d")).alias("pub"),
        topic.alias("topic"),
        (topic & ~c("trivial_noise_7d") & (confirmed | c("breakout_7d"))).alias("topic_pos"),
        "persistence_known",
        (c("persistence_known") & c("mass_7d")).alias("persistent"),
        "lead_days",
    )
    count_if = lambda cond: F.count(F.when(cond, 1))
    away = c("region_bucket") != "JP"
    base = [c("source_id"), c("source_role"), c("family_primary")]
    bucket = [c("candidate_type"), c("bucket_region")]
    rows = rows.withColumn("bucket_region", c("region_bucket"))
    return rows.groupingSets([base, base + bucket], *base, *bucket).agg(
        F.count("*").alias("observations"),
        count_if(c("pos")).alias("positives"),
        count_if(~c("pos")).alias("negatives"),
        count_if(c("pub")).alias("public_pos"),
        count_if(c("topic")).alias("topic_total"),
        count_if(c("topic_pos")).alias("topic_pos"),
        count_if(c("persistence_known")).alias("persistence_total"),
        count_if(c("persistent")).alias("persistence_pos"),
        count_if(away).alias("region_total"),
        count_if(away & c("pos")).alias("region_pos"),
        F.coalesce(F.sum("lead_days"), F.lit(0)).alias("lead_sum"),
        F.count("lead_days").alias("lead_count"),
    ).withColumnRenamed("bucket_region", "region_bucket")


def posteriors(counts: DataFrame) -> DataFrame:
    """Posterior means from the counts; one row per source and per bucket."""
    c, p = F.col, _prior
    rate = lambda a, b, pos, n: (p(a) + c(pos)) / (p(a) + p(b) + c(n))
    at_home = c("region_bucket").isNotNull() & (c("region_bucket") == "JP")
    df = (
        counts.withColumn("reliability", rate("rel_a", "rel_b", "positives", "observations"))
        .withColumn("persistence", rate("per_a", "per_b", "persistence_pos", "persistence_total"))
        .withColumn("public_precision", rate("rel_a", "rel_b", "public_pos", "observations"))
        .withColumn("topic_precision", rate("rel_a", "rel_b", "topic_pos", "topic_total"))
        .withColumn(
            "region_fit",
            F.when(at_home, 1.0).otherwise(rate("reg_a", "reg_b", "region_pos", "region_total")),
        )
        .withColumn(
            "mean_lead_days",
            (p("lead_days") * p("lead_weight") + c("lead_sum")) / (p("lead_weight") + c("lead_count")),
        )
    )
    df = df.withColumn("lead_score", 1.0 / (1.0 + F.greatest(F.lit(0.0), c("mean_lead_days"))))
    return df.withColumn(
        "multiplier", multiplier(c("reliability"), c("lead_score"), c("persistence"), c("region_fit"))
    )


def resolve_posteriors(rows: DataFrame, post: DataFrame) -> DataFrame:
    """Bucket value, else source value, else neutral, for every feature row.

    Both lookups have at most (sources x types x regions) rows; the runtime picks the
    join from their measured size.
    """
    names = ("reliability", "lead_score", "persistence", "region_fit")
    source = post.where("region_bucket IS NULL").select(
        "source_id", *[F.col(n).alias(f"s_{n}") for n in names]
    )
    bucket = post.where("region_bucket IS NOT NULL").select(
        *BUCKET, *[F.col(n).alias(f"b_{n}") for n in names]
    )
    df = rows.withColumn("region_bucket", region_bucket(F.col("source_id"), F.col("countries")))
    df = df.join(source, "source_id", "left").join(bucket, list(BUCKET), "left")
    neutral = {"reliability": 1.0, "lead_score": 0.0, "persistence": 0.0, "region_fit": 1.0}
    value = {n: F.coalesce(f"b_{n}", f"s_{n}", F.lit(neutral[n])) for n in names}
    known = F.col("s_reliability").isNotNull()
    df = (
        df.withColumn("posterior_bucket", bucket_key())
        .withColumn("posterior_reliability", value["reliability"])
        .withColumn("posterior_lead", value["lead_score"])
        .withColumn("posterior_persistence", value["persistence"])
        .withColumn("posterior_region_fit", value["region_fit"])
    )
    df = df.withColumn(
        "posterior_multiplier",
        F.when(
            known,
            multiplier(
                F.col("posterior_reliability"), F.col("posterior_lead"),
                F.col("posterior_persistence"), F.col("posterior_region_fit"),
            ),
        ).otherwise(1.0),
    )
    return df.drop(*[f"{p}_{n}" for p in "sb" for n in names])
