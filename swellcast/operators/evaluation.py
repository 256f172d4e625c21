"""Ranking quality against hindsight labels, per (date, variant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swellcast import dims

KEYS = ("date", "variant")
ENTRY_COLUMNS = (
    "candidate_id", "candidate_type", "lane", "source_families", "maturity", "breakout_prob_1d",
    "breakout_prob_3d", "breakout_prob_7d", "mass_prob", "cross_family_confirm", "novelty",
    "primary_score", "has_anchor",
)


def entries_from_features(features: DataFrame, variant: str) -> DataFrame:
    """Entries of a replayed ranking; mass heat stands in for maturity."""
    df = features.withColumn("maturity", F.col("mass_heat")).withColumn("has_anchor", F.lit(True))
    return df.select("date", F.lit(variant).alias("variant"), *ENTRY_COLUMNS)


def entries_from_items(items: DataFrame, features: DataFrame, variant: str) -> DataFrame:
    """Entries of a stored ranking, completed from the features of the same day."""
    names = (
        "candidate_type", "lane", "source_families", "mass_heat", "breakout_prob_1d",
        "breakout_prob_3d", "breakout_prob_7d", "mass_prob", "cross_family_confirm", "novelty",
        "primary_score",
    )
    f = features.select("date", "candidate_id", *[F.col(n).alias(f"f_{n}") for n in names])
    df = items.join(f, ["date", "candidate_id"], "left")
    known = F.col("f_candidate_type").isNotNull()
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    nonzero = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.col(c))
    zero = F.lit(0.0)
    return df.select(
        "date", F.lit(variant).alias("variant"), "rank", "candidate_id",
        F.coalesce(text("candidate_type"), "f_candidate_type").alias("candidate_type"),
        F.coalesce(text("lane"), "f_lane", F.lit("shadow")).alias("lane"),
        F.when(F.size("source_families") > 0, F.col("source_families"))
        .otherwise(F.coalesce("f_source_families", F.array().cast("array<string>"))).alias("source_families"),
        F.coalesce("maturity", "f_mass_heat", zero).alias("maturity"),
        *[
            F.coalesce(f"f_{n}", zero).alias(n)
            for n in ("breakout_prob_1d", "breakout_prob_3d", "breakout_prob_7d", "mass_prob",
                      "cross_family_confirm", "novelty")
        ],
        F.coalesce(nonzero("primary_score"), nonzero("f_primary_score"), zero).alias("primary_score"),
        known.alias("has_anchor"),
    )


def rank_entries(entries: DataFrame, k: int) -> DataFrame:
    """Top K per (date, variant); a stored rank is kept, else primary score decides."""
    if "rank" in entries.columns:
        return entries.where(F.col("rank") <= k)
    w = Window.partitionBy(*KEYS).orderBy(F.desc("primary_score"), "candidate_id")
    return entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_outcomes(entries: DataFrame, labels: DataFrame) -> DataFrame:
    lab = labels.select(
        "date", "candidate_id", "breakout_1d", "breakout_3d", "breakout_7d", "breakout_14d",
        "mass_7d", "lead_days", "new_families_7d", "new_families_14d", "new_confirmation_families",
        "breakout_horizons", "mass_horizons", F.lit(True).alias("labelled"),
    )
    return entries.join(lab, ["date", "candidate_id"], "left")


def spread(horizon: int) -> Column:
    """New confirming families within the horizon, with the label-only fallback."""
    listed = F.coalesce(F.size("new_confirmation_families"), F.lit(0))
    in_time = F.col("lead_days").isNotNull() & (F.col("lead_days") <= horizon)
    fallback = listed if horizon >= 14 else F.when(in_time, F.greatest(F.lit(1), listed)).otherwise(0)
    exact = F.coalesce(F.col(f"new_families_{horizon}d"), F.lit(0))
    return (
        F.when(F.col("has_anchor"), exact).when(F.col("labelled"), fallback).otherwise(F.lit(0))
    )


def relevance(horizon: int = 7) -> Column:
    hit = F.when(F.coalesce(F.col(f"breakout_{horizon}d"), F.lit(False)), 1.0).otherwise(0.0)
    in_time = (F.col("lead_days").isNotNull() & (F.col("lead_days") <= horizon)).cast("int")
    listed = F.coalesce(F.size("new_confirmation_families"), F.lit(0))
    fallback = listed if horizon >= 14 else in_time
    exact = F.coalesce(F.col(f"new_families_{horizon}d"), F.lit(0))
    found = (
        F.when(F.col("has_anchor"), exact).when(F.col("labelled"), fallback).otherwise(F.lit(0))
    )
    mature = F.when(
        F.col("candidate_type").isin(*dims.MATURE_TYPES), F.col("maturity") * 0.35
    ).otherwise(0.0)
    return F.greatest(
        F.lit(0.0), hit + F.least(found, F.lit(3)) * 0.25 + F.col("novelty") * 0.15 - mature
    )


def ndcg(top: DataFrame, horizon: int = 7) -> DataFrame:
    """Novelty-adjusted nDCG of the ranked top rows (with outcomes)."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("rel"), "candidate_id")
    df = top.withColumn("rel", relevance(horizon)).withColumn("_ideal", F.row_number().over(w))
    gain = lambda pos: F.sum(F.col("rel") / F.log2(F.col(pos) + 1.0))
    return df.groupBy(*KEYS).agg(gain("rank").alias("dcg"), gain("_ideal").alias("idcg")).select(
        *KEYS,
        F.when(F.col("idcg") <= 0, 0.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg_7d"),
    )


def _share(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def list_metrics(top: DataFrame) -> DataFrame:
    """Precision, spread, lead, lanes, diversity and maturity over the top rows."""
    c = F.col
    aggs: list[Column] = [F.count("*").alias("listed")]
    for h in (1, 3, 7, 14):
        known = F.coalesce(F.array_contains("breakout_horizons", h), F.lit(False))
        hit = F.when(known, c(f"breakout_{h}d").cast("double"))
        aggs.append(F.coalesce(F.avg(hit), F.lit(0.0)).alias(f"breakout_precision_{h}d"))
        aggs.append(F.count(hit).alias(f"breakout_evaluated_{h}d"))
    for h in (7, 14):
        aggs.append(F.avg(spread(h).cast("double")).alias(f"future_spread_{h}d"))
    aggs += [
        F.coalesce(F.avg(c("lead_days").cast("double")), F.lit(0.0)).alias("lead_gain"),
        (F.count("lead_days") / F.count("*")).alias("lead_coverage"),
        F.count("lead_days").alias("lead_count"),
        *[F.count(F.when(c("lane") == lane, 1)).alias(f"lane_{lane}") for lane in dims.TARGET_LANES],
        (F.countDistinct("candidate_type") / F.count("*")).alias("type_diversity"),
        _share(c("candidate_type").isin(*dims.MATURE_TYPES) & (c("maturity") >= 0.8)).alias(
            "mature_people_music_ratio"
        ),
    ]
    df = top.groupBy(*KEYS).agg(*aggs)
    covered = sum(F.when(c(f"lane_{lane}") > 0, 1).otherwise(0) for lane in dims.TARGET_LANES)
    return df.withColumn("lane_coverage", covered / float(len(dims.TARGET_LANES)))


def probability_pairs(entries: DataFrame, kind: str) -> DataFrame:
    """(probability, outcome) of every labelled entry, not only the top K."""
    prob, outcome, horizons = (
        ("breakout_prob_7d", "breakout_7d", "breakout_horizons")
        if kind == "breakout" else ("mass_prob", "mass_7d", "mass_horizons")
    )
    known = F.coalesce(F.array_contains(horizons, 7), F.lit(False))
    return entries.where(known).select(
        *KEYS, F.col(prob).alias("p"), F.col(outcome).cast("double").alias("y")
    )


def brier(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.groupBy(*KEYS).agg(
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias(f"{name}_brier"),
        F.count("*").alias(f"{name}_count"),
    )


def reliability(pairs: DataFrame, bins: int = 5) -> DataFrame:
    """Equal-width reliability bins; empty bins appear with zeros."""
    b = F.least(F.floor(F.greatest(F.col("p"), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counted = pairs.withColumn("bin", b).groupBy(*KEYS, "bin").agg(
        F.count("*").alias("n"), F.avg("p").alias("avg_pred"), F.avg("y").alias("avg_outcome")
    )
    frame = counted.select(*KEYS).distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    zero = F.lit(0.0)
    return frame.join(counted, [*KEYS, "bin"], "left").select(
        *KEYS, "bin",
        F.round(F.col("bin") / float(bins), 4).alias("lower"),
        F.round((F.col("bin") + 1) / float(bins), 4).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.round(F.coalesce("avg_pred", zero), 4).alias("avg_pred"),
        F.round(F.coalesce("avg_outcome", zero), 4).alias("avg_outcome"),
    )


def evaluate(entries: DataFrame, labels: DataFrame, k: int = 20) -> DataFrame:
    """One metric row per (date, variant)."""
    everything = with_outcomes(entries, labels)
    top = with_outcomes(rank_entries(entries, k), labels)
    keys = list(KEYS)
    sizes = entries.groupBy(*KEYS).agg(F.count("*").alias("item_count"))
    df = sizes.join(list_metrics(top), keys).join(ndcg(top), keys)
    for kind in ("breakout", "mass"):
        df = df.join(brier(probability_pairs(everything, kind), kind), keys, "left").fillna(
            0, [f"{kind}_brier", f"{kind}_count"]
        )
    rounded = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, 4) for n in rounded})


COMPARED = ("breakout_precision_7d", "future_spread_7d", "mature_people_music_ratio", "lane_coverage")


def compare(metrics: DataFrame, shadow: str = "shadow_v2", public: str = "public_main") -> DataFrame:
    """Metric deltas between the two variants of a day, with the mirrored sign."""
    pick = lambda v, n: F.max(F.when(F.col("variant") == v, F.col(n)))
    both = metrics.groupBy("date").agg(
        *[F.round(pick(shadow, n) - pick(public, n), 4).alias(n) for n in COMPARED],
        F.countDistinct("variant").alias("_v"),
    ).where(F.col("_v") == 2)
    side = lambda v, sign: both.select(
        "date", F.lit(v).alias("variant"), *[(F.col(n) * sign).alias(f"{n}_delta") for n in COMPARED]
    )
    return side(shadow, 1.0).unionByName(side(public, -1.0))


def small_list_metrics(features: DataFrame, k: int = 20, threshold: float = 0.5) -> DataFrame:
    """Lead spread, family presence, type diversity over top K; novelty precision over all."""
    c = F.col
    w = Window.partitionBy("date").orderBy(F.desc("primary_score"), "candidate_id")
    top = features.withColumn("_rn", F.row_number().over(w)).where(c("_rn") <= k)
    listed = top.groupBy("date").agg(
        _share(c("cross_family_confirm") > 0).alias("lead_spread"),
        F.avg(F.size("source_families").cast("double")).alias("family_presence"),
        (F.countDistinct("candidate_type") / F.count("*")).alias("type_diversity"),
        *[F.count(F.when(c("lane") == lane, 1)).alias(f"lane_{lane}") for lane in dims.TARGET_LANES],
    )
    flagged = c("novelty") >= threshold
    precision = features.groupBy("date").agg(
        F.coalesce(
            F.avg(F.when(flagged, (c("primary_score") >= threshold).cast("double"))), F.lit(0.0)
        ).alias("novelty_precision")
    )
    return listed.join(precision, "date")
