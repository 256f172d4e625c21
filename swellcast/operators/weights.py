"""Source weights: prior x calibrated (predictive power, independence)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.dims import AlgorithmConfig, WeightingConfig

# ``records``: one row per (date, source_id) with ``ok``.
# ``top``: exploded snapshots, (date, source_id, candidate_id, momentum), at most
# ``top_m`` rows per (date, source).


def weighted_sources(df: DataFrame) -> DataFrame:
    """Drop sources that never contribute to a score."""
    return df.where(~F.col("source_id").isin(*dims.UNWEIGHTED_SOURCES) & (F.col("source_id") != ""))


def source_settings(config: DataFrame, cfg: WeightingConfig | None = None) -> DataFrame:
    """Per-source settings with their inferred defaults.

    ``config``: source_id and nullable region_weight, lag_days, granularity,
    fetch_limit, top_m.
    """
    cfg = cfg or WeightingConfig()
    c, sid = F.col, F.col("source_id")
    region = F.when(sid == "APPLE_MUSIC_KR", 0.85).when(sid == "APPLE_MUSIC_GLOBAL", 0.1).otherwise(1.0)
    lag = F.when(sid.startswith("NETFLIX_"), 3.5).when(sid == "YOUTUBE_TREND_JP", 0.25).otherwise(0.5)
    # greatest() skips NULLs, so absent settings are tested first.
    at_least_one = lambda name: F.when(
        c(name).isNotNull(), F.greatest(c(name), F.lit(1))
    )
    limit = F.when(F.coalesce("fetch_limit", F.lit(0)) != 0, at_least_one("fetch_limit"))
    df = config.select(
        "source_id",
        F.coalesce("region_weight", region).alias("region_weight"),
        F.coalesce("lag_days", lag).alias("lag_days"),
        F.coalesce(at_least_one("granularity"), limit, F.lit(max(cfg.n_ref, 1))).alias("granularity"),
        at_least_one("top_m").alias("top_m"),
    )
    default_m = F.least(F.lit(cfg.top_m_default), c("granularity"))
    return df.withColumn("top_m", F.coalesce("top_m", default_m))


def largest_top_m(settings: DataFrame) -> int:
    """The largest M of the settings table, which has one row per catalogued source."""
    return int(settings.agg(F.max("top_m")).first()[0] or 0)


def top_per_source(source_features: DataFrame, settings: DataFrame) -> DataFrame:
    """Daily top-M of each source by positive momentum.

    The largest M of all sources stands in the rank filter as a literal, so every task cuts its
    part of a hot (day, source) before the shuffle; each source's own M applies after it.
    """
    ranked = source_features.where(F.col("momentum") > 0).select(
        "date", "source_id", "candidate_id", "momentum"
    )
    limits = settings.select("source_id", "top_m")
    w = Window.partitionBy("date", "source_id").orderBy(F.desc("momentum"), "candidate_id")
    return (
        ranked.withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= largest_top_m(settings))
        .join(limits, "source_id")
        .where(F.col("position") <= F.col("top_m"))
        .drop("top_m")
    )


def prior_weights(
    settings: DataFrame, algo: AlgorithmConfig | None = None, cfg: WeightingConfig | None = None
) -> DataFrame:
    """Region x freshness x granularity per source."""
    algo, cfg = algo or AlgorithmConfig(), cfg or WeightingConfig()
    c = F.col
    df = weighted_sources(settings).select(
        "source_id", "lag_days", "granularity",
        c("region_weight").cast("double").alias("R"),
        F.pow(F.lit(2.0), -c("lag_days") / algo.half_life_days).alias("F"),
        F.least(
            F.lit(1.0), F.log1p(c("granularity").cast("double")) / math.log1p(max(cfg.n_ref, 1))
        ).alias("G"),
    )
    return df.withColumn("prior", c("R") * c("F") * c("G"))


def normalize_mean_one(df: DataFrame, column: str, out: str) -> DataFrame:
    """Rescale so the mean is 1 (all ones when the total is not positive).

    The frame has one row per source, so the total is a scalar of a tiny aggregate.
    """
    totals = df.agg(F.struct(F.sum(column).alias("s"), F.count("*").alias("n")).alias("t")).scalar()
    return df.withColumn("_t", totals).withColumn(
        out,
        F.when(F.col("_t.s") <= 0, 1.0).otherwise(F.col("_t.n") * F.col(column) / F.col("_t.s")),
    ).drop("_t")


def _bounds(as_of: Column, cfg: WeightingConfig) -> tuple[Column, Column, Column]:
    recent = F.date_sub(as_of, max(cfg.window_days - 1, 0))
    start = F.date_sub(as_of, max(cfg.window_days + cfg.horizon_days - 1, 0))
    return recent, start, F.date_sub(as_of, cfg.horizon_days)


def _newest(records: DataFrame) -> Column:
    return records.agg(F.max("date")).scalar()


def predictive_f1(
    records: DataFrame, top: DataFrame, priors: DataFrame, cfg: WeightingConfig | None = None
) -> DataFrame:
    """How well a source's picks foretell the other sources' top K one horizon later.

    Leave-one-out totals are the day's totals minus the source's own share. Removing a
    source lowers only its own candidates, so with at most M of them the top K without
    it lies inside the day's top K + M: the join on the day stays that small. Both ranks
    compare scores to 9 digits, since the order of a sum decides the digits after them.
    """
    cfg = cfg or WeightingConfig()
    c = F.col
    as_of = _newest(records)
    _, start, end = _bounds(as_of, cfg)
    ok = records.where("ok").select("date", "source_id")
    items = top.join(ok, ["date", "source_id"])
    anchors = items.where((c("date") >= start) & (c("date") <= end)).select(
        "source_id", "candidate_id", F.date_add("date", cfg.horizon_days).alias("date")
    )
    contributions = items.join(priors.select("source_id", "prior"), "source_id", "left").select(
        "date", "source_id", "candidate_id",
        (F.coalesce("prior", F.lit(1.0)) * c("momentum")).alias("share"),
    )
    # No source has more picks on a day than the largest M, so a literal cuts each day's totals before the shuffle.
    most = int(contributions.groupBy("date", "source_id").count().agg(F.max("count")).first()[0] or 0)
    totals = contributions.groupBy("date", "candidate_id").agg(
        F.sum("share").alias("total"), F.count("*").alias("contributors")
    )
    w = Window.partitionBy("date").orderBy(F.round("total", 9).desc(), "candidate_id")
    head = (
        totals.withColumn("_rn", F.row_number().over(w))
        .where(c("_rn") <= most + cfg.top_k_for_future)
        .drop("_rn")
    )
    sources = anchors.select("date", "source_id").distinct()
    loo = (
        sources.join(head, "date")
        .join(contributions, ["date", "source_id", "candidate_id"], "left")
        .withColumn("others", c("contributors") - F.when(c("share").isNull(), 0).otherwise(1))
        .where(c("others") > 0)
        .withColumn("score", c("total") - F.coalesce("share", F.lit(0.0)))
    )
    lw = Window.partitionBy("date", "source_id").orderBy(F.round("score", 9).desc(), "candidate_id")
    future = loo.withColumn("_rn", F.row_number().over(lw)).where(
        c("_rn") <= cfg.top_k_for_future
    ).select("date", "source_id", "candidate_id")
    sizes = anchors.groupBy("date", "source_id").agg(F.count("*").alias("anchor_size"))
    future_sizes = future.groupBy("date", "source_id").agg(F.count("*").alias("future_size"))
    hits = anchors.join(future, ["date", "source_id", "candidate_id"], "left_semi").groupBy(
        "date", "source_id"
    ).agg(F.count("*").alias("overlap"))
    days = sizes.join(future_sizes, ["date", "source_id"]).join(
        hits, ["date", "source_id"], "left"
    ).fillna(0, ["overlap"])
    f1 = days.groupBy("source_id").agg(
        F.avg(c("overlap") / c("anchor_size")).alias("precision"),
        F.avg(c("overlap") / c("future_size")).alias("recall"),
        F.count("*").alias("evaluated_days"),
    )
    return f1.withColumn(
        "predictive",
        2.0 * c("precision") * c("recall") / (c("precision") + c("recall") + cfg.epsilon),
    )


def independence(
    records: DataFrame, top: DataFrame, cfg: WeightingConfig | None = None
) -> DataFrame:
    """One minus the mean daily overlap (Jaccard) with the other sources.

    Pairs without overlap add nothing to the sum, so only co-occurring pairs are
    joined and the mean divides by the number of other sources of the day.
    """
    cfg = cfg or WeightingConfig()
    c = F.col
    as_of = _newest(records)
    recent, _, _ = _bounds(as_of, cfg)
    ok = records.where(c("ok") & (c("date") >= recent) & (c("date") <= as_of)).select("date", "source_id")
    items = top.select("date", "source_id", "candidate_id").join(ok, ["date", "source_id"])
    sizes = items.groupBy("date", "source_id").agg(F.count("*").alias("n"))
    day = sizes.groupBy("date").agg(F.count("*").alias("day_sources"))
    # A candidate's source list is no longer than the catalog.
    lists = items.groupBy("date", "candidate_id").agg(F.collect_set("source_id").alias("s"))
    pairs = (
        lists.where(F.size("s") > 1)
        .select("date", "s", F.explode("s").alias("source_id"))
        .select("date", "source_id", F.explode("s").alias("other"))
        .where(c("source_id") != c("other"))
        .groupBy("date", "source_id", "other")
        .agg(F.count("*").alias("both"))
    )
    jac = (
        pairs.join(sizes, ["date", "source_id"])
        .join(sizes.select("date", c("source_id").alias("other"), c("n").alias("m")), ["date", "other"])
        .groupBy("date", "source_id")
        .agg(F.sum(c("both") / (c("n") + c("m") - c("both"))).alias("jaccard_sum"))
    )
    daily = (
        sizes.join(day, "date").where(c("day_sources") > 1)
        .join(jac, ["date", "source_id"], "left")
        .withColumn("overlap", F.coalesce("jaccard_sum", F.lit(0.0)) / (c("day_sources") - 1))
    )
    return daily.groupBy("source_id").agg(F.avg("overlap").alias("redundancy")).withColumn(
        "independence", F.greatest(F.lit(cfg.i_min), 1.0 - c("redundancy"))
    )


def stability(records: DataFrame, cfg: WeightingConfig | None = None) -> DataFrame:
    cfg = cfg or WeightingConfig()
    as_of = _newest(records)
    recent, _, _ = _bounds(as_of, cfg)
    rows = records.where((F.col("date") >= recent) & (F.col("date") <= as_of))
    fail = F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0))
    return rows.groupBy("source_id").agg(
        F.greatest(F.lit(cfg.s_min), 1.0 - fail).alias("stability"), F.count("*").alias("days")
    )


def stability_history(records: DataFrame, every: int, cfg: WeightingConfig | None = None) -> DataFrame:
    """(date, source_id, weight): every ``every`` days the stability of each source at that day, scaled to mean 1.

    A record counts for the snapshots of the days of one window after it, so no day is compared with all others.
    """
    cfg = cfg or WeightingConfig()
    number = lambda c: F.datediff(c, F.lit("1970-01-01"))
    days = records.select(F.col("date").alias("_day")).distinct().where(number(F.col("_day")) % every == 0)
    reach = F.filter(F.sequence("date", F.date_add("date", cfg.window_days - 1)), lambda d: number(d) % every == 0)
    fail = F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0))
    stable = records.select("source_id", "ok", F.explode(reach).alias("_day")).join(days, "_day").groupBy("_day", "source_id").agg(
        F.greatest(F.lit(cfg.s_min), 1.0 - fail).alias("stability"))
    by_day = Window.partitionBy("_day")
    return stable.select(
        F.col("_day").alias("date"), "source_id",
        (F.col("stability") * F.count("*").over(by_day) / F.sum("stability").over(by_day)).alias("weight"))


def weight_snapshot(
    records: DataFrame,
    top: DataFrame,
    settings: DataFrame,
    algo: AlgorithmConfig | None = None,
    cfg: WeightingConfig | None = None,
) -> DataFrame:
    """All factors and the final weight per source (stability is reported only)."""
    cfg = cfg or WeightingConfig()
    pri = prior_weights(settings, algo, cfg)
    df = pri
    for side, col in (
        (predictive_f1(records, top, pri, cfg), "predictive"),
        (independence(records, top, cfg), "independence"),
        (stability(records, cfg), "stability"),
    ):
        df = df.join(side.select("source_id", col), "source_id", "left")
        df = df.withColumn(col, F.coalesce(col, F.lit(1.0)))
    df = df.withColumn("_raw", F.col("predictive") * F.col("independence"))
    df = normalize_mean_one(df, "_raw", "calibration")
    df = df.withColumn("_w", F.col("prior") * F.col("calibration"))
    return normalize_mean_one(df, "_w", "weight").drop("_raw", "_w")


def current_weights(
    settings: DataFrame,
    stored: DataFrame | None = None,
    snapshot: DataFrame | None = None,
    algo: AlgorithmConfig | None = None,
    cfg: WeightingConfig | None = None,
) -> DataFrame:
    """Weights for the next run: stored ones, else recomputed, else prior only."""
    cfg = cfg or WeightingConfig()
    pri = normalize_mean_one(prior_weights(settings, algo, cfg), "prior", "prior_weight").select(
        "source_id", "prior_weight"
    )
    if not cfg.enabled:
        return pri.select("source_id", F.lit(1.0).alias("weight"))
    if stored is not None:
        merged = pri.join(stored.select("source_id", F.col("weight").alias("_s")), "source_id", "left")
        merged = merged.withColumn("_w", F.coalesce("_s", "prior_weight"))
        return normalize_mean_one(merged, "_w", "weight").select("source_id", "weight")
    if snapshot is not None:
        return snapshot.select("source_id", "weight")
    return pri.select("source_id", F.col("prior_weight").alias("weight"))
