"""Source health, publication checks, roll-out readiness and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.dims import AppConfig

# --- Fixed values -----------------------------------------------------------------------
CORE_HEALTHY_MIN = 6
DISCOVERY_FAMILY_MIN = 2
CONFIRMATION_FAMILY_MIN = 2
ROLLOUT_WORDS_MIN = 3
WRITE_OPS_MAX = 5000


def failure_class(ok: Column, raw: Column, kept: Column, error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    any_in = lambda *words: low.rlike("|".join(words))
    return (
        F.when(any_in("403", "forbidden"), "blocked")
        .when(any_in("404", "not found"), "endpoint_missing")
        .when(any_in("timeout", "timed out"), "timeout")
        .when(any_in("400"), "bad_request")
        .when(any_in("disabled"), "disabled")
        .when(any_in("kill_switch"), "kill_switch")
        .when(any_in("extract:"), "extract_failed")
        .when(any_in("signal:"), "signal_failed")
        .when(low != "", "fetch_failed")
        .when(~ok, "unavailable")
        .when(raw <= 0, "empty_source")
        .when(kept <= 0, "zero_kept")
        .otherwise("healthy")
    )


def health_records(run_log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Run log rows with tier, failure class and the typed fetch metadata.

    ``run_log``: date, source_id, ok, item_count, kept_count, error, response_ms and
    ``metadata`` (map of strings).
    """
    meta = lambda k: F.coalesce(F.element_at("metadata", k), F.lit(""))
    number = lambda k: F.element_at("metadata", k).try_cast("int")
    dim = catalog.select("source_id", "availability_tier")
    return run_log.join(F.broadcast(dim), "source_id", "left").select(
        "date", "source_id", "ok", "item_count", "kept_count", F.coalesce("error", F.lit("")).alias("error"),
        failure_class(F.col("ok"), F.col("item_count"), F.col("kept_count"), F.col("error")).alias("failure_class"),
        F.coalesce("availability_tier", F.lit("")).alias("availability_tier"),
        meta("fallbackUsed").alias("fallback_used"),
        "response_ms",
        number("httpStatus").alias("http_status"),
        meta("errorType").alias("error_type"),
        number("responseBytes").alias("response_bytes"),
        meta("bodyHash").alias("body_hash"),
        meta("bodyExcerpt").alias("body_excerpt"),
        number("parseRawCount").alias("parse_raw_count"),
        F.lower(meta("isSoftFail")).isin("true", "1").alias("is_soft_fail"),
        F.map_filter(
            "metadata",
            lambda k, v: ~k.isin("fallbackUsed", "httpStatus", "errorType", "responseBytes",
                                 "bodyHash", "bodyExcerpt", "parseRawCount", "isSoftFail"),
        ).alias("metadata"),
    )


def availability(run_log: DataFrame, plan: DataFrame) -> DataFrame:
    """Per date: which planned families and source groups delivered items.

    ``plan`` is the enabled source plan (one row per source). A group nobody planned
    counts as fully available.
    """
    c = F.col
    days = run_log.select("date").distinct()
    log = run_log.groupBy("date", "source_id").agg(
        F.max("ok").alias("ok"), F.max("item_count").alias("item_count")
    )
    live = log.where(c("ok") & (c("item_count") > 0)).select(
        "date", "source_id", F.lit(True).alias("live")
    )
    # Every planned source on every run day: (days) x (catalog) rows.
    planned = plan.where("enabled").agg(
        F.collect_list(
            F.struct(
                "source_id", "role", F.col("family_primary").alias("family"),
                F.col("availability_tier").alias("tier"),
            )
        )
    ).scalar()
    grid = days.select("date", F.explode(planned).alias("p")).select("date", "p.*")
    df = grid.join(live, ["date", "source_id"], "left").withColumn("live", F.coalesce("live", F.lit(False)))

    def ratio(cond: Column) -> Column:
        n = F.count(F.when(cond, 1))
        return F.when(n == 0, 1.0).otherwise(F.round(F.count(F.when(cond & c("live"), 1)) / n, 4))

    fams = F.collect_set(F.when(c("live") & (c("family") != ""), c("family")))
    all_fams = F.collect_set(F.when(c("family") != "", c("family")))
    search = F.array(F.lit("SEARCH"), F.lit("SOCIAL_DISCOVERY"))
    confirm = c("role") == "CONFIRMATION"
    out = df.groupBy("date").agg(
        F.array_sort(F.collect_set(F.when(c("live"), c("source_id")))).alias("planned_live_ids"),
        F.when(F.size(all_fams) == 0, 1.0).otherwise(F.round(F.size(fams) / F.size(all_fams), 4)).alias(
            "family_availability"
        ),
        ratio(c("tier") == "core").alias("core_availability"),
        ratio(c("source_id").isin(*dims.CREDIBILITY_SOURCES)).alias("credibility_availability"),
        ratio(confirm & (c("family") == "MUSIC_CHART")).alias("music_availability"),
        ratio(confirm & (c("family") == "SHOW_CHART")).alias("show_availability"),
        ratio(c("source_id").isin(*dims.SHORT_VIDEO_SOURCES)).alias("short_video_availability"),
        F.round(F.size(F.array_intersect(fams, search)) / 2.0, 4).alias("search_availability"),
    )
    ids = log.where("ok").groupBy("date").agg(
        F.array_sort(F.collect_set("source_id")).alias("available_ids"),
        F.array_sort(F.collect_set(F.when(c("item_count") > 0, c("source_id")))).alias("non_empty_ids"),
    )
    return out.join(ids, "date", "left")


def publish_health(
    health: DataFrame, plan: DataFrame, items: DataFrame, top_window: int = 20, rules: dict | None = None
) -> DataFrame:
    """Per date: is the ranking fit for the public, and why not.

    ``items``: ranked rows (date, rank, lane, candidate_type, maturity, source_families).
    """
    rules, c = rules or dims.RULES, F.col
    dim = plan.select("source_id", "role", "family_primary", F.col("availability_tier").alias("tier"))
    good = health.where(c("failure_class") == "healthy").select("date", "source_id").join(
        F.broadcast(dim), "source_id", "left"
    )
    fam_when = lambda cond: F.array_sort(
        F.collect_set(F.when(cond & (c("family_primary") != ""), c("family_primary")))
    )
    sources = good.groupBy("date").agg(
        F.countDistinct(F.when(c("tier") == "core", c("source_id"))).alias("healthy_core"),
        fam_when(c("role") == "DISCOVERY").alias("discovery_families"),
        fam_when(c("role").isin(*dims.SUPPORT_ROLES)).alias("confirmation_families"),
    )
    top = items.where(c("rank") <= top_window)
    single = F.when(
        F.size("source_families") == 1, F.get("source_families", F.lit(0))
    )
    mature = c("candidate_type").isin(*dims.MATURE_TYPES) & (F.coalesce("maturity", F.lit(0.0)) >= 0.8)
    listing = top.groupBy("date").agg(
        F.count("*").alias("top_items"),
        F.count(F.when(c("lane") == "words_behaviors", 1)).alias("words_behaviors"),
        F.count(F.when(mature, 1)).alias("mature_items"),
        *[F.count(F.when(single == f, 1)).alias(f"single_{f}") for f in dims.FAMILIES],
    )
    df = sources.join(listing, "date", "full_outer").fillna(0)
    none = F.array().cast("array<string>")
    df = (
        df.withColumn("discovery_families", F.coalesce("discovery_families", none))
        .withColumn("confirmation_families", F.coalesce("confirmation_families", none))
        .withColumn("discovery_count", F.size("discovery_families"))
        .withColumn("confirmation_count", F.size("confirmation_families"))
        .withColumn(
            "dominance",
            F.when(
                c("top_items") > 0,
                F.greatest(*[c(f"single_{f}") for f in dims.FAMILIES]) / c("top_items"),
            ).otherwise(0.0),
        )
        .withColumn(
            "mature_ratio",
            F.when(c("top_items") > 0, F.round(c("mature_items") / c("top_items"), 4)).otherwise(0.0),
        )
    )
    words_min = int(rules["credible_words_behaviors_min"])
    dominance_max = rules["single_family_dominance_max"]
    below = lambda label, col, low: F.when(
        c(col) < low, F.concat(F.lit(f"{label}<{low}:"), c(col).cast("string"))
    )
    reasons = F.filter(
        F.array(
            below("healthy_core_sources", "healthy_core", CORE_HEALTHY_MIN),
            below("discovery_families", "discovery_count", DISCOVERY_FAMILY_MIN),
            below("confirmation_families", "confirmation_count", CONFIRMATION_FAMILY_MIN),
            below(f"words_behaviors_top{top_window}", "words_behaviors", words_min),
            F.when(
                c("dominance") > dominance_max,
                F.concat(
                    F.lit(f"single_family_dominance>{dominance_max}:"),
                    F.round("dominance", 4).cast("string"),
                ),
            ),
        ),
        lambda r: r.isNotNull(),
    )
    return df.withColumn("reasons", reasons).select(
        "date", (F.size("reasons") == 0).alias("public_eligible"),
        (F.size("reasons") > 0).alias("shadow_only"), "reasons", "healthy_core",
        "discovery_count", "confirmation_count", "words_behaviors", "mature_ratio",
        F.round("dominance", 4).alias("dominance"), "top_items",
        "discovery_families", "confirmation_families",
    )


def rollout_by_day(evaluations: DataFrame, window_days: int = 14, top_k: int = 20) -> DataFrame:
    """Readiness at every shadow date, over the newest ``window_days`` shadow dates up to it.

    ``evaluations``: date, variant, breakout_precision_7d, future_spread_7d,
    mature_people_music_ratio, healthy_core, discovery_count, confirmation_count,
    words_behaviors, write_ops. One row per (date, variant): small by nature, so one window
    over the dates is enough. The two variants of a date are pivoted side by side.
    """
    c = F.col
    names = ("breakout_precision_7d", "future_spread_7d", "mature_people_music_ratio")
    checks = ("healthy_core", "discovery_count", "confirmation_count", "words_behaviors")
    shadow, public = "shadow_v2", "public_main"
    sides = evaluations.groupBy("date").pivot("variant", [shadow, public]).agg(
        F.lit(True).alias("there"), *[F.max(n).alias(n) for n in (*names, *checks, "write_ops")])
    sides = sides.where(c(f"{shadow}_there"))
    frame = Window.orderBy("date").rowsBetween(1 - window_days, Window.currentRow)
    zero, known = F.lit(0.0), c(f"{public}_there")
    of_shadow = lambda n: F.coalesce(f"{shadow}_{n}", F.lit(0))
    df = sides.select(
        "date", F.count("*").over(frame).alias("window_size"), F.count(F.when(known, 1)).over(frame).alias("public_size"),
        *[F.coalesce(F.avg(F.coalesce(f"{shadow}_{n}", zero)).over(frame), zero).alias(f"avg_shadow_{n}") for n in names],
        *[F.coalesce(F.avg(F.when(known, F.coalesce(f"{public}_{n}", zero))).over(frame), zero).alias(f"avg_public_{n}") for n in names],
        *[F.min(of_shadow(n)).over(frame).alias(f"min_{n}") for n in checks],
        F.round(F.avg(of_shadow("write_ops")).over(frame), 2).alias("avg_write_ops"),
        F.max(of_shadow("write_ops")).over(frame).alias("max_write_ops"))
    # Four digits without trailing zeros, as a decimal number is written.
    text = lambda col: F.regexp_replace(F.format_string("%.4f", col), r"(\.\d+?)0+$", "$1")
    low = lambda label, col, m: F.when(c(col) < m, F.concat(F.lit(f"{label}<{m}:"), c(col).cast("string")))
    sb, pb = c(f"avg_shadow_{names[0]}"), c(f"avg_public_{names[0]}")
    sm, pm = c(f"avg_shadow_{names[2]}"), c(f"avg_public_{names[2]}")
    reasons = F.array_compact(F.array(
        F.when(
            c("window_size") < window_days,
            F.concat(F.lit("insufficient_shadow_history:"), c("window_size").cast("string"), F.lit(f"/{window_days}"))),
        F.when(
            c("public_size") < c("window_size"),
            F.concat(F.lit("missing_public_baseline:"), c("public_size").cast("string"), F.lit("/"), c("window_size").cast("string"))),
        low("healthy_core_sources", "min_healthy_core", CORE_HEALTHY_MIN),
        low("discovery_families", "min_discovery_count", DISCOVERY_FAMILY_MIN),
        low("confirmation_families", "min_confirmation_count", CONFIRMATION_FAMILY_MIN),
        low(f"words_behaviors_top{top_k}", "min_words_behaviors", ROLLOUT_WORDS_MIN),
        F.when(c("max_write_ops") > WRITE_OPS_MAX, F.concat(F.lit(f"write_ops>{WRITE_OPS_MAX}:"), c("max_write_ops").cast("string"))),
        F.when((c("public_size") > 0) & (sb < pb), F.concat(F.lit("shadow_breakout_precision<"), text(pb), F.lit(":"), text(sb))),
        F.when((c("public_size") > 0) & (sm > pm), F.concat(F.lit("shadow_mature_ratio>"), text(pm), F.lit(":"), text(sm))),
    ))
    rounded = {f"avg_{s}_{n}": F.round(f"avg_{s}_{n}", 4) for s in ("shadow", "public") for n in names}
    return df.withColumn("reasons", reasons).withColumn("ready", F.size("reasons") == 0).withColumns(rounded)


def rollout_readiness(evaluations: DataFrame, window_days: int = 14, top_k: int = 20) -> DataFrame:
    """Readiness over the newest ``window_days`` shadow dates: the last row of :func:`rollout_by_day`.

    Without any shadow date there is one row, not ready, with a window of size 0.
    """
    days = rollout_by_day(evaluations, window_days, top_k)
    last = days.select(F.struct(*[x for x in days.columns if x != "date"]).alias("_r"), "date").agg(F.max_by("_r", "date").alias("_r"))
    none = F.array(F.lit(f"insufficient_shadow_history:0/{window_days}"))
    missing = {"window_size": F.lit(0), "public_size": F.lit(0), "reasons": none, "ready": F.lit(False)}
    fields = [x for x in days.columns if x != "date"]
    return last.select(*[F.coalesce(F.col("_r")[x], missing.get(x, F.lit(0))).alias(x) for x in fields])


def failure_streaks(run_log: DataFrame, max_consecutive: int = 3) -> DataFrame:
    """Consecutive failures per source and the kill switch they trip.

    A source's history has one row per run day; islands are numbered by the count of
    successes so far.
    """
    w = Window.partitionBy("source_id").orderBy("date")
    df = run_log.withColumn("_island", F.sum(F.col("ok").cast("int")).over(w))
    iw = Window.partitionBy("source_id", "_island").orderBy("date")
    streak = F.sum((~F.col("ok")).cast("int")).over(iw)
    return (
        df.withColumn("streak", streak)
        .withColumn("streak_before", F.coalesce(F.lag("streak").over(w), F.lit(0)))
        .withColumn("kill_switch", F.col("streak_before") >= max_consecutive)
        .drop("_island")
    )


def write_volume(counts: DataFrame) -> DataFrame:
    """Estimated document writes per run: rows x fan-out of every enabled dataset.

    ``counts``: date, dataset, row_count, fan_out, enabled.
    """
    return counts.groupBy("date").agg(
        F.sum(F.when(F.col("enabled"), F.col("row_count") * F.col("fan_out")).otherwise(0)).alias("write_ops")
    )


def cost_ledger(usage: DataFrame, app: AppConfig | None = None) -> DataFrame:
    """Monthly cost, budget ratio and the service tier it allows.

    ``usage``: date, service, calls.
    """
    from swellcast.functions.numeric import by_key

    app, c = app or AppConfig(), F.col
    price = by_key(c("service"), dims.UNIT_COST, 0.0)
    monthly = usage.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.sum(c("calls") * price).alias("cost"), F.sum("calls").alias("calls")
    )
    budget = app.monthly_budget
    ratio = c("cost") / float(budget) if budget > 0 else F.lit(0.0)
    df = monthly.withColumn("budget_ratio", ratio)
    return df.withColumn(
        "tier",
        F.when(c("budget_ratio") >= 1.0, "search_off")
        .when(c("budget_ratio") >= app.search_reduce_at_ratio, "search_reduced")
        .when(c("budget_ratio") >= app.template_at_ratio, "watch")
        .otherwise("full"),
    ).withColumn(
        "search_max",
        F.when(c("tier") == "search_off", 0).when(c("tier") == "search_reduced", min(5, app.top_k)).otherwise(app.top_k),
    )
