"""Hindsight labels: what a candidate did in the days after an anchor day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values ---------------------------------------------------------------------
CONFIRM_FAMILIES = ("MUSIC_CHART", "SHOW_CHART", "VIDEO_CONFIRM")
MASS_FAMILIES = (*CONFIRM_FAMILIES, "EDITORIAL", "COMMERCE")
MASS_HEAT_MIN = 0.9
BROAD_MIN = 0.6
MAX_HORIZON = 14
# Days back -> (break-out horizons, mass horizons) that are complete by then.
LABEL_PLAN = {1: ([1], []), 3: ([1, 3], [3]), 7: ([1, 3, 7], [3, 7]), 14: ([1, 3, 7, 14], [3, 7])}
FLAGS = (
    "breakout_1d", "breakout_3d", "breakout_7d", "breakout_14d", "mass_now", "mass_3d", "mass_7d",
    "home_confirm_3d", "home_confirm_7d", "public_confirm_7d", "trivial_noise_7d",
)


def mass_flag() -> Column:
    families = F.array(*[F.lit(f) for f in MASS_FAMILIES])
    return (
        (F.col("mass_heat") >= MASS_HEAT_MIN)
        | (F.col("broad_confirmation") >= BROAD_MIN)
        | (F.size(F.array_intersect("source_families", families)) >= 2)
    )


def label_plan(dates: DataFrame, target_date: str) -> DataFrame:
    """Anchor days of one run date with the horizons that are complete for them."""
    spark = dates.sparkSession
    rows = [(back, b, m) for back, (b, m) in LABEL_PLAN.items()]
    plan = spark.createDataFrame(
        rows, "back int, breakout_horizons array<int>, mass_horizons array<int>"
    )
    anchor = F.date_sub(F.lit(target_date).cast("date"), F.col("back"))
    return plan.select(anchor.alias("date"), "breakout_horizons", "mass_horizons")


def backfill_plan(features: DataFrame) -> DataFrame:
    """Every day as an anchor; a horizon counts once the data reaches past it."""
    days = features.select("date").distinct()
    newest = features.agg(F.max("date")).scalar()
    reach = F.datediff(newest, F.col("date"))

    def complete(horizons: tuple[int, ...]) -> Column:
        return F.array_compact(F.array(*[F.when(reach >= h, F.lit(h)) for h in horizons]))

    return days.select(
        "date", complete((1, 3, 7, 14)).alias("breakout_horizons"), complete((3, 7)).alias("mass_horizons")
    )


def future_offsets(
    features: DataFrame, anchors: DataFrame | None = None, max_horizon: int = MAX_HORIZON
) -> DataFrame:
    """First day offset at which each outcome shows, per (candidate, anchor day).

    One window over a candidate's days answers all horizons: the first later day with the
    outcome inside the range. A candidate has at most one row per day, so no partition
    outgrows the calendar. ``anchors`` (one row per wanted day) keeps those days only.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    flags = {
        "mass": mass_flag(),
        **{f: F.array_contains("source_families", f) for f in CONFIRM_FAMILIES},
        "multi": F.size("source_families") >= 2,
        "home": (F.col("constrained_ent") > 0) | (F.col("constrained_beauty") > 0) | (F.col("realtime_support") > 0),
        "public": F.col("public_gate_passed") | (F.col("public_rankability_prob") >= 0.5),
    }
    # The flags become days before the shuffle, so only numbers travel.
    days = features.select("candidate_id", "date", day.alias("day"), *[F.when(f, day).alias(f"at_{n}") for n, f in flags.items()])
    ahead = Window.partitionBy("candidate_id").orderBy("day").rangeBetween(1, max_horizon)
    out = days.select(
        "candidate_id", "date", *[(F.min(f"at_{n}").over(ahead) - F.col("day")).alias(f"off_{n}") for n in flags]
    )
    return out if anchors is None else out.join(anchors.select("date"), "date", "left_semi")


def build_labels(features: DataFrame, plan: DataFrame) -> DataFrame:
    """Labels of every candidate on every planned anchor day."""
    c = F.col
    anchors = features.join(plan, "date").select(
        "date", "candidate_id", "candidate_kind", "source_families", "breakout_horizons",
        "mass_horizons", "public_noise_penalty", "public_rankability_prob",
        mass_flag().alias("mass_now"),
    )
    df = anchors.join(future_offsets(features, plan), ["date", "candidate_id"], "left")
    new_off = {
        f: F.when(~F.array_contains("source_families", f), c(f"off_{f}")) for f in CONFIRM_FAMILIES
    }
    df = df.withColumn("off_new", F.least(*new_off.values()))
    within = lambda col, h: F.coalesce(c(col) <= h, F.lit(False))
    new_within = lambda h: F.array_sort(
        F.filter(
            F.array(*[F.when(o <= h, F.lit(f)) for f, o in new_off.items()]),
            lambda v: v.isNotNull(),
        )
    )
    topic = c("candidate_kind") == "TOPIC"
    out = df.select(
        "date", "candidate_id",
        *[
            (
                F.array_contains("breakout_horizons", h)
                & (within("off_new", h) | within("off_mass", h) | (topic & within("off_multi", h)))
            ).alias(f"breakout_{h}d")
            for h in (1, 3, 7, 14)
        ],
        "mass_now",
        *[
            (F.array_contains("mass_horizons", h) & within("off_mass", h)).alias(f"mass_{h}d")
            for h in (3, 7)
        ],
        within("off_home", 3).alias("home_confirm_3d"),
        within("off_home", 7).alias("home_confirm_7d"),
        within("off_public", 7).alias("public_confirm_7d"),
        (
            topic & ~within("off_home", 7) & ~within("off_public", 7)
            & (F.size("source_families") <= 1)
            & (c("public_noise_penalty") >= 0.55) & (c("public_rankability_prob") < 0.5)
        ).alias("trivial_noise_7d"),
        new_within(MAX_HORIZON).alias("new_confirmation_families"),
        F.size(new_within(7)).alias("new_families_7d"),
        F.size(new_within(MAX_HORIZON)).alias("new_families_14d"),
        F.least("off_new", "off_mass").alias("lead_days"),
        "breakout_horizons", "mass_horizons",
    )
    return out


def merge_labels(existing: DataFrame, computed: DataFrame) -> DataFrame:
    """Late outcomes onto stored labels: flags OR, lists unite, the earliest lead wins.

    All flags are kept, including the confirmation and noise flags.
    """
    keys = ["date", "candidate_id"]
    old = existing.select(*keys, *[F.col(c).alias(f"o_{c}") for c in existing.columns if c not in keys])
    df = computed.join(old, keys, "full_outer")
    empty_s, empty_i = F.array().cast("array<string>"), F.array().cast("array<int>")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"o_{c}"), F.lit(False))
    union = lambda c, e: F.array_sort(
        F.array_union(F.coalesce(F.col(c), e), F.coalesce(F.col(f"o_{c}"), e))
    )
    return df.select(
        *keys,
        *[flag(c).alias(c) for c in FLAGS],
        union("new_confirmation_families", empty_s).alias("new_confirmation_families"),
        F.greatest("new_families_7d", "o_new_families_7d").alias("new_families_7d"),
        F.greatest("new_families_14d", "o_new_families_14d").alias("new_families_14d"),
        F.least("lead_days", "o_lead_days").alias("lead_days"),
        union("breakout_horizons", empty_i).alias("breakout_horizons"),
        union("mass_horizons", empty_i).alias("mass_horizons"),
    )
