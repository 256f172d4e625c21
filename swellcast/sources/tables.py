"""Collection scans and sinks over partitioned Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: collections a ranking is published to -----------------------------------
PUBLISH_COLLECTIONS = ("daily_rankings", "daily_rankings_v2_shadow", "runs")
PUBLIC_META = ("date", "generated_at", "run_id", "top_k", "status", "published_at", "latest_published_run_id")


def scan(
    df: DataFrame,
    filters: Sequence[tuple[str, str, object]] = (),
    order_by: str | None = None,
    descending: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Filtered, ordered, limited read; filters are equality or membership tests."""
    for name, op, value in filters:
        if op == "==":
            df = df.where(F.col(name) == value)
        elif op == "in":
            df = df.where(F.col(name).isin(*value))
        else:
            raise ValueError(f"unsupported filter: {op}")
    if order_by:
        df = df.orderBy(F.desc(order_by) if descending else F.asc(order_by))
    return df.limit(limit) if limit is not None else df


def by_dates(df: DataFrame, dates: Sequence[str], column: str = "date") -> DataFrame:
    """Rows of a list of dates; on a date-partitioned table this prunes partitions."""
    wanted = [F.lit(d).cast("date") for d in dict.fromkeys(dates)]
    return df.where(F.col(column).isin(*wanted))


def look_back(df: DataFrame, as_of: str, window_days: int, horizon_days: int, column: str = "date") -> DataFrame:
    days = max(window_days + horizon_days - 1, 1)
    end = F.lit(as_of).cast("date")
    return df.where(F.col(column).between(F.date_sub(end, days - 1), end))


def active_or_all(df: DataFrame) -> DataFrame:
    """Active rows; the whole table when there are none."""
    active = F.coalesce(F.col("status") == "ACTIVE", F.lit(False))
    # A scalar subquery in the same plan, so nothing runs while planning.
    any_active = df.agg(F.coalesce(F.max(active), F.lit(False))).scalar()
    return df.where(active | ~any_active)


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge by key: new non-null values win, other columns and rows stay."""
    incoming = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys])
    df = old.join(incoming, list(keys), "full_outer")

    def value(c: str) -> Column:
        if c in keys or c not in new.columns:
            return F.col(c)
        return F.coalesce(f"_n_{c}", c).alias(c)

    extra = [c for c in new.columns if c not in old.columns]
    return df.select(*[value(c) for c in old.columns], *[F.col(f"_n_{c}").alias(c) for c in extra])


def write_days(df: DataFrame, path: str, partitions: Sequence[str] = ("date",)) -> None:
    """Replace exactly the partitions present in ``df`` (idempotent re-run of a day).

    Rows go to their partition's writers first, so a day does not leave one small file per
    task. The rebalance lets Spark split a heavy partition by its measured bytes.
    """
    (
        df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions).parquet(path)
    )


def publish_rows(ranked: DataFrame, run_id: str, light: bool = False, shadow_only: bool = False) -> DataFrame:
    """Fan one ranking out to the collections of a publish mode, versioned by run.

    A light publish only writes the run's own copy.
    """
    names = ["runs"] if light else list(PUBLISH_COLLECTIONS)
    status = F.when(
        (F.col("collection") == "daily_rankings_v2_shadow") | F.lit(shadow_only), "SHADOW_ONLY"
    ).otherwise("PUBLISHED")
    return ranked.withColumn("collection", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn(
        "run_id", F.lit(run_id)
    ).withColumn("status", status)


def public_meta(meta: DataFrame) -> DataFrame:
    """Publication record without its internal fields."""
    return meta.select(*[c for c in PUBLIC_META if c in meta.columns])


def latest_published(day_meta: DataFrame, runs: DataFrame) -> DataFrame:
    """Run to show per day: the day record when complete, else the newest published run."""
    complete = day_meta.where(
        (F.coalesce("published_at", F.lit("")) != "") & (F.coalesce("latest_published_run_id", F.lit("")) != "")
    ).select("date", F.col("latest_published_run_id").alias("day_run"))
    newest = runs.where(
        (F.coalesce("published_at", F.lit("")) != "") & (F.coalesce("run_id", F.lit("")) != "")
    ).groupBy("date").agg(F.max_by("run_id", F.struct("published_at", "run_id")).alias("newest_run"))
    return complete.join(newest, "date", "full_outer").select(
        "date", F.coalesce("day_run", "newest_run").alias("run_id")
    )


def snapshot_items(items: DataFrame, day_meta: DataFrame, runs: DataFrame) -> DataFrame:
    return items.join(latest_published(day_meta, runs), ["date", "run_id"]).orderBy("date", "rank")


def run_summary(health: DataFrame, counts: DataFrame) -> DataFrame:
    """One nested record per run date: per-source status and dataset counts.

    A date has one entry per catalogued source and per dataset, so the maps are small.
    """
    sources = health.groupBy("date").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("source_id", F.struct("ok", "item_count", "failure_class").alias("s"))))
        ).alias("sources"),
        F.count(F.when(F.col("failure_class") == "healthy", 1)).alias("healthy_sources"),
    )
    datasets = counts.groupBy("date").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", "row_count")))).alias("counts")
    )
    return sources.join(datasets, "date", "full_outer")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
