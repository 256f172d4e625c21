"""Evidence pools: identity, de-duplication and the top items per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("date", "candidate_id")
FIELDS = ("source_id", "title", "url", "published_at", "metric", "snippet")


def identity_key() -> Column:
    """Two items are the same when source and url (and metric) or title agree."""
    src, url, metric, title = (F.trim(F.coalesce(c, F.lit(""))) for c in ("source_id", "url", "metric", "title"))
    return (
        F.when((url != "") & (metric != ""), F.struct(src.alias("s"), url.alias("u"), metric.alias("m")))
        .when(url != "", F.struct(src.alias("s"), url.alias("u"), F.lit("").alias("m")))
        .otherwise(F.struct(src.alias("s"), title.alias("u"), metric.alias("m")))
    )


def pool_order(pool: DataFrame) -> DataFrame:
    """Strongest signal first; equal signals keep their extraction order."""
    return pool.withColumn("position", F.struct((-F.col("signal_value")).alias("neg"), F.col("ordinal")))


def dedupe(pool: DataFrame, position: str = "ordinal", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """First item per identity; partial aggregation shrinks repeats before the shuffle."""
    cols = [c for c in pool.columns if c not in keys]
    first = pool.withColumn("_key", identity_key()).groupBy(*keys, "_key").agg(
        F.min_by(F.struct(*cols), position).alias("e")
    )
    return first.select(*keys, "e.*")


def top_items(
    pool: DataFrame, max_items: int = 3, position: str = "ordinal", keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Up to ``max_items`` per candidate, at most one per source, in pool order.

    The first item of a source survives de-duplication by definition, so the
    per-source pick needs no separate de-duplication pass.
    """
    cols = [c for c in pool.columns if c not in (*keys, "source_id")]
    per_source = pool.groupBy(*keys, "source_id").agg(
        F.min_by(F.struct(*cols), position).alias("e")
    ).select(*keys, "source_id", "e.*")
    w = Window.partitionBy(*keys).orderBy(position, "source_id")
    return per_source.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= max_items)


def collect_top(pool: DataFrame, max_items: int = 5, position: str = "ordinal") -> DataFrame:
    """De-duplicated first items as one bounded array per candidate."""
    w = Window.partitionBy(*KEYS).orderBy(position)
    kept = dedupe(pool, position).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_items)
    fields = [c for c in FIELDS if c in pool.columns]
    return kept.groupBy(*KEYS).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_n", *fields))), lambda e: e.dropFields("_n")
        ).alias("evidence")
    )
