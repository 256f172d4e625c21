"""Effective source plan and config drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swellcast import dims

SLOW_MODES = ("HTML", "MANUAL_LOGIN", "LLM_SEARCH")


def source_plan(
    catalog: DataFrame,
    overrides: DataFrame | None = None,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    skip_slow: bool = False,
) -> DataFrame:
    """Sources a run may fetch: catalog semantics plus runtime overrides.

    ``overrides``: source_id, enabled (nullable), fetch_limit (nullable).
    """
    df = catalog.where(F.col("status").isin("CORE", "EXPERIMENTAL") & (F.col("role") != "EVIDENCE_ONLY"))
    if include:
        df = df.where(F.col("source_id").isin(*include))
    if exclude:
        df = df.where(~F.col("source_id").isin(*exclude))
    if skip_slow:
        df = df.where(~F.col("access_mode").isin(*SLOW_MODES))
    if overrides is None:
        return df.withColumn("enabled", F.lit(True)).withColumn("fetch_limit", F.lit(None).cast("int"))
    o = overrides.select("source_id", F.col("enabled").alias("_e"), "fetch_limit")
    return df.join(o, "source_id", "left").withColumn("enabled", F.coalesce("_e", F.lit(True))).drop("_e")


def config_drift(spark: SparkSession, config_ids: DataFrame) -> DataFrame:
    """Ids out of step between runtime config, catalog and fetchable sources."""
    known = dims.catalog_df(spark).select("source_id")
    fetchable = spark.createDataFrame([(s,) for s in dims.FETCHABLE_SOURCES], "source_id string")
    ids = config_ids.select("source_id").where(F.coalesce("source_id", F.lit("")) != "").distinct()
    kind = lambda df, k: df.select(F.lit(k).alias("drift"), "source_id")
    unknown = ids.join(known, "source_id", "left_anti")
    stale = ids.join(known, "source_id", "left_semi").join(fetchable, "source_id", "left_anti")
    missing = known.join(fetchable, "source_id", "left_anti")
    return kind(unknown, "unknown").unionByName(kind(stale, "stale")).unionByName(kind(missing, "missing"))
