"""Session factory and the settings every job relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Only settings that change results or that a job of this kind always wants.
# Sizes of the cluster (cores, executor memory) belong to it. A shuffle starts with many
# partitions, which AQE joins up to a few MB: rows shrink about fifty-fold in a shuffle, and
# a task holds them in a dozen sorts and windows, so its memory must not grow with the input.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
}


def build_session(app_name: str = "swellcast", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session carrying :data:`DEFAULTS`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Put the runtime-settable defaults on a session somebody else created."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Give costly per-row work every core when a scan has fewer tasks than cores.

    Large inputs already have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
