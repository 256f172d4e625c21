"""Late outcomes and re-runs: batch operators applied per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swellcast.operators.labels import merge_labels
from swellcast.sources.tables import write_days


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) else None


def label_upsert(path: str, work_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink merging label rows into a date-partitioned label table.

    Replaying a batch gives the same table: flags OR, lists unite, the earliest lead
    wins. Only the dates present in the batch are rewritten; the merged rows pass
    through a work table, because a partition cannot be read and replaced at once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        old = _existing(spark, path)
        merged = batch
        if old is not None:
            touched = old.join(batch.select("date").distinct(), "date", "left_semi")
            merged = merge_labels(touched, batch)
        stage = f"{work_path}/epoch={epoch}"
        merged.write.mode("overwrite").parquet(stage)
        write_days(spark.read.parquet(stage).select(*batch.columns), path)

    return write


def rerun_day(df: DataFrame, path: str) -> None:
    """Recompute a finished day: only its own partitions are replaced."""
    write_days(df, path)
