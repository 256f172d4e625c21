"""Stage tables: where a long plan is cut by writing a table to the shared folder.

The daily job stores source features, candidate features and labels anyway; later
stages read those tables. Cutting there also keeps filters on computed columns from
being pushed through (and multiplied by) the whole expression chain.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named in spark.checkpoint.dir.

    Only a local session, whose driver is its one executor, may go without: it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not folder:
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str, sf_dir: str = "") -> str:
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
    return f"{shared_folder(spark)}/swellcast/{spark.sparkContext.applicationId}/{tag}/{name}"


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` once per application and input folder, then read it back."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = new_path(spark, name, sf_dir)
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def forget() -> None:
    """Drop the memory of written stages, so the next use rebuilds them."""
    _WRITTEN.clear()
