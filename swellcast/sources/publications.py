"""Publications under one commit point: several collections of a run become visible together, or not at all.

Every collection is a table partitioned by (date, run_id); a run only ever adds partitions of its own. Its
commit is one row per date, appended in one file to the table of commits after all collections are
written. A reader takes of each date the run with the newest commit and prunes all other partitions, so a
run that broke off between two collections is never seen, and a reader that started earlier keeps
its run. Publishers of one folder take turns (the daily run holds a lock).

Row counts of a run are observed while its rows are written; nothing is counted a second time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_COMMITS = "date date, run_id string, sequence long, counts map<string,long>"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The commits so far; empty before the first one."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{root}/commits")
    except AnalysisException:
        return spark.createDataFrame([], _COMMITS)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows under ``rows`` as it is written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last")), seen


def write_collection(df: DataFrame, root: str, collection: str, run_id: str) -> dict:
    """One collection of a run; its row count and dates as observed. A repeated write replaces the run's partitions."""
    rows, seen = observed(df.withColumn("run_id", F.lit(run_id)), f"{collection}-{run_id}")
    (rows.hint("rebalance", "date", "run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date", "run_id").parquet(f"{root}/{collection}"))
    return seen.get


def commit(spark: SparkSession, root: str, run_id: str, dates: DataFrame, counts: dict[str, int]) -> None:
    """Make the run current on ``dates`` (date). The one file of the append is the commit point."""
    newest = commits(spark, root).agg(F.coalesce(F.max("sequence"), F.lit(-1)).alias("newest")).first().newest
    listed = F.map_from_arrays(F.array(*[F.lit(c) for c in counts]), F.array(*[F.lit(n).cast("long") for n in counts.values()]))
    # One row per date of a run, so one file is enough.
    dates.select("date").distinct().select("date", F.lit(run_id).alias("run_id"), F.lit(newest + 1).cast("long").alias("sequence"),
                                           listed.alias("counts")).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def publish(root: str, run_id: str, collections: dict[str, DataFrame]) -> dict[str, int]:
    """Write all collections of a run, then commit the dates of the first one. Returns the observed counts."""
    counts = {name: write_collection(df, root, name, run_id)["rows"] for name, df in collections.items()}
    first = next(iter(collections))
    spark = collections[first].sparkSession
    written = spark.read.parquet(f"{root}/{first}").where(F.col("run_id") == run_id)
    commit(spark, root, run_id, written, counts)
    return counts


def current(spark: SparkSession, root: str) -> DataFrame:
    """(date, run_id) of the run to read per date."""
    newest = F.max_by("run_id", F.struct("sequence", "run_id")).alias("run_id")
    return commits(spark, root).groupBy("date").agg(newest)


def read(spark: SparkSession, root: str, collection: str) -> DataFrame:
    """The collection as last committed, day by day."""
    return spark.read.parquet(f"{root}/{collection}").join(current(spark, root), ["date", "run_id"], "left_semi")


def clean(spark: SparkSession, root: str, collections: list[str]) -> DataFrame:
    """Empty the partitions of runs that never committed; (collection, date, run_id) of those emptied.

    Call it while nothing is published. Committed runs stay, the former ones too: readers may hold them.
    """
    done = commits(spark, root).select("run_id").distinct()
    gone = []
    for name in collections:
        table = spark.read.parquet(f"{root}/{name}")
        left = table.select("date", "run_id").distinct().join(done, "run_id", "left_anti")
        # A few abandoned partitions per crash; each is a folder of its own.
        for r in left.select("date", "run_id").toLocalIterator():
            path = f"{root}/{name}/date={r.date}/run_id={r.run_id}"
            table.drop("date", "run_id").limit(0).write.mode("overwrite").parquet(path)
            gone.append((name, r.date, r.run_id))
    return spark.createDataFrame(gone, "collection string, date date, run_id string")
