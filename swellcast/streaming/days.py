"""Event-time front of the anomaly state: raw timed mentions in, closed days and late rows out.

A sink for ``foreachBatch``; all work is joins and aggregates of the JVM. The watermark trails the newest
event time of the earlier batches by a fixed delay. A day closes as soon as the watermark has passed its
end: its sums leave the open table, advance the baselines and come out once. Rows of a closed day are late:
they come out unchanged, in a table of their own, and touch nothing.

A batch reads the tables of the batch before and writes its own, the description last, into one of two
slots; a batch that is repeated after a failure therefore reads the same and overwrites what it wrote.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellcast.dims import AlgorithmConfig
from swellcast.operators import anomaly

#: What a mention brings.
COLUMNS = ("ts", "candidate_id", "source_id", "family_primary", "metric_value")
_OPEN = ("date", *anomaly.KEYS, "family_primary")


class DayFront:
    """``closed``: rows of :func:`anomaly.fold_history` per day and pair; ``late``: the late rows. Both below ``folder``.

    ``folder`` belongs to one checkpoint. Rows without a time are late. A day whose values are all missing keeps
    the baseline. Days still open at the end stay in the open table.
    """

    def __init__(self, folder: str, delay_days: int = 1, cfg: AlgorithmConfig | None = None) -> None:
        self.folder, self.delay, self.cfg = folder, datetime.timedelta(days=delay_days), cfg or AlgorithmConfig()

    def _slot(self, batch_id: int) -> str:
        return f"{self.folder}/slot{batch_id % 2}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, slot, before = batch.sparkSession, self._slot(batch_id), self._slot(batch_id - 1)
        newest = through = sums = state = None
        if batch_id:
            # The description is the slot's commit: it names its batch.
            known = spark.read.parquet(f"{before}/about").first()
            if known.batch_id != batch_id - 1:
                raise ValueError(f"{before} holds batch {known.batch_id}, not {batch_id - 1}")
            newest, through = known.newest, known.closed_through
            sums, state = spark.read.parquet(f"{before}/sums"), spark.read.parquet(f"{before}/state")
        rows = batch.select(*COLUMNS, F.to_date("ts").alias("date"))
        late = F.col("date").isNull()
        if through is not None:
            late = late | (F.col("date") <= F.lit(through))
        rows.where(late).write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")

        new = rows.where(~late).groupBy(*_OPEN).agg(F.sum("metric_value").alias("signal"), F.count("*").alias("observation_count"))
        if sums is not None:
            still = sums if through is None else sums.where(F.col("date") > F.lit(through))
            new = new.unionByName(still).groupBy(*_OPEN).agg(
                F.sum("signal").alias("signal"), F.sum("observation_count").alias("observation_count"))
        new.write.mode("overwrite").parquet(f"{slot}/sums")

        seen = batch.agg(F.max("ts").alias("newest")).first().newest
        newest = max((t for t in (newest, seen) if t is not None), default=None)
        if newest is not None:
            passed = (newest - self.delay).date() - datetime.timedelta(days=1)
            through = passed if through is None else max(through, passed)
        closing = spark.read.parquet(f"{slot}/sums").where(F.col("date") <= F.lit(through))
        path = f"{self.folder}/closed/batch={batch_id}"
        anomaly.fold_history(closing, self.cfg, state).write.mode("overwrite").parquet(path)
        anomaly.next_state(state, anomaly.newest(spark.read.parquet(path))).write.mode("overwrite").parquet(f"{slot}/state")
        spark.createDataFrame([(batch_id, newest, through)], "batch_id long, newest timestamp, closed_through date").write.mode(
            "overwrite").parquet(f"{slot}/about")

    def start(self, mentions: DataFrame, checkpoint: str):
        """Run what is there of the stream ``mentions`` (see ``COLUMNS``) and end."""
        return mentions.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
