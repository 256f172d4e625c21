"""As-of lookup: for every asking row the newest earlier row of a keyed history.

No range join: history and questions become one stream per key and block of time, sorted by time, in
which the last history row is carried forward. A question without a history row in its own block takes
the last one of the blocks before, from a carry table with one row per (key, block). A hot key is as
many window partitions as it has blocks, and equal questions are asked once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a block of time.
BLOCK_DAYS = 32


def as_of(
    asked: DataFrame, history: DataFrame, keys: Sequence[str], time: str, values: Sequence[str],
    strict: bool = True, found_time: str | None = None, block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """``asked`` with ``values`` of the newest ``history`` row of its keys before ``time`` (a date).

    ``strict`` leaves out history rows of the asking day itself. ``found_time`` adds the day of the row
    that was found. Questions whose keys or time are null, and those before any history, get nulls. Of
    several history rows of one key and day the one with the greatest values counts. Rows of ``asked`` are
    neither lost nor multiplied.
    """
    keys = list(keys)
    held = F.struct(F.col(time).alias("_time"), *[F.col(v) for v in values])
    block = F.floor(F.datediff(time, F.lit("1970-01-01")) / block_days).alias("_block")
    known = history.where(_all_set([*keys, time])).groupBy(*keys, time).agg(F.max(held).alias("_held"))
    # At one day history comes before the questions, or after them if only earlier days count.
    states = known.select(*keys, time, block, F.lit(2 if strict else 0).alias("_order"), "_held")
    kind = states.schema["_held"].dataType.simpleString()
    questions = asked.where(_all_set([*keys, time])).select(*keys, time).distinct().select(
        *keys, time, block, F.lit(1).alias("_order"), F.lit(None).cast(kind).alias("_held"))
    stream = states.unionByName(questions)

    within = Window.partitionBy(*keys, "_block").orderBy(time, "_order")
    own = stream.withColumn("_last", F.last("_held", ignorenulls=True).over(within)).where(F.col("_order") == 1)
    blocks = stream.groupBy(*keys, "_block").agg(F.max("_held").alias("_newest"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carried", F.last("_newest", ignorenulls=True).over(before)).select(*keys, "_block", "_carried")
    answers = own.join(carried, [*keys, "_block"]).select(*keys, time, F.coalesce("_last", "_carried").alias("_found"))
    out = [F.col(f"_found.{v}").alias(v) for v in values]
    if found_time:
        out.append(F.col("_found._time").alias(found_time))
    return asked.join(answers, [*keys, time], "left").select(*asked.columns, *out)


def _all_set(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out
