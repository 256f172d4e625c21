"""Merge chains: which candidate a merged one has become, by pointer jumping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def redirects(edits: DataFrame) -> DataFrame:
    """(candidate_id, into) of the merges among ``edits``; of several merges of one candidate the last counts.

    ``edits`` as in ``pairs``: edit_id, left_id, right_id, action, winner_id (null: the left one), decided_at.
    """
    winner = F.coalesce("winner_id", "left_id")
    loser = F.when(winner == F.col("left_id"), F.col("right_id")).otherwise(F.col("left_id"))
    merges = edits.where("action = 'merge' AND left_id <> right_id").select(
        loser.alias("candidate_id"), winner.alias("into"), "decided_at", "edit_id")
    return merges.groupBy("candidate_id").agg(F.max_by("into", F.struct("decided_at", "edit_id")).alias("into"))


def survivors(merged: DataFrame, folder: str) -> DataFrame:
    """(candidate_id, survivor, hops, cyclic) for every candidate of ``merged`` (candidate_id, into).

    Every round a pointer jumps to its target's target and adds that target's hops, so rounds are the logarithm
    of the longest chain. Pointers into a cycle never end: once a round settles nobody, only
    those are left. They jump on until every one must stand on its cycle, carrying the smallest id of the
    stretch behind them; the survivor of a cycle is its smallest id, the hops to it are null. Tables of a round lie
    below ``folder``, which all executors share. One row per candidate; null ids are ignored.
    """
    spark = merged.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    start = kept(merged.where("candidate_id IS NOT NULL AND into IS NOT NULL").groupBy("candidate_id").agg(F.max("into").alias("into")))
    is_merged = start.select(F.col("candidate_id").alias("into"), F.lit(True).alias("_on"))
    table = kept(start.join(is_merged, "into", "left").select(
        "candidate_id", "into", F.lit(1).cast("long").alias("hops"), F.least("candidate_id", "into").alias("least"),
        F.coalesce("_on", F.lit(False)).alias("open")))
    done, jumped, left = [], 1, None
    while True:
        done.append(table.where("NOT open"))
        moving = table.where("open")
        # A settled target is met once; its row leaves the tables after this round.
        target = table.select(
            F.col("candidate_id").alias("into"), F.col("into").alias("_into"), F.col("hops").alias("_hops"),
            F.col("least").alias("_least"), F.col("open").alias("_open"))
        for earlier in done[:-1]:
            target = target.unionByName(earlier.select(
                F.col("candidate_id").alias("into"), F.col("into").alias("_into"), F.col("hops").alias("_hops"),
                F.col("least").alias("_least"), F.col("open").alias("_open")))
        now = moving.count()
        if not now or (now == left and jumped >= now):
            break
        left = now
        table = kept(moving.join(target, "into").select(
            "candidate_id", F.col("_into").alias("into"), (F.col("hops") + F.col("_hops")).alias("hops"),
            F.least("least", "_least").alias("least"), F.col("_open").alias("open")))
        jumped *= 2
    straight = None
    for part in done:
        own = part.select("candidate_id", F.col("into").alias("survivor"), "hops", F.lit(False).alias("cyclic"))
        straight = own if straight is None else straight.unionByName(own)
    # A pointer now stands on its cycle, whose own stretch goes all the way round.
    on_cycle = moving.select(F.col("candidate_id").alias("into"), F.col("least").alias("survivor"))
    round_ = moving.select("candidate_id", "into").join(on_cycle, "into").select(
        "candidate_id", "survivor", F.lit(None).cast("long").alias("hops"), F.lit(True).alias("cyclic"))
    return straight.unionByName(round_)


def follow(df: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` pointing at survivors; ids that were never merged stay."""
    to = found.select(F.col("candidate_id").alias(column), F.col("survivor").alias("_survivor"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_survivor", column)).select(*df.columns)
