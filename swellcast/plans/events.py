"""The scoring plan over the ``events`` binding, cut at the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swellcast import dims
from swellcast.operators import anomaly
from swellcast.operators import features as C
from swellcast.operators import fusion as X
from swellcast.operators import labels as L
from swellcast.operators import relations as E
from swellcast.operators import source_features as A
from swellcast.plans.stages import stage
from swellcast.session import spread
from swellcast.sources import bindings as B


def source_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (date, candidate, source): the stored source features."""
    return stage(spark, sf_dir, "source_features", lambda: build_source_features(spark, sf_dir))


def daily_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (date, candidate, source) before the baseline: the stored daily sums."""
    mentions = A.with_catalog(spread(B.event_mentions(spark, sf_dir)), dims.catalog_df(spark))
    return stage(spark, sf_dir, "daily_signals", lambda: A.aggregate_mentions(mentions))


def build_source_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.finish_features(anomaly.fold_history(daily_signals(spark, sf_dir)))


def aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.aggregate_candidates(source_features(spark, sf_dir), dims.domain_fit_df(spark))


def relation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = E.dedupe_relations(B.order_relations(spark, sf_dir))
    return C.propagate_relations(source_features(spark, sf_dir), edges)


def derived(spark: SparkSession, sf_dir: str, with_relations: bool = True, availability: DataFrame | None = None) -> DataFrame:
    candidates = C.score_candidate_text(B.event_candidates(spark, sf_dir))
    df = C.with_candidate_state(C.with_backfill_state(aggregated(spark, sf_dir)), candidates)
    support = relation_support(spark, sf_dir) if with_relations else None
    return C.derive(C.with_relation_support(df, support), availability)


def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per (date, candidate): the stored candidate features."""
    return stage(spark, sf_dir, "candidate_features", lambda: X.fuse(derived(spark, sf_dir)))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hindsight labels of every day: the stored labels."""

    def build() -> DataFrame:
        cf = candidate_features(spark, sf_dir)
        return L.build_labels(cf, L.backfill_plan(cf))

    return stage(spark, sf_dir, "labels", build)
