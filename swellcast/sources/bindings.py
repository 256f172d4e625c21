"""Bindings of the driver's generic tables to the engine's input tables.

The test tables carry no trend data, so these functions say which column plays
which part. Every binding reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.functions.numeric import by_key

# Event type and parity of the user pick the source.
SOURCE_BY_EVENT = {
    ("view", 0): "SEARCH_JP_24H_ENT",
    ("view", 1): "YAHOO_REALTIME",
    ("click", 0): "TIKTOK_CREATIVE_CENTER_HASHTAGS",
    ("click", 1): "TIKTOK_CREATIVE_CENTER_SONGS",
    ("signup", 0): "TVER_RANKING_JP",
    ("signup", 1): "NETFLIX_TV_JP",
    ("purchase", 0): "APPLE_MUSIC_JP",
    ("purchase", 1): "YOUTUBE_TREND_JP",
    ("error", 0): "EDITORIAL_MODELPRESS",
    ("error", 1): "WEAR_WORDS",
}
COUNTRIES = ("JP", "KR", "TW", "US", "TH")
LEVELS = ("LOW", "MEDIUM", "HIGH")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def kind_of(candidate_type: Column) -> Column:
    return F.when(candidate_type.isin(*dims.TOPIC_TYPES), "TOPIC").otherwise("ENTITY")


# Display names by candidate number modulo 6; they exercise the text scores.
NAME_TAILS = ("", " limited bag tour", " メイク challenge", "の発売 event", " ゴール live show", " これ dance step")


def candidate_name(number: Column) -> Column:
    return F.concat(F.lit("k"), number.cast("string"), _pick(NAME_TAILS, number % len(NAME_TAILS)))


def event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate dimension of the events binding."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") + 100 * F.floor(F.col("user_id") / 150)
    ctype = _pick(dims.CANDIDATE_TYPES, F.col("k") % len(dims.CANDIDATE_TYPES))
    return ev.select(k.alias("k")).distinct().select(
        F.concat(F.lit("k"), F.col("k")).alias("candidate_id"),
        ctype.alias("candidate_type"),
        kind_of(ctype).alias("candidate_kind"),
        candidate_name(F.col("k")).alias("display_name"),
        F.lit("OTHER").alias("domain_class"),
    )


def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as resolved mentions of candidates ``k<n>`` in ten sources.

    The candidate number mixes the event's ``k`` with a block of 150 users, so the
    candidate population grows with the table.
    """
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") + 100 * F.floor(F.col("user_id") / 150)
    uid = F.col("user_id")
    eid = F.col("event_id")
    combo = F.concat_ws(":", F.col("event_type"), (uid % 2).cast("string"))
    source = by_key(combo, {f"{e}:{p}": s for (e, p), s in SOURCE_BY_EVENT.items()}, None)
    ctype = _pick(dims.CANDIDATE_TYPES, F.col("k") % len(dims.CANDIDATE_TYPES))
    country = _pick(COUNTRIES, F.col("user_id") % len(COUNTRIES))
    derived = (F.col("event_type") == "signup") & (F.col("event_id") % 4 == 0)
    base = ev.select(
        F.to_date("ts").alias("date"), source.alias("source_id"), k.alias("k"),
        eid.alias("event_id"), uid.alias("user_id"), "event_type", "value",
    )
    return base.select(
        "date",
        "source_id",
        F.concat(F.lit("k"), F.col("k")).alias("candidate_id"),
        ctype.alias("candidate_type"),
        kind_of(ctype).alias("candidate_kind"),
        F.col("value").alias("metric_value"),
        (F.lit(1) + F.col("event_id") % 50).cast("int").alias("rank"),
        (F.col("event_id") % 3).cast("int").alias("confidence_rank"),
        F.col("event_id").alias("ordinal"),
        F.array(country).alias("countries"),
        F.create_map(country, (F.lit(1) + F.col("event_id") % 50).cast("int")).alias("country_ranks"),
        F.when(F.col("user_id") % 7 == 0, F.lit("JP")).alias("region"),
        F.lit(None).cast("double").alias("regional_score"),
        F.lit(None).cast("array<string>").alias("query_variants"),
        derived.alias("derived_from_work"),
        F.when(derived, F.concat(F.lit("w"), (F.col("event_id") % 5))).alias("work_cluster_id"),
        F.lit(None).cast("string").alias("surface"),
        candidate_name(F.col("k")).alias("name"),
        F.element_at(
            F.array(F.lit("OTHER"), F.lit("ENTERTAINMENT"), F.lit("FASHION_BEAUTY"),
                    F.lit("CONSUMER_CULTURE")), ((F.col("event_id") % 4) + 1).cast("int")
        ).alias("domain_class"),
        "user_id",
    )


def order_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as typed candidate edges with a confidence."""
    li = table(spark, sf_dir, "lineitem")
    src = F.col("l_partkey") % 100
    types = (*dims.PROPAGATING_RELATIONS, "has_cast")
    return li.select(
        F.concat(F.lit("k"), src).alias("src_id"),
        _pick(types, src % len(types)).alias("relation_type"),
        F.concat(F.lit("k"), (src * 7 + 3) % 100).alias("dst_id"),
        F.round(F.lit(0.2) + F.col("l_discount") * 5, 4).alias("confidence"),
    )
