"""Topic extraction over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.functions import text as T
from swellcast.functions.unicode import nfkc_each


def topic_array(text: Column, limit: int = 10) -> Column:
    """First ``limit`` distinct topics of a text as (candidate_type, name, normalized).

    Hashtags, behaviours, quoted spans, then phrases, in order of appearance. The whole
    text is scanned; everything stays in the row, so no shuffle is needed.
    """

    def surface(kind: Column | None, value: Column, normalized: Column) -> Column:
        # The class reads the normalised surface, which is at hand already.
        kind = T.topic_class_of(normalized) if kind is None else kind
        return F.struct(kind.alias("candidate_type"), value.alias("surface"), normalized.alias("normalized"))

    tags = F.transform(
        T.hashtags(text), lambda v: surface(F.lit("HASHTAG"), v, T.normalize_topic_nf(v))
    )
    behaviors = F.transform(
        T.behavior_phrases(text), lambda v: surface(F.lit("BEHAVIOR"), v, T.normalize_topic_nf(v))
    )
    # A repeated surface adds nothing to its first mention, so it goes before anything is normalised.
    free = nfkc_each(
        F.array_distinct(
            F.concat(
                F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(T.QUOTED), F.lit(1)),
                F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(T.PHRASE), F.lit(1)),
            )
        )
    )
    leading = F.concat(tags, behaviors)

    def first_topics(candidates: Column) -> Column:
        phrases = F.transform(candidates, lambda v: T.let(T.normalize_topic_nf(v), lambda n: surface(None, v, n)))
        kept = F.filter(F.concat(leading, phrases), lambda t: T.keep_topic_nf(t["normalized"]))
        named = F.transform(
            kept,
            lambda t: F.struct(
                t["candidate_type"].alias("candidate_type"),
                F.when(t["candidate_type"] == "HASHTAG", t["surface"]).otherwise(t["normalized"]).alias("name"),
                t["normalized"].alias("normalized"),
            ),
        )
        return F.slice(F.array_distinct(named), 1, limit)

    # Order is fixed, so a head that already fills the limit settles the answer; only
    # texts whose head does not are scored to the end.
    head = T.let(first_topics(F.slice(free, 1, 2 * limit)), lambda t: F.when(F.size(t) >= limit, t))
    return F.coalesce(head, first_topics(free))


def extract_topics(
    texts: DataFrame, text: str = "text", keep: tuple[str, ...] = (), limit: int = 10, family: str | None = None
) -> DataFrame:
    """Texts to topic mentions with confidence and domain."""
    df = texts.select(*keep, F.posexplode(topic_array(F.col(text), limit)).alias("pos", "t"))
    fam = F.col(family) if family else F.lit("UNKNOWN")
    return df.select(
        *keep, (F.col("pos") + 1).alias("position"), "t.candidate_type", "t.name",
        T.topic_confidence(F.col("t.candidate_type")).alias("confidence"),
        T.classify_domain(F.col("t.candidate_type"), fam, F.col("t.normalized")).alias("domain_class"),
    )


def raise_confidence(mentions: DataFrame, floor: str = "MEDIUM") -> DataFrame:
    """Lift LOW confidence where the source itself vouches for the surface."""
    return mentions.withColumn(
        "confidence", F.when(F.col("confidence") == "LOW", floor).otherwise(F.col("confidence"))
    )


def mine_topics(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = (), limit: int = 8) -> DataFrame:
    """Topics of a text, else the mined phrases with a coarse type."""
    has_any = "|".join(dims.FALLBACK_BEHAVIOR_TOKENS)
    fallback = F.transform(
        T.mined_phrases(F.col(text), limit),
        lambda p: F.struct(
            F.when(p.rlike(has_any), "BEHAVIOR").when(p.startswith("#"), "HASHTAG").otherwise("PHRASE").alias("candidate_type"),
            p.alias("name"), p.alias("normalized"),
        ),
    )
    df = texts.select(*keep, text, topic_array(F.col(text), limit).alias("topics"))
    mined = F.size("topics") == 0
    chosen = F.when(mined, fallback).otherwise(F.col("topics"))
    return df.select(*keep, mined.alias("from_mining"), F.posexplode(chosen).alias("pos", "t")).select(
        *keep, "from_mining", (F.col("pos") + 1).alias("position"), "t.candidate_type", "t.name"
    )


def tag_entities(
    texts: DataFrame, tagger: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """Entity tagging hook: a caller-supplied tagger runs once per task over Arrow batches."""
    return texts.mapInPandas(tagger, schema)


def gazetteer_tags(
    texts: DataFrame, gazetteer: DataFrame, key: str, text: str = "text", limit: int = 5
) -> DataFrame:
    """Built-in tagger: single-word names found in a text, first mentions first.

    ``gazetteer``: name, entity_type; give a stored table, whose small size lets the runtime send it to
    the words. Then only the words that are names are shuffled, each once per text and task.
    """
    words = texts.select(
        key, F.posexplode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("pos", "word")
    ).where(F.col("word") != "")
    names = gazetteer.select(F.lower("name").alias("word"), "name", "entity_type").distinct()
    w = Window.partitionBy(key).orderBy("pos", "entity_type")
    hits = words.join(names, "word").groupBy(key, "name", "entity_type").agg(F.min("pos").alias("pos"))
    return hits.withColumn("slot", F.row_number().over(w)).where(
        F.col("slot") <= limit
    ).select(key, "slot", "name", "entity_type")
