"""Mentions to candidates: alias, typed-key and external-id indexes as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.functions import text as T
from swellcast.functions.unicode import nfkc

# ``candidates``: candidate_id, candidate_type, candidate_kind, canonical_name,
# display_name, aliases, status, external_ids (map), manual_lock, created_seq.
# ``mentions``: ordinal, name, candidate_type, external_ids (map or NULL), ...


def default_kind(candidate_type: Column) -> Column:
    return F.when(candidate_type.isin(*dims.TOPIC_TYPES), "TOPIC").otherwise("ENTITY")


def key_by_kind(name: Column, kind: Column) -> Column:
    """Match key of a name under its kind's rule; the text is normalised once for both."""
    return key_by_kind_nf(nfkc(name), kind)


def key_by_kind_nf(name: Column, kind: Column) -> Column:
    return T.let(
        name, lambda n: F.when(kind == "TOPIC", T.topic_key_nf(n)).otherwise(T.match_key_nf(n))
    )


def alias_records(candidates: DataFrame) -> DataFrame:
    """One row per (active candidate, canonical name or alias) with its match key."""
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = candidates.where(F.col("status") == "ACTIVE").select(
        "candidate_id", "candidate_type", "candidate_kind", "created_seq", F.posexplode(names).alias("alias_pos", "alias")
    )
    keyed = rows.withColumn("match_key", key_by_kind(F.col("alias"), F.col("candidate_kind")))
    return keyed.withColumn("alias_id", F.concat_ws(":", "candidate_id", "match_key"))


def alias_index(records: DataFrame) -> DataFrame:
    """Match key to candidate, type-blind; the latest written alias wins."""
    return records.groupBy("match_key").agg(
        F.max_by("candidate_id", F.struct("created_seq", "alias_pos")).alias("candidate_id")
    )


def typed_index(records: DataFrame) -> DataFrame:
    typed = F.when(F.col("candidate_kind") == "TOPIC", F.col("match_key")).otherwise(
        F.concat_ws(":", "candidate_type", "match_key")
    )
    return records.withColumn("typed_key", typed).groupBy("typed_key").agg(
        F.max_by("candidate_id", F.struct("created_seq", "alias_pos")).alias("candidate_id")
    )


def external_index(candidates: DataFrame) -> DataFrame:
    rows = candidates.where(F.col("status") == "ACTIVE").select(
        "candidate_id", "created_seq", F.explode("external_ids").alias("provider", "external_id")
    )
    rows = rows.withColumn("provider", F.trim("provider")).withColumn("external_id", F.trim("external_id"))
    return rows.where((F.col("provider") != "") & (F.col("external_id") != "")).groupBy(
        "provider", "external_id"
    ).agg(F.max_by("candidate_id", "created_seq").alias("candidate_id"))


def _strict(name: Column) -> Column:
    return F.lower(T.trim_space(F.regexp_replace(name, T.SPACE, " ")))


def _lock_surfaces(candidates: DataFrame) -> DataFrame:
    """Exact surfaces of the locked candidates."""
    names = F.array_union(
        F.array("canonical_name", "display_name"), F.coalesce("aliases", F.array().cast("array<string>"))
    )
    return candidates.where("manual_lock").select("candidate_id", F.transform(names, lambda a: _strict(a)).alias("surfaces"))


def _by_external(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mentions with the candidate their first matching external id points at."""
    without = mentions.where(F.col("external_ids").isNull()).withColumn("by_external", F.lit(None).cast("string"))
    carrying = mentions.where(F.col("external_ids").isNotNull())
    hits = (
        carrying.select("ordinal", F.posexplode("external_ids").alias("pos", "provider", "external_id"))
        .join(external_index(candidates), ["provider", "external_id"])
        .groupBy("ordinal").agg(F.min_by("candidate_id", "pos").alias("by_external"))
    )
    # Only mentions that carry ids are shuffled for this lookup.
    return without.unionByName(carrying.join(hits, "ordinal", "left").select(*without.columns))


def resolve(mentions: DataFrame, candidates: DataFrame, stored_aliases: DataFrame | None = None) -> DataFrame:
    """External id, then alias, then typed key; locked candidates need an exact surface.

    All lookups are left joins against unique keys, so a mention never fans out; a name
    holding a third of the mentions is split by the runtime's skew join. An alias index
    built here covers every key of the typed index, so that third lookup only runs
    against a stored alias table (match_key, candidate_id), which may lag behind. Lock
    surfaces travel with the index rows: unresolved mentions never meet a join on NULL.
    """
    records = alias_records(candidates)
    locks = _lock_surfaces(candidates)
    kind = default_kind(F.col("candidate_type"))
    active = candidates.where(F.col("status") == "ACTIVE").select("candidate_id")
    index = alias_index(records) if stored_aliases is None else stored_aliases.select(
        "match_key", "candidate_id").join(active, "candidate_id", "left_semi")

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(locks, "candidate_id", "left").select(
            key, F.struct("candidate_id", "surfaces").alias(name)
        )

    df = _by_external(mentions, candidates).withColumn("match_key", key_by_kind(F.col("name"), kind))
    df = df.join(side(index, "match_key", "by_alias"), "match_key", "left")
    hit = F.col("by_alias")
    if stored_aliases is not None:
        typed = F.when(kind == "TOPIC", F.col("match_key")).otherwise(F.concat_ws(":", "candidate_type", "match_key"))
        df = df.withColumn("typed_key", typed).join(side(typed_index(records), "typed_key", "by_type"), "typed_key", "left")
        hit = F.coalesce("by_alias", "by_type")
    by_name = F.when(
        hit["surfaces"].isNull() | F.array_contains(hit["surfaces"], _strict(F.col("name"))), hit["candidate_id"]
    )
    how = (
        F.when(F.col("by_external").isNotNull(), "external").when(F.col("by_alias").isNotNull(), "alias").otherwise("typed")
    )
    df = df.withColumn("candidate_id", F.coalesce("by_external", by_name)).withColumn(
        "resolved_by", F.when(F.col("candidate_id").isNotNull(), how)
    )
    return df.drop("by_external", "by_alias", "by_type", "typed_key")


def mint(resolved: DataFrame) -> DataFrame:
    """New candidates for the unresolved keys: attributes of the first mention per key.

    Equal keys collapse to one id derived from the key, so mentions later in the run
    find the candidate without a second pass.
    """
    kind = F.when(
        (default_kind(F.col("candidate_type")) == "ENTITY") & ~T.is_proper_noun(F.col("name")), "TOPIC"
    ).otherwise(default_kind(F.col("candidate_type")))
    topic = default_kind(F.col("candidate_type")) == "TOPIC"
    canonical = F.when(topic, T.normalize_topic(F.col("name"))).otherwise(T.normalize_name(F.col("name")))
    fresh = resolved.where(F.col("candidate_id").isNull()).select(
        "match_key", "ordinal", "candidate_type", kind.alias("candidate_kind"), canonical.alias("canonical_name")
    )
    first = fresh.groupBy("match_key").agg(
        F.min_by(F.struct("candidate_type", "candidate_kind", "canonical_name"), "ordinal").alias("a"),
        F.min("ordinal").alias("created_seq"),
    )
    return first.select(
        new_id(F.col("match_key")).alias("candidate_id"), "match_key", "a.*",
        F.col("a.canonical_name").alias("display_name"), "created_seq", F.lit("ACTIVE").alias("status"),
    )


def new_id(match_key: Column) -> Column:
    return F.concat(F.lit("c"), F.substring(F.sha1(match_key), 1, 20))


def assign_ids(resolved: DataFrame) -> DataFrame:
    """Every mention gets its resolved or minted candidate id, without another join."""
    return resolved.withColumn("candidate_id", F.coalesce("candidate_id", new_id(F.col("match_key"))))


def observations(mentions: DataFrame, candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolved mentions enriched with candidate and source attributes."""
    dim = catalog.select("source_id", F.col("role").alias("source_role"), "family_primary", "family_secondary")
    cand = candidates.select("candidate_id", "canonical_name", F.col("match_key").alias("candidate_key"))
    df = mentions.join(F.broadcast(dim), "source_id").join(cand, "candidate_id", "left")
    item = F.coalesce(
        F.when(F.coalesce("source_item_id", F.lit("")) != "", F.col("source_item_id")),
        F.concat_ws(":", "source_id", F.coalesce("rank", F.lit(0)).cast("string"), "candidate_id"),
    )
    return df.withColumn("source_item_id", item)
