"""Typed relations between candidates mentioned together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.functions import text as T
from swellcast.functions.unicode import nfkc_each
from swellcast.operators.resolve import default_kind, key_by_kind_nf

RELATION_KEYS = ("src_id", "relation_type", "dst_id")
# Edges from a member to the node of its group.
VIA_TYPES = ("co_occurs_via", "about_via", "context_of")

# ``mentions``: candidate_id, candidate_type, name, source_id, source_item_id, rank, url,
# title, artist, show, from_title.


_TEXTS = ("name", "title", "artist", "show", "from_title")


def with_plain_texts(mentions: DataFrame) -> DataFrame:
    """The text columns NFKC-normalised in one pass (``p_name``, ``p_title``, ...)."""
    texts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in _TEXTS])
    df = mentions.withColumn("_plain", nfkc_each(texts))
    return df.withColumns({f"p_{c}": F.get("_plain", F.lit(i)) for i, c in enumerate(_TEXTS)}).drop("_plain")


def group_key() -> Column:
    """The item two mentions share: item id, else rank + url + title, else the surface.

    Expects the columns of :func:`with_plain_texts`.
    """
    rank = F.coalesce("rank", F.lit(0)).cast("string")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    surface = key_by_kind_nf(F.col("p_name"), default_kind(F.col("candidate_type")))
    return (
        F.when(~blank("source_item_id"), F.concat_ws(":", "source_id", "source_item_id"))
        .when(
            ~(blank("url") & blank("title")),
            F.concat_ws(":", "source_id", rank, F.coalesce("url", F.lit("")), T.match_key_nf(F.col("p_title"))),
        )
        .otherwise(F.concat_ws(":", "source_id", rank, surface))
    )


def _read_columns(mentions: DataFrame) -> DataFrame:
    """Distinct mentions with only those columns that the group key or a relation of their type reads; the others are null."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    kind, keyless = F.col("candidate_type"), blank("source_item_id")
    named = kind.isin("MUSIC_ARTIST", *dims.WORK_TYPES) | (keyless & blank("url") & blank("title"))
    person = kind.isin(*dims.PERSON_TYPES)
    return mentions.select(
        "candidate_id", "candidate_type", "source_id", "source_item_id", *[F.when(keyless, F.col(c)).alias(c) for c in ("rank", "url", "title")],
        F.when(named, F.col("name")).alias("name"), F.when(kind == "MUSIC_TRACK", F.col("artist")).alias("artist"),
        *[F.when(person, F.col(c)).alias(c) for c in ("show", "from_title")],
    ).distinct()


def group_items(mentions: DataFrame) -> DataFrame:
    """Distinct members of every item; repeats in a hot group vanish before their texts are cleaned and before any join.

    A key that no relation reads for the member's type is empty.
    """
    key = lambda c: T.match_key_nf(F.col(f"p_{c}"))
    known = with_plain_texts(_read_columns(mentions.where(F.coalesce("candidate_id", F.lit("")) != "")))
    kind = F.col("candidate_type")
    read = lambda when, c: F.when(when, key(c)).otherwise("")
    person = kind.isin(*dims.PERSON_TYPES)
    return known.select(
        group_key().alias("group_key"), "candidate_id", "candidate_type", "source_id",
        read(kind.isin("MUSIC_ARTIST", *dims.WORK_TYPES), "name").alias("name_key"), read(kind == "MUSIC_TRACK", "artist").alias("artist_key"),
        read(person, "show").alias("show_key"), read(person, "from_title").alias("title_key"),
    ).distinct()


def _both_ways(df: DataFrame, forward: Column, backward: Column, confidence: Column) -> DataFrame:
    source = F.concat(F.col("source_id"), F.lit(":shared_item"))
    edge = lambda s, t, d: F.struct(
        F.col(s).alias("src_id"), t.alias("relation_type"), F.col(d).alias("dst_id"), confidence.alias("confidence"),
        source.alias("source"),
    )
    edges = F.array(edge("a_id", forward, "b_id"), edge("b_id", backward, "a_id"))
    return df.select(F.explode(edges).alias("e")).select("e.*")


def music_relations(items: DataFrame) -> DataFrame:
    """Track and artist of one item when the track names the artist (equi-join)."""
    tracks = items.where((F.col("candidate_type") == "MUSIC_TRACK") & (F.col("artist_key") != "")).select(
        "group_key", F.col("artist_key").alias("name_key"), F.col("candidate_id").alias("a_id"), "source_id"
    )
    artists = items.where(F.col("candidate_type") == "MUSIC_ARTIST").select(
        "group_key", "name_key", F.col("candidate_id").alias("b_id")
    )
    joined = tracks.join(artists, ["group_key", "name_key"])
    return _both_ways(joined, F.lit("performed_by"), F.lit("performs"), F.lit(0.96))


def work_relations(items: DataFrame) -> DataFrame:
    """People of one item tied to the work they name, by show hint or title hint."""
    works = items.where(F.col("candidate_type").isin(*dims.WORK_TYPES)).select(
        "group_key", F.col("candidate_id").alias("b_id"), F.col("candidate_type").alias("work_type"), "name_key"
    )
    people = items.where(F.col("candidate_type").isin(*dims.PERSON_TYPES)).select(
        "group_key", F.col("candidate_id").alias("a_id"), "show_key", "title_key", "source_id"
    )
    by_show = people.where(F.col("show_key") != "").withColumnRenamed("show_key", "name_key").join(
        works, ["group_key", "name_key"]
    )
    by_title = people.where((F.col("title_key") != "") & (F.col("title_key") != F.col("show_key"))).withColumnRenamed(
        "title_key", "name_key"
    ).join(works, ["group_key", "name_key"])
    kind = F.when(F.col("work_type") == "REALITY_SHOW", "appears_in_reality_show").otherwise("features_in")
    return _both_ways(by_show, kind, F.lit("has_cast"), F.lit(0.87)).unionByName(
        _both_ways(by_title, F.lit("associated_with_work"), F.lit("references"), F.lit(0.42))
    )


def group_relations(items: DataFrame) -> DataFrame:
    """One edge per role of a member to its group's node, at every group size.

    Two topics co-occur, and a topic is about a context member, exactly when they share a
    node; :func:`related_ids` and :func:`already_related` read it so, by equi-join. The edges
    are linear in the members however hot a group is.
    """
    topic = default_kind(F.col("candidate_type")) == "TOPIC"
    about = F.when(F.col("candidate_type") == "HASHTAG", 0.84).otherwise(0.74)
    role = lambda when, name, confidence: F.when(when, F.struct(F.lit(name).alias("t"), confidence.alias("c")))
    roles = F.array_compact(F.array(
        role(topic, "co_occurs_via", F.lit(0.55)), role(topic, "about_via", about),
        role(F.col("candidate_type").isin(*dims.CONTEXT_TYPES), "context_of", F.lit(1.0)),
    ))
    return items.select(
        F.col("candidate_id").alias("src_id"), F.concat(F.lit("group:"), "group_key").alias("dst_id"),
        F.explode(roles).alias("r"), F.concat("source_id", F.lit(":shared_item")).alias("source"),
    ).select("src_id", F.col("r.t").alias("relation_type"), "dst_id", F.col("r.c").alias("confidence"), "source")


def build_relations(items: DataFrame) -> DataFrame:
    """Relations of the items of :func:`group_items`; store the items first, three branches read them."""
    return dedupe_relations(direct_relations(items).unionByName(group_relations(items)))


def direct_relations(items: DataFrame) -> DataFrame:
    """The edges between two candidates; some may repeat."""
    return music_relations(items).unionByName(work_relations(items))


def dedupe_relations(relations: DataFrame) -> DataFrame:
    """Keep the highest confidence per (source, type, destination)."""
    extra = [c for c in relations.columns if c not in (*RELATION_KEYS, "confidence")]
    return relations.groupBy(*RELATION_KEYS).agg(
        F.max("confidence").alias("confidence"),
        *[F.max_by(c, F.struct("confidence", c)).alias(c) for c in extra],
    )


def _memberships(relations: DataFrame) -> DataFrame:
    """Per (node, candidate): whether it is a topic and whether it is a context member."""
    via = relations.where(F.col("relation_type").isin(*VIA_TYPES))
    return via.groupBy(F.col("dst_id").alias("node"), F.col("src_id").alias("candidate_id")).agg(
        F.max(F.col("relation_type") != "context_of").alias("topic"), F.max(F.col("relation_type") == "context_of").alias("context"))


def related_in_items(items: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """:func:`related_ids` of the relations of stored ``items``, each kind of edge built only where it is read."""
    return _neighbours(direct_relations(items), _memberships(group_relations(items)), asked)


def related_ids(relations: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """One-hop neighbours as distinct (candidate, related) rows, candidates only.

    ``asked`` (candidate_id) limits the left side, so the output is bounded by the asked
    candidates times their groups; without it the output is every related pair, which in a
    group of n members is of the order of n squared.
    """
    return _neighbours(relations.where(~F.col("relation_type").isin(*VIA_TYPES)), _memberships(relations), asked)


def _neighbours(direct: DataFrame, members: DataFrame, asked: DataFrame | None) -> DataFrame:
    both = F.array(
        F.struct(F.col("src_id").alias("candidate_id"), F.col("dst_id").alias("related_id")),
        F.struct(F.col("dst_id").alias("candidate_id"), F.col("src_id").alias("related_id")),
    )
    near = direct.where(F.col("src_id") != F.col("dst_id")).select(F.explode(both).alias("r")).select("r.*")
    mine = members
    if asked is not None:
        asked = asked.select("candidate_id").distinct()
        near, mine = (df.join(asked, "candidate_id", "left_semi") for df in (near, members))
    other = members.select("node", F.col("candidate_id").alias("related_id"), F.col("topic").alias("o_topic"), F.col("context").alias("o_context"))
    shared = mine.join(other, "node").where(
        (F.col("candidate_id") != F.col("related_id")) & ((F.col("topic") & (F.col("o_topic") | F.col("o_context"))) | (F.col("context") & F.col("o_topic"))))
    return near.unionByName(shared.select("candidate_id", "related_id")).distinct()


def already_related(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """The pairs (left_id, right_id) that are related directly or share a group as topics or topic and context."""
    ends = pairs.select("left_id", "right_id").distinct()
    direct = relations.select(F.col("src_id").alias("left_id"), F.col("dst_id").alias("right_id"))
    flipped = direct.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))
    members = _memberships(relations)
    side = lambda s: members.select("node", F.col("candidate_id").alias(f"{s}_id"), F.col("topic").alias(f"{s}_topic"), F.col("context").alias(f"{s}_context"))
    grouped = ends.join(side("left"), "left_id").join(side("right"), ["right_id", "node"]).where(
        (F.col("left_topic") & (F.col("right_topic") | F.col("right_context"))) | (F.col("left_context") & F.col("right_topic")))
    return ends.join(direct.unionByName(flipped), ["left_id", "right_id"], "left_semi").unionByName(
        grouped.select("left_id", "right_id")).distinct()
