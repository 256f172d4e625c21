"""API payloads whose rows differ in shape, read in one pass as VARIANT values.

No schema is fixed: a field is asked for under each of its names in turn, as the type it should have.
Payloads that do not parse, and values of another type, are counted instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that the rows of the four surfaces use for one field, first choice first.
FIELDS = {
    "rank": ("int", ("$.rank", "$.position", "$.rank_index")),
    "title": ("string", ("$.hashtag_name", "$.song_name", "$.music_name", "$.creator_name", "$.video_desc", "$.title", "$.name")),
    "artist": ("string", ("$.artist_name", "$.author.nickname", "$.author_name")),
    "views": ("long", ("$.video_views", "$.stats.views", "$.vv")),
    "hashtags": ("array<string>", ("$.hashtags", "$.challenge.tags")),
}
LISTS = ("$.data.list", "$.list", "$.items")


def first_of(value: Column, paths: Sequence[str], kind: str) -> Column:
    """The first path that holds a value of the kind; empty strings count as absent."""
    found = [F.try_variant_get(value, p, kind) for p in paths]
    if kind == "string":
        found = [F.when(F.trim(f) != "", f) for f in found]
    return F.coalesce(*found)


def rows(payloads: DataFrame, body: str, keep: Sequence[str], fields: Mapping[str, tuple[str, Sequence[str]]] | None = None) -> DataFrame:
    """One row per list entry: ``keep``, ``position`` (from 1) and the fields; payloads that do not parse have none."""
    entries = F.coalesce(*[F.try_variant_get("_payload", p, "array<variant>") for p in LISTS])
    listed = payloads.withColumn("_payload", F.try_parse_json(body)).select(*keep, F.posexplode(entries).alias("_at", "_row"))
    return listed.select(*keep, (F.col("_at") + 1).alias("position"), *[
        first_of(F.col("_row"), paths, kind).alias(name) for name, (kind, paths) in (fields or FIELDS).items()])


def drift(payloads: DataFrame, body: str, by: str) -> DataFrame:
    """Per ``by``: payloads, those that do not parse, those without a list, and the shape that its entries have in common."""
    parsed = payloads.select(by, F.try_parse_json(body).alias("_payload"))
    entries = F.coalesce(*[F.try_variant_get("_payload", p, "array<variant>") for p in LISTS])
    parsed = parsed.withColumn("_entries", entries)
    counts = parsed.groupBy(by).agg(
        F.count("*").alias("payloads"), F.count(F.when(F.col("_payload").isNull(), 1)).alias("broken"),
        F.count(F.when(F.col("_payload").isNotNull() & F.col("_entries").isNull(), 1)).alias("without_list"))
    shapes = parsed.select(by, F.explode("_entries").alias("_row")).groupBy(by).agg(F.schema_of_variant_agg("_row").alias("shape"))
    return counts.join(shapes, by, "left")
