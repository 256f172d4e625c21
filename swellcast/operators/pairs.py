"""Look-alike candidate pairs, their decisions and manual edits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swellcast.functions import text as T
from swellcast.functions.unicode import nfkc_each, sequence_ratio
from swellcast.operators.resolve import key_by_kind

# --- Fixed values --------------------------------------------------------------------------
TOP_WINDOW = 200
MAX_PAIRS = 30
MAX_PAIRS_BACKFILL = 100
PRIORITY_MIN = 0.72
RATIO = 0.88
TOKENS = 0.67
FORBIDDEN_TYPES = (
    ("PERSON", "GROUP"), ("MUSIC_TRACK", "MUSIC_ARTIST"), ("SHOW", "WORK"), ("SHOW", "REALITY_SHOW"),
)
DECISIONS = ("merge", "link", "separate")

# ``candidates`` as in ``resolve`` plus related_ids, exclude_ids (arrays) and domain_class.


def pair_id(a: Column, b: Column) -> Column:
    return F.sha1(F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def _grams(key: Column, n: int) -> Column:
    count = F.length(key) - (n - 1)
    at = lambda i: F.substr(key, i, F.lit(n))
    none = F.array().cast("array<string>")
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), at)).otherwise(none)


def _numbered(grams: Column) -> Column:
    """Grams with the number of their occurrence, so a bag becomes a set."""
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g))))


def _rarest(exploded: DataFrame, node: list[str], item: str, keep: Column) -> DataFrame:
    """The ``keep`` items of each node that the fewest nodes of its kind hold."""
    count = exploded.groupBy("candidate_kind", item).agg(F.count("*").alias("_df"))
    w = Window.partitionBy(*node).orderBy("_df", item)
    return exploded.join(count, ["candidate_kind", item]).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= keep).drop("_df", "_at")


def _met(df: DataFrame, item: str, value: str) -> DataFrame:
    """(candidate_kind, a, b) of the different values that share an item, a < b."""
    a = df.select("candidate_kind", item, F.col(value).alias("a"))
    b = df.select("candidate_kind", item, F.col(value).alias("b"))
    return a.join(b, ["candidate_kind", item]).where("a < b").select("candidate_kind", "a", "b").distinct()


def _matching_bound(a: Column, b: Column) -> Column:
    """At most so many characters of ``a`` and ``b`` can match in order: those of the bag they share."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda acc, c: acc + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))


def near_names(names: DataFrame) -> DataFrame:
    """(candidate_kind, a, b, ab, ba): different compact names, a < b, whose ratio reaches RATIO one way or the other.

    A ratio r means that M = r T / 2 of the T characters match in order. Of a's bigrams at most
    2 (|a| - M) + (|b| - M) are then lost, which is never more than 3/7 of |a|: so the rarest
    floor(3 |a| / 7) + 1 bigrams of both names share one. What meets there is cut by lengths and by
    the bag of characters before the ratio itself is taken.
    """
    distinct = names.select("candidate_kind", "compact").distinct().where(F.length("compact") >= 2)
    grams = distinct.select("candidate_kind", "compact", F.explode(_numbered(_grams(F.col("compact"), 2))).alias("gram"))
    prefix = _rarest(grams, ["candidate_kind", "compact"], "gram", F.floor(F.length("compact") * 3 / 7) + 1)
    total, short = F.length("a") + F.length("b"), F.least(F.length("a"), F.length("b"))
    least = F.lit(100 * RATIO).cast("int") * total
    met = _met(prefix, "gram", "compact").where(200 * short >= least).where(200 * _matching_bound(F.col("a"), F.col("b")) >= least)
    return met.withColumn("ab", sequence_ratio(F.col("a"), F.col("b"))).withColumn("ba", sequence_ratio(F.col("b"), F.col("a"))).where(
        F.greatest("ab", "ba") >= RATIO)


def contained_names(names: DataFrame) -> DataFrame:
    """(candidate_kind, a, b): compact names of 5 characters and more inside others. A contained name asks with its rarest 3-gram."""
    distinct = names.select("candidate_kind", "compact").distinct().where(F.length("compact") >= 5)
    grams = distinct.select("candidate_kind", "compact", F.explode(F.array_distinct(_grams(F.col("compact"), 3))).alias("gram"))
    asks = _rarest(grams, ["candidate_kind", "compact"], "gram", F.lit(1)).select("candidate_kind", "gram", F.col("compact").alias("a"))
    return asks.join(grams.withColumnRenamed("compact", "b"), ["candidate_kind", "gram"]).where(
        (F.col("a") != F.col("b")) & F.col("b").contains(F.col("a"))).select("candidate_kind", "a", "b")


def overlapping_tokens(names: DataFrame) -> DataFrame:
    """(candidate_kind, a, b): different token sets (sorted, joined) that share TOKENS of their union, found on their rarest tokens."""
    distinct = names.select("candidate_kind", "token_key", "tokens").dropDuplicates(["candidate_kind", "token_key"])
    exploded = distinct.select("candidate_kind", "token_key", F.size("tokens").alias("_size"), F.explode("tokens").alias("token"))
    prefix = _rarest(exploded, ["candidate_kind", "token_key"], "token", F.col("_size") - F.ceil(F.col("_size") * TOKENS) + 1)
    return _met(prefix, "token", "token_key")


def shortlist(features: DataFrame, candidates: DataFrame, top_window: int | None = None) -> DataFrame:
    """The day's candidates (all, or the ``top_window`` best) with everything pairing needs."""
    top = features.select("candidate_id", "primary_score", "source_families", "lane")
    if top_window is not None:
        top = top.orderBy(F.desc("primary_score"), "candidate_id").limit(top_window)
    df = top.join(candidates, "candidate_id")
    name = F.when(F.coalesce("display_name", F.lit("")) != "", F.col("display_name")).otherwise(F.col("canonical_name"))
    aliases = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    plain = nfkc_each(aliases)
    alias_keys = F.when(
        F.col("candidate_kind") == "TOPIC", F.transform(plain, lambda a: T.topic_key_nf(a))
    ).otherwise(F.transform(plain, lambda a: T.match_key_nf(a)))
    df = df.withColumns({
        "name": name,
        "surface_key": key_by_kind(name, F.col("candidate_kind")),
        "compact": T.match_key(name),
        "alias_keys": F.filter(F.array_distinct(alias_keys), lambda k: k != ""),
        "tokens": F.filter(F.array_distinct(F.split(F.lower(T.normalize_name(name)), " ")), lambda t: t != ""),
    })
    return df.withColumn("token_key", F.array_join(F.array_sort("tokens"), " "))


def _conflict() -> Column:
    l, r = F.col("l.external_ids"), F.col("r.external_ids")
    return F.coalesce(
        F.exists(F.map_keys(l), lambda k: r[k].isNotNull() & (l[k] != r[k])), F.lit(False)
    )


def _guardrails() -> Column:
    lt, rt = F.col("l.candidate_type"), F.col("r.candidate_type")
    forbidden = F.lit(False)
    for a, b in FORBIDDEN_TYPES:
        forbidden = forbidden | ((lt == a) & (rt == b)) | ((lt == b) & (rt == a))
    listed = lambda side, other, col: F.coalesce(
        F.array_contains(f"{side}.{col}", F.col(f"{other}.candidate_id")), F.lit(False)
    )
    return (
        ~F.col("l.manual_lock") & ~F.col("r.manual_lock") & ~forbidden
        & ((F.col("l.candidate_kind") == "TOPIC") | (lt == rt))
        & ~_conflict()
        & ~listed("l", "r", "exclude_ids") & ~listed("r", "l", "exclude_ids")
        & ~listed("l", "r", "related_ids") & ~listed("r", "l", "related_ids")
    )


def look_alikes(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left_id, right_id) of the pairs that can reach the threshold, the better one left; and the near names.

    Without an equal key, shared alias, containment, near-equal spelling or token overlap the priority
    tops out at 0.45. Names are compared once each, however many candidates bear them; candidates only meet
    through equal keys or through a pair of names that is known to be alike.
    """
    near = near_names(s)
    members = s.select("candidate_kind", "candidate_id", "primary_score", "compact", "token_key")
    tag = lambda p, arr: F.transform(arr, lambda v: F.concat(F.lit(p), v))
    keys = F.concat(tag("k:", F.array("surface_key", "compact")), tag("a:", F.col("alias_keys")), tag("t:", F.array("token_key")))
    keyed = s.select("candidate_kind", "candidate_id", "primary_score",
                     F.explode(F.array_distinct(F.filter(keys, lambda v: F.length(v) > 2))).alias("key"))

    def borne(pairs: DataFrame, by: str) -> DataFrame:
        side = lambda x: members.select("candidate_kind", F.col(by).alias(x), F.struct("candidate_id", "primary_score").alias(f"_{x}"))
        return pairs.select("candidate_kind", "a", "b").join(side("a"), ["candidate_kind", "a"]).join(side("b"), ["candidate_kind", "b"]).select("_a", "_b")

    whole = F.struct("candidate_id", "primary_score")
    equal = keyed.select("candidate_kind", "key", whole.alias("_a")).join(keyed.select("candidate_kind", "key", whole.alias("_b")), ["candidate_kind", "key"]).where(
        "_a.candidate_id < _b.candidate_id").select("_a", "_b")
    met = equal.unionByName(borne(near, "compact")).unionByName(borne(contained_names(s), "compact")).unionByName(
        borne(overlapping_tokens(s), "token_key"))
    first = (F.col("_a.primary_score") > F.col("_b.primary_score")) | (
        (F.col("_a.primary_score") == F.col("_b.primary_score")) & (F.col("_a.candidate_id") < F.col("_b.candidate_id")))
    pick = lambda x, y: F.when(first, F.col(f"{x}.candidate_id")).otherwise(F.col(f"{y}.candidate_id"))
    return met.select(pick("_a", "_b").alias("left_id"), pick("_b", "_a").alias("right_id")).distinct(), near


def unresolved_pairs(
    features: DataFrame, candidates: DataFrame, top_window: int | None = None, max_pairs: int | None = None, folder: str | None = None,
) -> DataFrame:
    """The look-alike pairs among the day's candidates: all, or the ``max_pairs`` best of the ``top_window`` best.

    ``folder`` (shared by all executors) is where the shortlist and the names that are alike are stored, since
    several joins read them; without one they are computed for each.
    """
    def kept(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return df
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    s = kept(shortlist(features, candidates, top_window), "shortlist")
    ids, near = look_alikes(s)
    near = kept(near, "near")
    p = (
        ids.join(s.alias("l"), F.col("left_id") == F.col("l.candidate_id"))
        .join(s.alias("r"), F.col("right_id") == F.col("r.candidate_id"))
        .where(_guardrails())
    )
    # The ratio of two names in the order that the pair has them; names that are not near have none.
    ratios = near.select("candidate_kind", F.explode(F.array(
        F.struct(F.col("a").alias("left_compact"), F.col("b").alias("right_compact"), F.col("ab").alias("ratio")),
        F.struct(F.col("b").alias("left_compact"), F.col("a").alias("right_compact"), F.col("ba").alias("ratio")))).alias("r")).select("candidate_kind", "r.*")
    lc, rc = F.col("l.compact"), F.col("r.compact")
    union = F.size(F.array_union("l.tokens", "r.tokens"))
    cheap = p.select(
        "left_id", "right_id", F.col("l.candidate_kind").alias("candidate_kind"), lc.alias("left_compact"), rc.alias("right_compact"),
        F.col("l.name").alias("left_name"), F.col("r.name").alias("right_name"),
        ((F.col("l.surface_key") == F.col("r.surface_key")) & (F.col("l.surface_key") != "")).alias("same_key"),
        F.arrays_overlap("l.alias_keys", "r.alias_keys").alias("alias_overlap"),
        ((F.least(F.length(lc), F.length(rc)) >= 5) & (lc.contains(rc) | rc.contains(lc))).alias("contains"),
        (F.when(union > 0, F.size(F.array_intersect("l.tokens", "r.tokens")) / union).otherwise(0.0) >= TOKENS).alias("tokens"),
        F.arrays_overlap("l.source_families", "r.source_families").alias("family"),
        (F.col("l.lane") == F.col("r.lane")).alias("lane"),
        (F.col("l.domain_class") == F.col("r.domain_class")).alias("domain"),
        F.least(F.lit(0.2), (F.col("l.primary_score") + F.col("r.primary_score")) * 0.02).alias("bonus"),
    )
    scored = cheap.join(ratios, ["candidate_kind", "left_compact", "right_compact"], "left").withColumn(
        "ratio", F.when(F.col("left_compact") == F.col("right_compact"), 1.0).otherwise(F.coalesce("ratio", F.lit(0.0))))
    parts = [
        ("same_key", "exact_match_key", 1.1), ("alias_overlap", "alias_overlap", 0.95), ("contains", "surface_contains", 0.45),
        ("near", "sequence_ratio", 0.55), ("tokens", "token_overlap", 0.35), ("family", "shared_family", 0.12),
        ("lane", "shared_lane", 0.08), ("domain", "shared_domain", 0.05),
    ]
    scored = scored.withColumn("near", F.col("ratio") >= RATIO)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    priority = sum((F.when(flag(c), v).otherwise(0.0) for c, _, v in parts), F.lit(0.0)) + F.col("bonus")
    reasons = F.filter(F.array(*[F.when(flag(c), F.lit(n)) for c, n, _ in parts]), lambda r: r.isNotNull())
    support = (
        flag("same_key").cast("int") + flag("alias_overlap").cast("int") + (F.col("ratio") >= 0.95).cast("int")
    )
    out = scored.select(
        pair_id(F.col("left_id"), F.col("right_id")).alias("pair_id"), "left_id", "right_id", "left_name", "right_name",
        priority.alias("raw_priority"), reasons.alias("reasons"), support.alias("support_count"),
    ).where(F.col("raw_priority") >= PRIORITY_MIN)
    out = out.withColumn("priority", F.round("raw_priority", 4)).withColumn(
        "merge_recommended", F.col("support_count") > 0).drop("raw_priority")
    return out if max_pairs is None else out.orderBy(F.desc("priority"), "left_id", "right_id").limit(max_pairs)


def surface_signature(prefix: str) -> Column:
    c = lambda n: F.trim(F.coalesce(F.col(f"{prefix}_{n}"), F.lit("")))
    return F.concat_ws("|", c("type"), c("kind"), F.lower(c("name")), c("domain"))


def decision_cache_key(prompt_version: str) -> Column:
    a, b = surface_signature("left"), surface_signature("right")
    return F.sha1(F.concat_ws("|", F.lit(prompt_version), F.least(a, b), F.greatest(a, b)))


def lookup_decisions(pairs: DataFrame, cache: DataFrame, prompt_version: str) -> tuple[DataFrame, DataFrame]:
    """Cached decisions of pairs, and the queue of pairs an external judge must see."""
    keyed = pairs.withColumn("cache_key", decision_cache_key(prompt_version))
    clean = F.lower(F.trim(F.coalesce("decision", F.lit("unknown"))))
    rows = cache.select(
        "cache_key", F.when(clean.isin(*DECISIONS), clean).otherwise("unknown").alias("decision"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"),
    )
    return keyed.join(rows, "cache_key"), keyed.join(rows, "cache_key", "left_anti")


def apply_decisions(pairs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decided pairs with their final action, and the relations they imply (both ways)."""
    df = pairs.join(decisions.select("pair_id", "decision", "confidence"), "pair_id")
    d = F.lower(F.trim("decision"))
    action = (
        F.when((d == "merge") & (F.col("support_count") > 0), "MERGE_RECOMMENDED")
        .when(d == "link", "LINK_ONLY").otherwise("NONE")
    )
    queue = df.withColumn("decision", d).withColumn("final_action", action)
    kind = F.when(F.col("final_action") == "MERGE_RECOMMENDED", "possible_duplicate").otherwise("llm_link_only")
    edge = lambda a, b: F.struct(
        F.col(a).alias("src_id"), kind.alias("relation_type"), F.col(b).alias("dst_id"), F.col("confidence").alias("confidence")
    )
    relations = queue.where(F.col("final_action") != "NONE").select(
        F.explode(F.array(edge("left_id", "right_id"), edge("right_id", "left_id"))).alias("e")
    ).select("e.*")
    return queue, relations


# --- manual edits ----------------------------------------------------------------------------------

# ``edits``: edit_id, left_id, right_id, action (merge / link / separate), winner_id,
# decided_at (orderable), decided_by.


def ready_edits(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits that are the earliest open one of both their candidates, and the rest.

    Edits that share a candidate must apply in order, so each round takes the ready
    ones; the number of rounds is the longest queue of one candidate.
    """
    sides = edits.select("edit_id", "decided_at", F.explode(F.array("left_id", "right_id")).alias("candidate_id"))
    w = Window.partitionBy("candidate_id").orderBy("decided_at", "edit_id")
    first = sides.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).groupBy("edit_id").agg(
        F.count("*").alias("_c")
    ).where(F.col("_c") == 2).select("edit_id")
    return edits.join(first, "edit_id", "left_semi"), edits.join(first, "edit_id", "left_anti")


def _merged_aliases() -> Column:
    """Names of both sides without the winner's canonical name, first spelling wins."""
    none = F.array().cast("array<string>")
    names = F.concat(
        F.array("canonical_name", "display_name"), F.coalesce("aliases", none),
        F.array("o_canonical_name", "o_display_name"), F.coalesce("o_aliases", none),
    )
    normal = F.transform(nfkc_each(names), lambda n: T.normalize_name_nf(n))

    def distinct_names(ns: Column) -> Column:
        # The first name is the winner's canonical one.
        keys = F.transform(ns, lambda n: F.lower(n))
        return F.filter(
            ns,
            lambda n, i: (n != "") & (F.lower(n) != F.element_at(keys, 1))
            & (F.array_position(keys, F.lower(n)) == i + 1),
        )

    return T.let(normal, distinct_names)


def apply_edits(edits: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of conflict-free edits: the updated candidates and the manual relations."""
    side = lambda me, other: F.struct(
        F.col(me).alias("candidate_id"), F.col(other).alias("other_id"), "action", "decided_at", "decided_by",
        (F.coalesce("winner_id", "left_id") == F.col(me)).alias("wins"),
    )
    touched = edits.select(F.explode(F.array(side("left_id", "right_id"), side("right_id", "left_id"))).alias("s")).select("s.*")
    cols = ("canonical_name", "display_name", "aliases", "related_ids", "external_ids", "merged_from")
    other = candidates.select(F.col("candidate_id").alias("other_id"), *[F.col(c).alias(f"o_{c}") for c in cols])
    df = touched.join(candidates, "candidate_id").join(other, "other_id")
    none = F.array().cast("array<string>")
    arr = lambda c: F.coalesce(F.col(c), none)
    ids = F.array("candidate_id", "other_id")
    merge, link, separate = (F.col("action") == a for a in DECISIONS)
    wins, loses = merge & F.col("wins"), merge & ~F.col("wins")
    empty_map = F.create_map().cast("map<string,string>")
    pick = lambda cond, new, old: F.when(cond, new).otherwise(F.col(old))
    related = (
        F.when(wins, F.array_sort(F.array_except(F.array_union(arr("related_ids"), arr("o_related_ids")), ids)))
        .when(link, F.array_sort(F.array_union(arr("related_ids"), F.array("other_id"))))
        .otherwise(F.col("related_ids"))
    )
    updated = df.select(
        "candidate_id", "candidate_type", "candidate_kind", "canonical_name", "display_name",
        pick(wins, _merged_aliases(), "aliases").alias("aliases"),
        F.when(loses, "MERGED").otherwise(F.col("status")).alias("status"),
        pick(
            wins,
            F.map_concat(F.coalesce("o_external_ids", empty_map), F.coalesce("external_ids", empty_map)),
            "external_ids",
        ).alias("external_ids"),
        (F.col("manual_lock") | merge).alias("manual_lock"),
        "created_seq", related.alias("related_ids"),
        pick(separate, F.array_sort(F.array_union(arr("exclude_ids"), F.array("other_id"))), "exclude_ids").alias("exclude_ids"),
        pick(wins, F.array_sort(F.array_union(arr("merged_from"), F.array("other_id"))), "merged_from").alias("merged_from"),
        pick(loses, F.col("other_id"), "merged_into").alias("merged_into"),
        F.col("decided_at").alias("last_edit_at"), F.col("decided_by").alias("last_edit_by"),
    )
    relations = touched.where(F.col("action") == "link").select(
        F.col("candidate_id").alias("src_id"), F.lit("manual_related").alias("relation_type"),
        F.col("other_id").alias("dst_id"), F.lit(1.0).alias("confidence"),
    )
    return updated, relations


def apply_all_edits(edits: DataFrame, candidates: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Apply every edit in order, one conflict-free round at a time.

    Rounds are as many as one candidate has edits. Each round's tables are written below
    ``folder`` (shared by all executors), so the plan does not grow and a lost executor
    does not replay earlier rounds.
    """
    spark = edits.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}-{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    edits, relations = kept(edits, "edits"), None
    while not edits.isEmpty():
        ready, later = ready_edits(edits)
        updated, links = apply_edits(ready, candidates)
        candidates = kept(overlay(candidates, updated), "candidates")
        links = kept(links, "links")
        relations = links if relations is None else relations.unionByName(links)
        edits = kept(later, "edits")
    if relations is None:
        relations = apply_edits(edits, candidates)[1]
    return candidates, relations


def overlay(candidates: DataFrame, updated: DataFrame) -> DataFrame:
    """Candidates with the updated rows in place of the old ones."""
    cols = candidates.columns
    return candidates.join(updated.select("candidate_id"), "candidate_id", "left_anti").unionByName(
        updated.select(*[c for c in updated.columns if c in cols]), allowMissingColumns=True
    )


def change_log(before: DataFrame, after: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Before and after of every row that differs."""
    cols = [c for c in after.columns if c != key and c in before.columns]
    row = lambda p: F.to_json(F.struct(*[F.col(f"{p}.{c}").alias(c) for c in cols]))
    joined = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"))
    df = joined.select(F.col(f"a.{key}").alias(key), row("b").alias("before"), row("a").alias("after"))
    return df.where(F.col("before") != F.col("after")).withColumn(
        "document_path", F.concat(F.lit("candidates/"), F.col(key))
    )
