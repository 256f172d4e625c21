"""Registered queries: resolution, relations, health, tables, streaming."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.operators import anomaly as AN
from swellcast.operators import health, labels, pairs, ranking, relations, resolve
from swellcast.plans import events as P
from swellcast.plans import oracle_events as O
from swellcast.plans import sqltext as S
from swellcast.plans import stages
from swellcast.plans.queries_learning import labels_cte
from swellcast.plans.shared import joined, r6
from swellcast.plans.stages import new_path
from swellcast.session import spread
from swellcast.sources import bindings as B
from swellcast.sources import catalog as K
from swellcast.sources import tables as TB
from swellcast.streaming import anomaly as SA
from swellcast.streaming import upserts as SU

QUERIES = {}
ORACLES = {}
_RUN = itertools.count()


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# --- resolution --------------------------------------------------------------------------------

_PART_TYPES = ("PRODUCT", "BRAND", "MUSIC_TRACK", "PHRASE")
_CANDS = f"""
cands AS (
  SELECT 'c' || min(p_partkey) AS candidate_id, {S.pick(_PART_TYPES, 'min(p_partkey) % 4')} AS candidate_type, p_name AS canonical_name,
    p_brand AS brand, min(p_partkey) AS created_seq, min(p_partkey) % 11 <> 0 AS active, min(p_partkey) % 7 = 0 AS locked
  FROM part GROUP BY p_name, p_brand),
aliases AS (
  SELECT candidate_id, candidate_type, created_seq, 0 AS pos, canonical_name AS alias FROM cands WHERE active
  UNION ALL SELECT candidate_id, candidate_type, created_seq, 1, canonical_name || ' ' || brand FROM cands WHERE active),
keyed AS (SELECT *, CASE WHEN candidate_type IN ('PRODUCT', 'PHRASE') THEN {S.key_of(S.norm_topic('alias'))} ELSE {S.match_key('alias')} END AS match_key FROM aliases),
aidx AS (SELECT match_key, arg_max(candidate_id, created_seq * 10 + pos) AS candidate_id FROM keyed GROUP BY ALL)
"""
_MENTION = f"""
ment AS (
  SELECT l_orderkey * 100 + l_linenumber * 10 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal,
    l_partkey, CASE l_partkey % 3 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN upper(p_name) || '!' ELSE p_name || ' x' || (l_partkey % 5) END AS name,
    {S.pick(_PART_TYPES, 'l_suppkey % 4')} AS candidate_type, CASE WHEN l_suppkey % 10 = 0 THEN 'c' || l_partkey END AS ext
  FROM lineitem JOIN part ON p_partkey = l_partkey),
mkey AS (SELECT *, CASE WHEN candidate_type IN ('PRODUCT', 'PHRASE') THEN {S.key_of(S.norm_topic('name'))} ELSE {S.match_key('name')} END AS match_key FROM ment),
res AS (
  SELECT m.*, c.candidate_id AS by_ext, a.candidate_id AS by_alias, t.locked, t.canonical_name, t.brand
  FROM mkey m LEFT JOIN cands c ON c.candidate_id = m.ext AND c.active LEFT JOIN aidx a USING (match_key) LEFT JOIN cands t ON t.candidate_id = a.candidate_id),
resolved AS (
  SELECT *, CASE WHEN by_ext IS NOT NULL THEN by_ext WHEN by_alias IS NOT NULL AND (NOT locked OR lower(trim(name)) IN (lower(canonical_name), lower(canonical_name || ' ' || brand))) THEN by_alias END AS candidate_id
  FROM res)
"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (part name, brand) as candidates with one alias and one external id."""
    p = B.table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k"))
    ctype = B._pick(_PART_TYPES, F.col("k") % 4)
    cid = F.concat(F.lit("c"), "k")
    return p.select(
        cid.alias("candidate_id"), ctype.alias("candidate_type"), resolve.default_kind(ctype).alias("candidate_kind"),
        F.col("p_name").alias("canonical_name"), F.col("p_name").alias("display_name"),
        F.array(F.concat_ws(" ", "p_name", "p_brand")).alias("aliases"),
        F.when(F.col("k") % 11 != 0, "ACTIVE").otherwise("BLOCKED").alias("status"),
        F.create_map(F.lit("part"), cid).alias("external_ids"), (F.col("k") % 7 == 0).alias("manual_lock"),
        F.col("k").alias("created_seq"), F.array().cast("array<string>").alias("related_ids"),
        F.array().cast("array<string>").alias("exclude_ids"), F.array().cast("array<string>").alias("merged_from"),
        F.lit(None).cast("string").alias("merged_into"), F.lit("CONSUMER_CULTURE").alias("domain_class"),
    )


def _part_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    k = F.col("l_partkey")
    name = (
        F.when(k % 3 == 0, F.concat_ws(" ", "p_name", "p_brand")).when(k % 3 == 1, F.concat(F.upper("p_name"), F.lit("!")))
        .otherwise(F.concat(F.col("p_name"), F.lit(" x"), k % 5))
    )
    return li.withColumn(
        "ordinal", F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.row_number().over(w)
    ).join(part, "l_partkey").select(
        "ordinal", "l_partkey", name.alias("name"), B._pick(_PART_TYPES, F.col("l_suppkey") % 4).alias("candidate_type"),
        F.when(F.col("l_suppkey") % 10 == 0, F.create_map(F.lit("part"), F.concat(F.lit("c"), "l_partkey"))).alias("external_ids"),
    )


@query("alias_index", f"WITH {_CANDS} SELECT match_key, candidate_id FROM aidx")
def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.alias_index(resolve.alias_records(_candidates(spark, sf_dir)))


@query("resolve_mentions", f"WITH {_CANDS}, {_MENTION} SELECT ordinal, l_partkey, name, match_key, candidate_id FROM resolved")
def resolve_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = resolve.resolve(_part_mentions(spark, sf_dir), _candidates(spark, sf_dir))
    return df.select("ordinal", "l_partkey", "name", "match_key", "candidate_id")


@query("mint_candidates", f"""WITH {_CANDS}, {_MENTION}
SELECT 'c' || left(sha1(match_key), 20) AS candidate_id, match_key, arg_min(candidate_type, ordinal) AS candidate_type, min(ordinal) AS created_seq,
  arg_min(CASE WHEN candidate_type IN ('PRODUCT', 'PHRASE') THEN {S.norm_topic('name')} ELSE {S.norm_name('name')} END, ordinal) AS canonical_name
FROM resolved WHERE candidate_id IS NULL GROUP BY match_key""")
def mint_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = resolve.resolve(_part_mentions(spark, sf_dir), _candidates(spark, sf_dir))
    return resolve.mint(df).select("candidate_id", "match_key", "candidate_type", "created_seq", "canonical_name")


_COM_TYPES = ("MUSIC_TRACK", "MUSIC_ARTIST", "SHOW", "PERSON", "HASHTAG", "PHRASE", "REALITY_SHOW", "PRODUCT")
_COM = f"""
m0 AS (
  SELECT DISTINCT 'LI:' || l_orderkey AS g, 'part' || l_partkey AS id, {S.pick(_COM_TYPES, 'l_partkey % 8')} AS t, 'n' || (l_partkey % 40) AS name,
    'n' || (l_suppkey % 40) AS hint FROM lineitem),
mus AS (SELECT a.id AS a, b.id AS b FROM m0 a JOIN m0 b ON a.g = b.g AND a.hint = b.name WHERE a.t = 'MUSIC_TRACK' AND b.t = 'MUSIC_ARTIST'),
wrk AS (SELECT p.id AS a, w.id AS b, w.t FROM m0 p JOIN m0 w ON p.g = w.g AND p.hint = w.name WHERE p.t IN ('PERSON', 'MUSIC_ARTIST') AND w.t IN ('SHOW', 'REALITY_SHOW')),
tp AS (SELECT DISTINCT g, id, t FROM m0 WHERE {S.one_of('t', dims.TOPIC_TYPES)}),
cx AS (SELECT DISTINCT g, id FROM m0 WHERE {S.one_of('t', dims.CONTEXT_TYPES)}),
direct AS (
  SELECT a AS src_id, 'performed_by' AS relation_type, b AS dst_id, 0.96 AS c FROM mus UNION ALL SELECT b, 'performs', a, 0.96 FROM mus
  UNION ALL SELECT a, CASE WHEN t = 'REALITY_SHOW' THEN 'appears_in_reality_show' ELSE 'features_in' END, b, 0.87 FROM wrk
  UNION ALL SELECT b, 'has_cast', a, 0.87 FROM wrk),
e AS (
  SELECT * FROM direct UNION ALL SELECT id, 'co_occurs_via', 'group:' || g, 0.55 FROM tp
  UNION ALL SELECT id, 'about_via', 'group:' || g, CASE WHEN t = 'HASHTAG' THEN 0.84 ELSE 0.74 END FROM tp
  UNION ALL SELECT id, 'context_of', 'group:' || g, 1.0 FROM cx),
rel AS (SELECT src_id, relation_type, dst_id, CAST(max(c) AS DOUBLE) AS confidence FROM e GROUP BY ALL),
near AS (
  SELECT src_id AS candidate_id, dst_id AS related_id FROM direct UNION SELECT dst_id, src_id FROM direct
  UNION SELECT tp.id, cx.id FROM tp JOIN cx USING (g) UNION SELECT cx.id, tp.id FROM tp JOIN cx USING (g)
  UNION SELECT x.id, y.id FROM tp x JOIN tp y USING (g))
"""
#: The same mentions in large groups: one per supplier instead of one per order.
_HOT = _COM.replace("l_orderkey", "l_suppkey")


def _comentions(spark: SparkSession, sf_dir: str, group: str = "l_orderkey") -> DataFrame:
    k, hint = F.col("l_partkey"), F.concat(F.lit("n"), F.col("l_suppkey") % 40)
    t = B._pick(_COM_TYPES, k % 8)
    return spread(B.table(spark, sf_dir, "lineitem")).select(
        F.concat(F.lit("part"), "l_partkey").alias("candidate_id"), t.alias("candidate_type"),
        F.concat(F.lit("n"), k % 40).alias("name"), F.lit("LI").alias("source_id"),
        F.col(group).cast("string").alias("source_item_id"), F.lit(1).alias("rank"), F.lit("").alias("url"),
        F.lit("").alias("title"), hint.alias("artist"), hint.alias("show"), F.lit("").alias("from_title"),
    )


def _items(spark: SparkSession, sf_dir: str, group: str = "l_orderkey") -> DataFrame:
    """The members of all groups, stored once for every reader."""
    return stages.stage(spark, sf_dir, f"items_{group}", lambda: relations.group_items(_comentions(spark, sf_dir, group)))


@query("comention_relations", f"WITH {_COM} SELECT src_id, relation_type, dst_id, confidence FROM rel")
def comention_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.build_relations(_items(spark, sf_dir)).select(*relations.RELATION_KEYS, "confidence")


@query("related_ids", f"WITH {_COM} SELECT candidate_id, related_id FROM near WHERE candidate_id <> related_id")
def related_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.related_in_items(_items(spark, sf_dir))


@query("supplier_relations", f"WITH {_HOT} SELECT src_id, relation_type, dst_id, confidence FROM rel")
def supplier_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same representation where a group has hundreds of members."""
    return relations.build_relations(_items(spark, sf_dir, "l_suppkey")).select(*relations.RELATION_KEYS, "confidence")


@query("related_of_asked", f"""WITH {_HOT} SELECT candidate_id, related_id FROM near
WHERE candidate_id <> related_id AND CAST(substr(candidate_id, 5) AS BIGINT) % 50 = 0""")
def related_of_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every fiftieth part among large groups."""
    asked = B.table(spark, sf_dir, "part").where(F.col("p_partkey") % 50 == 0).select(F.concat(F.lit("part"), "p_partkey").alias("candidate_id"))
    return relations.related_in_items(_items(spark, sf_dir, "l_suppkey"), asked)


def _pair_inputs(spark: SparkSession, sf_dir: str):
    """All part candidates scored by revenue; names repeat across brands, so many look alike."""
    # Four id providers: two candidates of one provider carry different ids and conflict.
    cands = _candidates(spark, sf_dir).withColumn(
        "external_ids", F.create_map(F.concat(F.lit("p"), F.col("created_seq") % 4), "candidate_id")
    )
    li = B.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("c"), "l_partkey").alias("candidate_id")).agg(
        F.round(F.sum("l_extendedprice") / 1e6, 6).alias("primary_score")
    )
    feats = cands.join(li, "candidate_id").select(
        "candidate_id", "primary_score", F.array(F.lit("COMMERCE")).alias("source_families"),
        F.lit("style_products").alias("lane"),
    )
    return feats, cands


def _block(a: str, b: str) -> str:
    """The longest common block of two strings, the first in ``a``, then in ``b``, as (k, -i, -j)."""
    k = f"list_max(list_filter(range(0, least(length({a}) - i, length({b}) - j) + 2), lambda n: substr({a}, i, n) = substr({b}, j, n)))"
    at = f"[{{'k': {k}, 'i': -i, 'j': -j}} for j in range(1, length({b}) + 1)]"
    return f"list_max(flatten([{at} for i in range(1, length({a}) + 1)]))"


# Every pair of names and of candidates is compared; nothing is blocked.
_LOOK_ALIKE = f"""{_CANDS},
named AS (
  SELECT c.*, s.score, canonical_name || ' ' || brand AS alias, {S.key_of(S.norm_topic('canonical_name'))} AS surface, {S.match_key('canonical_name')} AS compact,
    {S.key_of(S.norm_topic("canonical_name || ' ' || brand"))} AS alias_key, list_distinct(string_split(lower(canonical_name), ' ')) AS tokens
  FROM cands c JOIN (SELECT 'c' || l_partkey AS candidate_id, round(sum(l_extendedprice) / 1e6, 6) AS score FROM lineitem GROUP BY ALL) s USING (candidate_id)
  WHERE candidate_type IN ('PRODUCT', 'PHRASE')),
spelled AS (SELECT DISTINCT x.compact AS na, y.compact AS nb FROM named x, named y WHERE x.compact <> y.compact),
matched AS (
  SELECT na, nb, na AS a, nb AS b, {_block('na', 'nb')} AS m FROM spelled
  UNION ALL
  SELECT na, nb, x.a, x.b, {_block('x.a', 'x.b')} FROM (
    SELECT na, nb, unnest([{{'a': substr(a, 1, -m.i - 1), 'b': substr(b, 1, -m.j - 1)}}, {{'a': substr(a, -m.i + m.k), 'b': substr(b, -m.j + m.k)}}]) AS x FROM matched WHERE m.k > 0)
  WHERE length(x.a) > 0 AND length(x.b) > 0),
ratios AS (SELECT na, nb, 2.0 * sum(m.k) / (length(na) + length(nb)) AS ratio FROM matched GROUP BY na, nb),
paired AS (
  SELECT l.candidate_id AS left_id, r.candidate_id AS right_id, l.surface = r.surface AS same_key,
    len(list_intersect([l.surface, l.alias_key], [r.surface, r.alias_key])) > 0 AS alias_overlap,
    least(length(l.compact), length(r.compact)) >= 5 AND (contains(l.compact, r.compact) OR contains(r.compact, l.compact)) AS contains_,
    CASE WHEN l.compact = r.compact THEN 1.0 ELSE coalesce(q.ratio, 0.0) END AS ratio,
    len(list_intersect(l.tokens, r.tokens)) / len(list_distinct(list_concat(l.tokens, r.tokens))) >= 0.67 AS tokens,
    least({O.d(0.2)}, (l.score + r.score) * {O.d(0.02)}) AS bonus
  FROM named l JOIN named r ON (l.score > r.score OR (l.score = r.score AND l.candidate_id < r.candidate_id))
    AND NOT l.locked AND NOT r.locked AND l.created_seq % 4 <> r.created_seq % 4
  LEFT JOIN ratios q ON q.na = l.compact AND q.nb = r.compact),
judged AS (
  SELECT *, {' + '.join(f"CASE WHEN {c} THEN {O.d(v)} ELSE {O.d(0.0)} END" for c, v in (
      ("same_key", 1.1), ("alias_overlap", 0.95), ("contains_", 0.45), ("ratio >= 0.88", 0.55), ("tokens", 0.35)))}
    + {O.d(0.12)} + {O.d(0.08)} + {O.d(0.05)} + bonus AS priority,
    list_filter([CASE WHEN same_key THEN 'exact_match_key' END, CASE WHEN alias_overlap THEN 'alias_overlap' END, CASE WHEN contains_ THEN 'surface_contains' END,
      CASE WHEN ratio >= 0.88 THEN 'sequence_ratio' END, CASE WHEN tokens THEN 'token_overlap' END, 'shared_family', 'shared_lane', 'shared_domain'], lambda x: x IS NOT NULL) AS reasons,
    CAST(same_key AS INT) + CAST(alias_overlap AS INT) + CAST(ratio >= 0.95 AS INT) AS support_count
  FROM paired),
alike AS (SELECT *, sha1(least(left_id, right_id) || '|' || greatest(left_id, right_id)) AS pair_id FROM judged WHERE priority >= 0.72)
"""


@query("unresolved_pairs", f"""WITH RECURSIVE {_LOOK_ALIKE}
SELECT pair_id, left_id, right_id, {O.round4('priority')} AS priority, array_to_string(reasons, ',') AS reasons, support_count FROM alike""")
def unresolved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All look-alike pairs; names are compared through rare bigrams, 3-grams and tokens."""
    out = pairs.unresolved_pairs(*_pair_inputs(spark, sf_dir), folder=new_path(spark, f"pairs-{next(_RUN)}", sf_dir))
    return out.select("pair_id", "left_id", "right_id", r6("priority"), joined("reasons"), "support_count")


@query("top_unresolved_pairs", f"""WITH RECURSIVE {_LOOK_ALIKE},
shown AS (SELECT candidate_id FROM (SELECT 'c' || l_partkey AS candidate_id, round(sum(l_extendedprice) / 1e6, 6) AS score FROM lineitem GROUP BY ALL)
  SEMI JOIN cands USING (candidate_id) ORDER BY score DESC, candidate_id LIMIT {pairs.TOP_WINDOW})
SELECT pair_id, left_id, right_id, {O.round4('priority')} AS priority, support_count FROM (
  SELECT *, row_number() OVER (ORDER BY {O.round4('priority')} DESC, left_id, right_id) AS place FROM alike
  WHERE left_id IN (SELECT candidate_id FROM shown) AND right_id IN (SELECT candidate_id FROM shown)) WHERE place <= {pairs.MAX_PAIRS_BACKFILL}""")
def top_unresolved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view an editor works through: the best pairs of the best candidates."""
    out = pairs.unresolved_pairs(
        *_pair_inputs(spark, sf_dir), top_window=pairs.TOP_WINDOW, max_pairs=pairs.MAX_PAIRS_BACKFILL,
        folder=new_path(spark, f"pairs-{next(_RUN)}", sf_dir))
    return out.select("pair_id", "left_id", "right_id", r6("priority"), "support_count")


_PAIRS_SQL = """
pr AS (SELECT 'c' || a.p_partkey AS left_id, 'c' || b.p_partkey AS right_id, (a.p_partkey // 2) % 3 AS support_count
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 2 = 0),
pid AS (SELECT *, sha1(least(left_id, right_id) || '|' || greatest(left_id, right_id)) AS pair_id FROM pr),
dec AS (SELECT pair_id, ['merge', 'link', 'separate', 'unknown'][ascii(pair_id) % 4 + 1] AS decision, (ascii(pair_id) % 10) / 10 AS confidence FROM pid)
"""


def _decided_pairs(spark: SparkSession, sf_dir: str):
    """All parts two by two, each even key with the next one."""
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    cid = F.concat(F.lit("c"), "key")
    right = part.select((F.col("key") - 1).alias("key"), cid.alias("right_id"))
    p = part.where("key % 2 = 0").withColumn("left_id", cid).join(right, "key").select(
        "left_id", "right_id", (F.floor(F.col("key") / 2) % 3).alias("support_count")
    )
    return _decided(p)


def _decided(p: DataFrame):
    """The pairs with their ids, and a decision on each."""
    p = p.withColumn("pair_id", pairs.pair_id(F.col("left_id"), F.col("right_id")))
    code = F.ascii("pair_id")
    decisions = p.select(
        "pair_id", B._pick(("merge", "link", "separate", "unknown"), code % 4).alias("decision"), ((code % 10) / 10).alias("confidence")
    )
    return p, decisions


_NAMESAKES_SQL = """
nm AS (SELECT p_partkey AS k, lead(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part),
pr AS (SELECT 'c' || k AS left_id, 'c' || n AS right_id, (k // 2) % 3 AS support_count FROM nm WHERE n IS NOT NULL),
pid AS (SELECT *, sha1(least(left_id, right_id) || '|' || greatest(left_id, right_id)) AS pair_id FROM pr),
dec AS (SELECT pair_id, ['merge', 'link', 'separate', 'unknown'][ascii(pair_id) % 4 + 1] AS decision, (ascii(pair_id) % 10) / 10 AS confidence FROM pid)
"""
#: Part keys of a block, in which the next part of a name is looked up first.
_KEYS_AT_ONCE = 1 << 16


def _namesakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with the next part of its name.

    There are few names, so a window per name and block of keys finds most of them; the last part of a
    block takes the first one of the name's next block, from one row per name and block.
    """
    part = B.table(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias("k"))
    part = part.withColumn("block", F.floor(F.col("k") / _KEYS_AT_ONCE))
    inside = part.withColumn("n", F.lead("k").over(Window.partitionBy("p_name", "block").orderBy("k")))
    later = part.groupBy("p_name", "block").agg(F.min("k").alias("first")).select(
        F.col("p_name").alias("_name"), F.col("block").alias("_block"), F.lead("first").over(Window.partitionBy("p_name").orderBy("block")).alias("_first"))
    met = inside.join(later, inside.p_name.eqNullSafe(F.col("_name")) & (F.col("block") == F.col("_block")))
    return met.withColumn("n", F.coalesce("n", "_first")).where("n IS NOT NULL").select(
        F.concat(F.lit("c"), "k").alias("left_id"), F.concat(F.lit("c"), "n").alias("right_id"), (F.floor(F.col("k") / 2) % 3).alias("support_count"))


@query("apply_decisions", f"""WITH {_NAMESAKES_SQL},
q AS (SELECT p.*, d.decision, d.confidence, CASE WHEN decision = 'merge' AND support_count > 0 THEN 'possible_duplicate' WHEN decision = 'link' THEN 'llm_link_only' END AS rt FROM pid p JOIN dec d USING (pair_id))
SELECT unnest([left_id, right_id]) AS src_id, rt AS relation_type, unnest([right_id, left_id]) AS dst_id, round(confidence, 6) AS confidence FROM q WHERE rt IS NOT NULL""")
def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rel = pairs.apply_decisions(*_decided(_namesakes(spark, sf_dir)))
    return rel.select("src_id", "relation_type", "dst_id", r6("confidence"))


@query("decision_cache", f"""WITH {_NAMESAKES_SQL},
k AS (SELECT *, 'PRODUCT|TOPIC|' || left_id || '|' AS a, 'PRODUCT|TOPIC|' || right_id || '|' AS b FROM pid),
c AS (SELECT pair_id, sha1('v1|' || least(a, b) || '|' || greatest(a, b)) AS cache_key FROM k)
SELECT pair_id, cache_key, CASE WHEN ascii(pair_id) % 2 = 0 THEN decision ELSE 'queued' END AS decision FROM c JOIN dec USING (pair_id)""")
def decision_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs split into cached decisions and the queue for an external judge."""
    p, decisions = _decided(_namesakes(spark, sf_dir))
    named = p.select(
        "pair_id",
        *[c for s in ("left", "right") for c in (
            F.lit("PRODUCT").alias(f"{s}_type"), F.lit("TOPIC").alias(f"{s}_kind"),
            F.upper(F.col(f"{s}_id")).alias(f"{s}_name"), F.lit("").alias(f"{s}_domain"))],
    )
    keyed = named.withColumn("cache_key", pairs.decision_cache_key("v1"))
    cache = keyed.join(decisions, "pair_id").where(F.ascii("pair_id") % 2 == 0).select("cache_key", "decision", "confidence")
    hits, queue = pairs.lookup_decisions(named, cache, "v1")
    return hits.select("pair_id", "cache_key", "decision").unionByName(
        queue.select("pair_id", "cache_key", F.lit("queued").alias("decision"))
    )


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided pairs of active candidates as manual edits, one decision time per pair."""
    known = _candidates(spark, sf_dir).select("candidate_id")
    p, decisions = _decided_pairs(spark, sf_dir)
    e = p.join(decisions, "pair_id").where(F.col("decision") != "unknown")
    for side in ("left_id", "right_id"):
        e = e.join(known.withColumnRenamed("candidate_id", side), side, "left_semi")
    return e.select(
        F.col("pair_id").alias("edit_id"), "left_id", "right_id", F.col("decision").alias("action"),
        F.col("left_id").alias("winner_id"), F.col("pair_id").alias("decided_at"), F.lit("editor").alias("decided_by"),
    )


_KEPT = f"""{_CANDS}, {_PAIRS_SQL},
ed AS (SELECT p.left_id, p.right_id, d.decision AS action FROM pid p JOIN dec d USING (pair_id)
  WHERE d.decision <> 'unknown' AND left_id IN (SELECT candidate_id FROM cands) AND right_id IN (SELECT candidate_id FROM cands))
"""


@query("manual_decisions", f"""WITH {_KEPT},
side AS (SELECT left_id AS candidate_id, right_id AS other_id, action, TRUE AS wins FROM ed UNION ALL SELECT right_id, left_id, action, FALSE FROM ed)
SELECT s.candidate_id, CASE WHEN action = 'merge' AND NOT wins THEN 'MERGED' WHEN c.active THEN 'ACTIVE' ELSE 'BLOCKED' END AS status,
  c.locked OR action = 'merge' AS manual_lock, CASE WHEN action = 'merge' AND wins THEN
    c.canonical_name || ' ' || c.brand || CASE WHEN c.canonical_name <> o.canonical_name THEN '|' || o.canonical_name ELSE '' END
      || CASE WHEN c.canonical_name || c.brand <> o.canonical_name || o.brand THEN '|' || o.canonical_name || ' ' || o.brand ELSE '' END
    ELSE c.canonical_name || ' ' || c.brand END AS aliases,
  CASE WHEN action = 'link' THEN other_id ELSE '' END AS related, CASE WHEN action = 'separate' THEN other_id ELSE '' END AS excluded,
  CASE WHEN action = 'merge' AND NOT wins THEN other_id ELSE '' END AS merged_into
FROM side s JOIN cands c ON c.candidate_id = s.candidate_id JOIN cands o ON o.candidate_id = s.other_id""")
def manual_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _edits(spark, sf_dir)
    after, _ = pairs.apply_all_edits(edits, _candidates(spark, sf_dir), stages.new_path(spark, "edits", sf_dir))
    touched = edits.select(F.explode(F.array("left_id", "right_id")).alias("candidate_id")).distinct()
    return after.join(touched, "candidate_id", "left_semi").select(
        "candidate_id", "status", "manual_lock", joined("aliases", "|"), F.array_join("related_ids", "|").alias("related"),
        F.array_join("exclude_ids", "|").alias("excluded"), F.coalesce("merged_into", F.lit("")).alias("merged_into"),
    )


@query("change_log", f"""WITH {_KEPT} , side AS (SELECT left_id AS id, right_id AS other, action, TRUE AS wins FROM ed UNION ALL SELECT right_id, left_id, action, FALSE FROM ed)
SELECT 'candidates/' || s.id AS document_path, CASE WHEN c.active THEN 'ACTIVE' ELSE 'BLOCKED' END AS status_before,
  CASE WHEN action = 'merge' AND NOT wins THEN 'MERGED' WHEN c.active THEN 'ACTIVE' ELSE 'BLOCKED' END AS status_after,
  CASE WHEN c.locked OR action = 'merge' THEN 'true' ELSE 'false' END AS lock_after, CASE WHEN action = 'merge' AND NOT wins THEN other ELSE '' END AS merged_into
FROM side s JOIN cands c ON c.candidate_id = s.id""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _candidates(spark, sf_dir)
    after, _ = pairs.apply_all_edits(_edits(spark, sf_dir), before, stages.new_path(spark, "edits", sf_dir))
    log = pairs.change_log(before, after)
    value = lambda side, name: F.get_json_object(side, f"$.{name}")
    return log.select(
        "document_path", value("before", "status").alias("status_before"), value("after", "status").alias("status_after"),
        value("after", "manual_lock").alias("lock_after"), F.coalesce(value("after", "merged_into"), F.lit("")).alias("merged_into"),
    )


# --- health ------------------------------------------------------------------------------------------

_LOG = f"""
log0 AS (
  SELECT CAST(ts AS DATE) AS date, {S.case("event_type || ':' || (user_id % 2)", {f'{e}:{p}': s for (e, p), s in B.SOURCE_BY_EVENT.items()}, None)} AS source_id,
    count(*) AS n, count(*) FILTER (WHERE value > 50) AS kept, max(event_id) AS last_id FROM events GROUP BY ALL),
log_ AS (
  SELECT date, source_id, last_id % 5 <> 0 AS ok, CASE WHEN last_id % 5 = 0 THEN 0 ELSE n END AS item_count, CASE WHEN last_id % 5 = 0 THEN 0 ELSE kept END AS kept_count,
    CASE WHEN last_id % 5 = 0 THEN ['HTTP 403 Forbidden', 'Read timed out', '404 page', 'kill_switch', 'socket closed'][last_id % 25 // 5 + 1] ELSE '' END AS error, last_id FROM log0)
"""


def _run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run log: one fetch per (day, source), about one in five failed."""
    ev = B.table(spark, sf_dir, "events")
    from swellcast.functions.numeric import by_key

    source = by_key(
        F.concat_ws(":", "event_type", (F.col("user_id") % 2).cast("string")),
        {f"{e}:{p}": s for (e, p), s in B.SOURCE_BY_EVENT.items()}, None,
    )
    log = ev.groupBy(F.to_date("ts").alias("date"), source.alias("source_id")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("kept"), F.max("event_id").alias("last_id")
    )
    failed = F.col("last_id") % 5 == 0
    errors = ("HTTP 403 Forbidden", "Read timed out", "404 page", "kill_switch", "socket closed")
    return log.select(
        "date", "source_id", (~failed).alias("ok"), F.when(failed, 0).otherwise(F.col("n")).alias("item_count"),
        F.when(failed, 0).otherwise(F.col("kept")).alias("kept_count"),
        F.when(failed, B._pick(errors, F.floor(F.col("last_id") % 25 / 5))).otherwise("").alias("error"),
        (F.col("last_id") % 900).cast("int").alias("response_ms"),
        F.create_map(F.lit("httpStatus"), F.when(failed, "x").otherwise("200"), F.lit("note"), F.col("source_id")).alias("metadata"),
    )


_CLASS = """CASE WHEN regexp_matches(lower(error), '403|forbidden') THEN 'blocked' WHEN regexp_matches(lower(error), '404|not found') THEN 'endpoint_missing'
  WHEN regexp_matches(lower(error), 'timeout|timed out') THEN 'timeout' WHEN contains(error, 'kill_switch') THEN 'kill_switch' WHEN error <> '' THEN 'fetch_failed'
  WHEN NOT ok THEN 'unavailable' WHEN item_count <= 0 THEN 'empty_source' WHEN kept_count <= 0 THEN 'zero_kept' ELSE 'healthy' END"""
_TIER = S.case("source_id", {r[0]: r[10] for r in dims.catalog_rows()}, "")


@query("health_records", f"""WITH {_LOG} SELECT date, source_id, ok, item_count, kept_count, {_CLASS} AS failure_class, {_TIER} AS availability_tier,
  CASE WHEN ok THEN 200 END AS http_status, last_id % 900 AS response_ms, source_id AS note FROM log_""")
def health_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.health_records(_run_log(spark, sf_dir), dims.catalog_df(spark)).select(
        "date", "source_id", "ok", "item_count", "kept_count", "failure_class", "availability_tier", "http_status",
        "response_ms", F.col("metadata")["note"].alias("note"),
    )


@query("failure_streak", f"""WITH {_LOG}, i AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY source_id ORDER BY date) AS isl FROM log_),
s AS (SELECT *, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY source_id, isl ORDER BY date) AS streak FROM i)
SELECT date, source_id, ok, streak, coalesce(lag(streak) OVER (PARTITION BY source_id ORDER BY date), 0) >= 3 AS kill_switch FROM s""")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.failure_streaks(_run_log(spark, sf_dir)).select("date", "source_id", "ok", "streak", "kill_switch")


_PLAN_ROWS = [r for r in dims.catalog_rows() if r[4] in ("CORE", "EXPERIMENTAL") and r[1] != "EVIDENCE_ONLY"]
_PLAN_SQL = "plan_(source_id, role, family, tier) AS (VALUES " + ", ".join(
    f"('{r[0]}', '{r[1]}', '{r[2]}', '{r[10]}')" for r in _PLAN_ROWS) + ")"


def _ratio(cond: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {cond}) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE {cond} AND live) / count(*) FILTER (WHERE {cond}), 4) END"


@query("availability", f"""WITH {_LOG}, {_PLAN_SQL},
grid AS (SELECT d.date, p.*, coalesce(l.ok AND l.item_count > 0, FALSE) AS live FROM (SELECT DISTINCT date FROM log_) d CROSS JOIN plan_ p LEFT JOIN log_ l ON l.date = d.date AND l.source_id = p.source_id)
SELECT date, round(count(DISTINCT family) FILTER (WHERE live) / count(DISTINCT family), 4) AS family_availability, {_ratio("tier = 'core'")} AS core_availability,
  {_ratio(S.one_of('source_id', dims.CREDIBILITY_SOURCES))} AS credibility_availability, {_ratio("role = 'CONFIRMATION' AND family = 'MUSIC_CHART'")} AS music_availability,
  {_ratio("role = 'CONFIRMATION' AND family = 'SHOW_CHART'")} AS show_availability, {_ratio(S.one_of('source_id', dims.SHORT_VIDEO_SOURCES))} AS short_video_availability,
  count(DISTINCT family) FILTER (WHERE live AND family IN ('SEARCH', 'SOCIAL_DISCOVERY')) / 2 AS search_availability FROM grid GROUP BY ALL""")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = K.source_plan(dims.catalog_df(spark))
    df = health.availability(_run_log(spark, sf_dir), plan)
    return df.select(
        "date", "family_availability", "core_availability", "credibility_availability", "music_availability",
        "show_availability", "short_video_availability", "search_availability",
    )


_TOP_SQL = """
top_ AS (SELECT date, row_number() OVER (PARTITION BY date ORDER BY primary_score DESC, candidate_id) AS rank, lane, candidate_type, mass_heat / 4 AS maturity, source_families FROM cf),
top20 AS (SELECT * FROM top_ WHERE rank <= 20),
hsrc AS (
  SELECT date, count(DISTINCT source_id) FILTER (WHERE tier = 'core') AS healthy_core, count(DISTINCT family) FILTER (WHERE role = 'DISCOVERY') AS discovery_count,
    count(DISTINCT family) FILTER (WHERE role IN ('CONFIRMATION', 'EDITORIAL', 'COMMERCE')) AS confirmation_count FROM hlog LEFT JOIN plan_ USING (source_id) WHERE fc = 'healthy' GROUP BY ALL),
hlist AS (
  SELECT date, count(*) AS top_items, count(*) FILTER (WHERE lane = 'words_behaviors') AS words_behaviors,
    round(count(*) FILTER (WHERE candidate_type IN ('PERSON', 'GROUP', 'MUSIC_ARTIST', 'MUSIC_TRACK') AND maturity >= 0.8) / count(*), 4) AS mature_ratio FROM top20 GROUP BY ALL),
hdom AS (SELECT date, max(c) AS single_max FROM (SELECT date, source_families[1] AS f, count(*) AS c FROM top20 WHERE len(source_families) = 1 GROUP BY ALL) GROUP BY ALL),
hall AS (
  SELECT coalesce(s.date, l.date) AS date, coalesce(healthy_core, 0) AS healthy_core, coalesce(discovery_count, 0) AS discovery_count, coalesce(confirmation_count, 0) AS confirmation_count,
    coalesce(words_behaviors, 0) AS words_behaviors, coalesce(top_items, 0) AS top_items, coalesce(mature_ratio, 0.0) AS mature_ratio, coalesce(round(single_max / top_items, 4), 0.0) AS dominance
  FROM hsrc s FULL OUTER JOIN hlist l ON l.date = s.date LEFT JOIN hdom d ON d.date = l.date)
"""


def _ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.top_k_per_day(P.candidate_features(spark, sf_dir), 20, "primary_score")
    return top.select("date", "rank", "lane", "candidate_type", (F.col("mass_heat") / 4).alias("maturity"), "source_families")


def _publish_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = health.health_records(_run_log(spark, sf_dir), dims.catalog_df(spark))
    return health.publish_health(records, K.source_plan(dims.catalog_df(spark)), _ranked_items(spark, sf_dir))


_HEALTH_CTES = (*O.TO_CF, _LOG, _PLAN_SQL, f"hlog AS (SELECT *, {_CLASS} AS fc FROM log_)", _TOP_SQL)


@query("publish_health", O.chain(*_HEALTH_CTES, tail="""
SELECT date, len(reasons) = 0 AS public_eligible, array_to_string(reasons, ';') AS reasons, healthy_core, discovery_count, confirmation_count, words_behaviors, mature_ratio, dominance, top_items
FROM (SELECT *, list_filter([CASE WHEN healthy_core < 6 THEN 'healthy_core_sources<6:' || healthy_core END, CASE WHEN discovery_count < 2 THEN 'discovery_families<2:' || discovery_count END,
  CASE WHEN confirmation_count < 2 THEN 'confirmation_families<2:' || confirmation_count END, CASE WHEN words_behaviors < 1 THEN 'words_behaviors_top20<1:' || words_behaviors END,
  CASE WHEN dominance > 0.45 THEN 'single_family_dominance>0.45:' || dominance END], lambda x: x IS NOT NULL) AS reasons FROM hall)"""))
def publish_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _publish_health(spark, sf_dir).select(
        "date", "public_eligible", joined("reasons", ";"), "healthy_core", "discovery_count", "confirmation_count",
        "words_behaviors", "mature_ratio", "dominance", "top_items",
    )


@query("rollout_window", O.chain(*_HEALTH_CTES, tail="""
SELECT count(*) AS window_size, min(healthy_core) AS min_healthy_core, min(discovery_count) AS min_discovery_count, min(confirmation_count) AS min_confirmation_count,
  min(words_behaviors) AS min_words_behaviors, max(top_items * 3) AS max_write_ops, round(avg(mature_ratio), 4) AS avg_shadow_mature_people_music_ratio, FALSE AS ready
FROM (SELECT * FROM hall ORDER BY date DESC LIMIT 14)"""))
def rollout_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-out readiness over the newest 14 shadow days (no public baseline: not ready)."""
    ev = _publish_health(spark, sf_dir).select(
        "date", F.lit("shadow_v2").alias("variant"), F.lit(0.0).alias("breakout_precision_7d"), F.lit(0.0).alias("future_spread_7d"),
        F.col("mature_ratio").alias("mature_people_music_ratio"), "healthy_core", "discovery_count", "confirmation_count",
        "words_behaviors", (F.col("top_items") * 3).alias("write_ops"),
    )
    return health.rollout_readiness(ev).select(
        "window_size", "min_healthy_core", "min_discovery_count", "min_confirmation_count", "min_words_behaviors",
        "max_write_ops", "avg_shadow_mature_people_music_ratio", "ready",
    )


@query("cost_ledger", """SELECT month, CAST(cost AS DOUBLE) AS cost, calls, round(cost / 5000, 6) AS budget_ratio,
  CASE WHEN cost / 5000 >= 1 THEN 'search_off' WHEN cost / 5000 >= 0.8 THEN 'search_reduced' WHEN cost / 5000 >= 0.6 THEN 'watch' ELSE 'full' END AS tier FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS calls, sum(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 WHEN '5-LOW' THEN 2 ELSE 0 END) AS cost FROM orders GROUP BY ALL)""")
def cost_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swellcast.functions.numeric import by_key

    service = by_key(
        F.col("o_orderpriority"), {"1-URGENT": "X_SEARCH", "2-HIGH": "LLM_SUMMARY", "5-LOW": "LLM_RESOLUTION"}, "OTHER"
    )
    usage = B.table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"), service.alias("service"), F.lit(1).cast("long").alias("calls")
    )
    return health.cost_ledger(usage).select("month", "cost", "calls", r6("budget_ratio"), "tier")


@query("write_volume", """SELECT date, sum(c) AS write_ops FROM (
  SELECT CAST(ts AS DATE) AS date, count(*) AS c FROM events GROUP BY ALL UNION ALL
  SELECT CAST(ts AS DATE), 3 * count(DISTINCT user_id) FROM events GROUP BY ALL) GROUP BY ALL""")
def write_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = B.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(
        F.count("*").alias("observations"), F.countDistinct("user_id").alias("items")
    )
    row = lambda n, fan, on: F.struct(
        F.lit(n).alias("dataset"), F.col(n).alias("row_count"), F.lit(fan).alias("fan_out"), F.lit(on).alias("enabled"))
    counts = ev.select("date", F.explode(F.array(row("observations", 1, True), row("items", 3, True), row("items", 9, False))).alias("c")).select("date", "c.*")
    return health.write_volume(counts)


# --- tables ---------------------------------------------------------------------------------------------

@query("source_plan", f"""WITH n AS (SELECT {S.case("event_type || ':' || (user_id % 2)", {f'{e}:{p}': s for (e, p), s in B.SOURCE_BY_EVENT.items()}, None)} AS source_id, count(*) AS n FROM events GROUP BY ALL),
{_PLAN_SQL.replace('plan_', 'planned')}
SELECT source_id, role, family AS family_primary, tier AS availability_tier, coalesce(n % 2 = 0, TRUE) AS enabled, n % 40 AS fetch_limit FROM planned LEFT JOIN n USING (source_id) WHERE source_id <> 'WEAR_WORDS'""")
def source_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog plan with overrides taken from the event counts of each source."""
    n = B.event_mentions(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"))
    overrides = n.select("source_id", (F.col("n") % 2 == 0).alias("enabled"), (F.col("n") % 40).cast("int").alias("fetch_limit"))
    plan = K.source_plan(dims.catalog_df(spark), overrides, exclude=("WEAR_WORDS",))
    return plan.select("source_id", "role", "family_primary", "availability_tier", "enabled", "fetch_limit")


@query("config_drift", f"""WITH ids AS (SELECT DISTINCT CASE WHEN event_type = 'view' THEN 'X_SEARCH' WHEN event_type = 'click' THEN 'APPLE_MUSIC_JP' ELSE upper(event_type) END AS source_id FROM events),
known(source_id) AS (VALUES {', '.join(f"('{r[0]}')" for r in dims.catalog_rows())}), fetchable(source_id) AS (VALUES {', '.join(f"('{s}')" for s in dims.FETCHABLE_SOURCES)})
SELECT 'unknown' AS drift, source_id FROM ids WHERE source_id NOT IN (SELECT source_id FROM known)
UNION ALL SELECT 'stale', source_id FROM ids WHERE source_id IN (SELECT source_id FROM known) AND source_id NOT IN (SELECT source_id FROM fetchable)
UNION ALL SELECT 'missing', source_id FROM known WHERE source_id NOT IN (SELECT source_id FROM fetchable)""")
def config_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    ids = B.table(spark, sf_dir, "events").select(
        F.when(t == "view", "X_SEARCH").when(t == "click", "APPLE_MUSIC_JP").otherwise(F.upper(t)).alias("source_id")
    )
    return K.config_drift(spark, ids)


@query("scan_filters", """SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT' AND c_mktsegment = 'MACHINERY' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-31' - 364 AND DATE '1998-01-31'""")
def scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, membership, look-back and id-list filters over orders."""
    orders = TB.scan(B.table(spark, sf_dir, "orders"), [("o_orderstatus", "in", ["F", "O"]), ("o_orderpriority", "==", "1-URGENT")])
    recent = TB.look_back(orders.withColumn("date", F.to_date("o_orderdate")), "1998-01-31", 360, 6)
    ids = TB.scan(B.table(spark, sf_dir, "customer"), [("c_mktsegment", "==", "MACHINERY")]).select(F.col("c_custkey").alias("o_custkey"))
    return TB.by_ids(recent, ids, "o_custkey").select("o_orderkey", "o_orderstatus", "date")


@query("scan_ordered", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC LIMIT 50""")
def scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered, limited form of a collection scan (a top-50 report)."""
    found = TB.scan(B.table(spark, sf_dir, "orders"), [("o_orderstatus", "==", "F")], "o_totalprice", descending=True, limit=50)
    return found.select("o_orderkey", "o_totalprice")


@query("scan_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) IN (DATE '1995-03-01', DATE '1996-07-15', DATE '1997-11-30')""")
def scan_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return TB.by_dates(orders, ["1995-03-01", "1996-07-15", "1997-11-30", "1995-03-01"])


@query("active_candidates", f"WITH {_CANDS} SELECT candidate_id, 'active' AS scan FROM cands WHERE active UNION ALL SELECT candidate_id, 'all' FROM cands WHERE NOT active")
def active_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active candidates, and the whole of a table that has none."""
    cands = _candidates(spark, sf_dir).select("candidate_id", "status")
    kept = lambda df, name: TB.active_or_all(df).select("candidate_id", F.lit(name).alias("scan"))
    return kept(cands, "active").unionByName(kept(cands.where(F.col("status") != "ACTIVE"), "all"))


@query("daily_state", O.chain(O.MENTIONS, O.FOLD, tail="""
SELECT date, candidate_id, source_id, rn AS n, round(m, 6) AS m, round(v, 6) AS v FROM stepped WHERE date > (SELECT max(date) - 4 FROM stepped)"""))
def daily_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four days stepped one by one from the stored state equal the replay of all days."""
    daily = P.source_features(spark, sf_dir).select("date", "candidate_id", "source_id", "signal", "family_primary")
    newest = daily.agg(F.max("date")).first()[0]
    history = AN.fold_history(daily.where(F.col("date") <= F.date_sub(F.lit(newest), 4)))
    newest_row = history.groupBy("candidate_id", "source_id").agg(
        F.max_by(F.struct("m", "v", "n", F.col("anomaly").alias("s1"), F.col("anomaly_lag1").alias("s2"), F.col("date").alias("last_date")), "date").alias("s"))
    state, out = newest_row.select("candidate_id", "source_id", "s.*"), None
    for back in range(3, -1, -1):
        path = new_path(spark, f"state-{next(_RUN)}-{back}", sf_dir)
        stepped = AN.advance_state(state, daily.where(F.col("date") == F.date_sub(F.lit(newest), back)))
        stepped.write.mode("overwrite").parquet(f"{path}/day")
        day = spark.read.parquet(f"{path}/day")
        AN.next_state(state, day).write.mode("overwrite").parquet(f"{path}/state")
        state = spark.read.parquet(f"{path}/state")
        out = day if out is None else out.unionByName(day)
    return out.select("date", "candidate_id", "source_id", "n", *r6("m", "v"))


@query("observation_enrichment", f"""WITH {_CANDS}, {_MENTION}
SELECT ordinal, r.candidate_id, c.canonical_name, {S.case("'WEAR_WORDS'", {r[0]: r[1] for r in dims.catalog_rows()}, "")} AS source_role,
  'WEAR_WORDS:' || ordinal % 50 || ':' || r.candidate_id AS source_item_id FROM resolved r JOIN cands c ON c.candidate_id = r.candidate_id""")
def observation_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved mentions with the attributes of their candidate and source, and an item id of their own."""
    cands = _candidates(spark, sf_dir)
    found = resolve.resolve(_part_mentions(spark, sf_dir), cands).where(F.col("candidate_id").isNotNull())
    mentions = found.select(
        "ordinal", "candidate_id", F.lit("WEAR_WORDS").alias("source_id"), F.lit("").alias("source_item_id"), (F.col("ordinal") % 50).cast("int").alias("rank"))
    keyed = cands.withColumn("match_key", F.col("canonical_name"))
    out = resolve.observations(mentions, keyed, dims.catalog_df(spark))
    return out.select("ordinal", "candidate_id", "canonical_name", "source_role", "source_item_id")


@query("upsert_merge", """SELECT coalesce(o.k, n.k) AS k, coalesce(n.status, o.status) AS status, coalesce(n.price, o.price) AS price FROM (
  SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0) o
FULL OUTER JOIN (SELECT o_orderkey AS k, 'N' AS status, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 END AS price FROM orders WHERE o_orderkey % 2 = 0) n ON n.k = o.k""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = o.where("k % 2 = 0").select("k", F.lit("N").alias("status"), F.when(F.col("k") % 4 == 0, F.col("price") * 2).alias("price"))
    return TB.upsert(o.where("k % 3 <> 0"), new, ["k"])


@query("latest_snapshot", """WITH r AS (SELECT CAST(o_orderdate AS DATE) AS date, 'run' || (o_custkey % 5) AS run_id, max(o_orderkey) AS p FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
n AS (SELECT date, arg_max(run_id, lpad(p::VARCHAR, 12, '0') || run_id) AS newest FROM r GROUP BY ALL),
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, 'run9' AS day_run FROM orders WHERE day(o_orderdate) = 1)
SELECT coalesce(n.date, d.date) AS date, coalesce(day_run, newest) AS run_id FROM n FULL OUTER JOIN d ON d.date = n.date""")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as published runs; the first of a month also has a complete day record."""
    o = B.table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    runs = o.where(F.col("o_orderstatus") != "P").select(
        "date", F.concat(F.lit("run"), F.col("o_custkey") % 5).alias("run_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("published_at")
    )
    day = o.where(F.dayofmonth("date") == 1).select("date", F.lit("x").alias("published_at"), F.lit("run9").alias("latest_published_run_id")).distinct()
    return TB.latest_published(day, runs)


@query("snapshot_items", """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, 'run' || (o_custkey % 5) AS run_id, o_orderkey, o_orderstatus FROM orders),
n AS (SELECT date, arg_max(run_id, lpad(o_orderkey::VARCHAR, 12, '0') || run_id) AS run_id FROM o WHERE o_orderstatus <> 'P' GROUP BY ALL)
SELECT date, run_id, o_orderkey AS rank FROM o JOIN n USING (date, run_id)""")
def snapshot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each day's newest published run; the publication record leaves out internal fields."""
    o = B.table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"), F.concat(F.lit("run"), F.col("o_custkey") % 5).alias("run_id"), "o_orderstatus",
        F.col("o_orderkey").alias("rank"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("published_at"))
    runs = TB.public_meta(o.where(F.col("o_orderstatus") != "P"))
    day = o.limit(0).select("date", "published_at", F.col("run_id").alias("latest_published_run_id"))
    return TB.snapshot_items(o.select("date", "run_id", "rank"), day, runs).select("date", "run_id", "rank")


@query("partitioned_sinks", O.chain(*O.TO_CF, _TOP_SQL.split("hsrc AS")[0].rstrip().rstrip(","), tail="""
SELECT c.collection, t.date, count(*) AS n, CASE WHEN c.collection = 'daily_rankings_v2_shadow' THEN 'SHADOW_ONLY' ELSE 'PUBLISHED' END AS status FROM top20 t,
  (VALUES ('daily_rankings'), ('daily_rankings_v2_shadow'), ('runs')) c(collection) GROUP BY ALL"""))
def partitioned_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish fan-out written twice (a re-run replaces its partitions), then read back."""
    path = new_path(spark, f"published-{next(_RUN)}", sf_dir)
    rows = TB.publish_rows(_ranked_items(spark, sf_dir), "r1")
    for _ in range(2):
        TB.write_days(rows, path, ("collection", "date"))
    return TB.read_table(spark, path).groupBy("collection", "date", "status").agg(F.count("*").alias("n"))


@query("run_summary", f"""WITH {_LOG} SELECT date, count(*) FILTER (WHERE {_CLASS} = 'healthy') AS healthy_sources, count(*) AS sources, sum(item_count) AS items FROM log_ GROUP BY ALL""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = health.health_records(_run_log(spark, sf_dir), dims.catalog_df(spark))
    counts = records.groupBy("date").agg(F.sum("item_count").alias("row_count")).withColumn("dataset", F.lit("items"))
    df = TB.run_summary(records, counts)
    return df.select("date", "healthy_sources", F.size("sources").alias("sources"), F.col("counts")["items"].alias("items"))


# --- streaming ----------------------------------------------------------------------------------------------

def _stream_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1000).parquet(path)


@query("stream_anomaly", O.chain(O.MENTIONS, O.FOLD, tail="""
SELECT date, candidate_id, source_id, rn AS n, round(m, 6) AS m, round(v, 6) AS v, round(s1, 6) AS anomaly, FALSE AS late FROM stepped"""))
def stream_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums read as a stream through the keyed anomaly state, to the end of input."""
    base = new_path(spark, f"stream-{next(_RUN)}", sf_dir)
    P.source_features(spark, sf_dir).select("candidate_id", "source_id", "date", "signal", "family_primary").write.parquet(f"{base}/in")
    out = SA.anomaly_stream(_stream_parquet(spark, f"{base}/in"))
    q = out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "date", "candidate_id", "source_id", "n", *r6("m", "v", "anomaly"), "late"
    )


@query("label_stream_upsert", O.chain(*O.TO_CF, labels_cte(), tail=f"SELECT date, candidate_id, {', '.join(labels.FLAGS)}, lead_days FROM labels_"))
def label_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows replayed twice through the upsert sink give the label table once."""
    base = new_path(spark, f"labels-{next(_RUN)}", sf_dir)
    P.labels(spark, sf_dir).write.parquet(f"{base}/in")
    sink = SU.label_upsert(f"{base}/table", f"{base}/work")
    for attempt in range(2):
        q = _stream_parquet(spark, f"{base}/in").writeStream.foreachBatch(sink).option(
            "checkpointLocation", f"{base}/ck{attempt}").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{base}/table").select("date", "candidate_id", *labels.FLAGS, "lead_days")


@query("rerun_idempotent", O.chain(*O.TO_SF, tail="SELECT date, count(*) AS n, round(sum(surprise01), 6) AS total FROM sf GROUP BY ALL"))
def rerun_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source features written, then half of the days recomputed in place."""
    path = new_path(spark, f"rerun-{next(_RUN)}", sf_dir)
    sf = P.source_features(spark, sf_dir)
    TB.write_days(sf, path)
    SU.rerun_day(sf.where(F.dayofmonth("date") % 2 == 0), path)
    return TB.read_table(spark, path).groupBy("date").agg(F.count("*").alias("n"), F.round(F.sum("surprise01"), 6).alias("total"))
