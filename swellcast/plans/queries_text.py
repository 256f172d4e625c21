"""Registered queries: surfaces, topics and raw payload parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.functions import text as T
from swellcast.functions import urls
from swellcast.operators import gazetteer, topics
from swellcast.plans import sqltext as S
from swellcast.plans.shared import joined, r6
from swellcast.plans.stages import stage
from swellcast.session import spread
from swellcast.sources import bindings as B
from swellcast.sources import payloads as X
from swellcast.sources import variants as VR

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


_SURFACES = """
surfaces AS (
  SELECT 'doc' || doc_id AS id, text AS t FROM documents
  UNION ALL SELECT 'part' || p_partkey, p_name FROM part
  UNION ALL SELECT 'turn' || conv_id || '-' || turn, text FROM conversations)
"""
_NORMED = f"""{_SURFACES},
s1 AS (SELECT *, {S.norm_topic('t')} AS n1 FROM surfaces),
s2 AS (SELECT *, {S.norm_topic('n1')} AS n2 FROM s1),
s3 AS (SELECT *, {S.norm_topic('n2')} AS n3 FROM s2)
"""


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, part names and conversation turns as surfaces."""
    docs = B.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("id"), F.col("text").alias("t")
    )
    parts = B.table(spark, sf_dir, "part").select(F.concat(F.lit("part"), "p_partkey"), "p_name")
    turns = B.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("turn"), "conv_id", F.lit("-"), "turn"), "text"
    )
    return spread(docs).union(parts).union(spread(turns))


@query("surface_keys", f"""WITH {_NORMED}
SELECT id, sha1({S.norm_name('t')}) AS name_sha, sha1({S.match_key('t')}) AS match_key_sha, sha1(n1) AS topic_sha,
  sha1({S.key_of('n1')}) AS topic_key_sha, sha1({S.strip_hash('n1')}) AS hashtag_key_sha, {S.keep_parts('n1', 'n2')} AS keep FROM s3""")
def surface_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _surfaces(spark, sf_dir).select(
        "id",
        F.sha1(T.normalize_name(t)).alias("name_sha"), F.sha1(T.match_key(t)).alias("match_key_sha"),
        F.sha1(T.normalize_topic(t)).alias("topic_sha"), F.sha1(T.topic_key(t)).alias("topic_key_sha"),
        F.sha1(T.hashtag_key_nf(t)).alias("hashtag_key_sha"), T.keep_topic(t).alias("keep"),
    )


@query("surface_specificity", f"""WITH {_NORMED}
SELECT id, round({S.specificity('n1', 'n2')}, 6) AS specificity, {S.objectness('n1')} AS objectness,
  round({S.genericity('n1', 'n2', 'n3')}, 6) AS genericity, {S.live_bias('n2')} AS live_bias FROM s3""")
def surface_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _surfaces(spark, sf_dir).select("id", T.topic_scores_nf(F.col("t")).alias("s"))
    return scored.select(
        "id", F.round("s.specificity", 6).alias("specificity"), "s.objectness",
        F.round("s.genericity", 6).alias("genericity"), "s.live_bias",
    )


_LOW = S.norm_topic("t")


@query("keyword_classes", f"""WITH {_SURFACES}, k AS (SELECT id, lower({_LOW}) AS low FROM surfaces)
SELECT id, {S.contains_any('low', dims.KEYWORDS['generic_event_keywords'])} AS event_word, {S.contains_any('low', dims.LIVE_WORDS)} AS live_word,
  {S.contains_any('low', dims.FINANCE_WORDS)} AS finance_word FROM k""")
def keyword_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _surfaces(spark, sf_dir).select(
        "id", T.has_event_word(t).alias("event_word"), T.has_live_word(t).alias("live_word"),
        T.has_finance_word(t).alias("finance_word"),
    )


_NAMES = """
names AS (
  SELECT 'p' || p_partkey AS id, p_name AS n FROM part UNION ALL SELECT 'b' || p_partkey, upper(left(p_type, 2 + p_partkey % 3)) FROM part
  UNION ALL SELECT 'd' || p_partkey, CAST(floor(p_retailprice) AS BIGINT)::VARCHAR FROM part
  UNION ALL SELECT 'n' || p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'IU' WHEN 1 THEN 'News' WHEN 2 THEN '--__' ELSE 'ラブ' || p_partkey END FROM part)
"""


@query("proper_noun_filter", f"""WITH {_NAMES}, t AS (SELECT id, n, {S.trim('n')} AS s FROM names)
SELECT id, n, CASE WHEN {S.one_of('s', dims.PROPER_NOUN_WHITELIST)} OR {S.one_of('upper(s)', dims.PROPER_NOUN_WHITELIST)} THEN TRUE
  WHEN length(s) <= 2 THEN FALSE WHEN regexp_matches(s, '^[0-9]+$') THEN FALSE WHEN regexp_matches(s, '^[^\\p{{L}}\\p{{N}}]+$') THEN FALSE
  WHEN {S.one_of('lower(s)', [w.lower() for w in dims.PROPER_NOUN_BLACKLIST])} THEN FALSE
  ELSE NOT (regexp_matches(s, '^[ぁ-ゟ ]*$') AND length(s) <= 3) END AS proper FROM t""")
def proper_noun_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    made = (
        F.when(key % 4 == 0, "IU").when(key % 4 == 1, "News").when(key % 4 == 2, "--__")
        .otherwise(F.concat(F.lit("ラブ"), key.cast("string")))
    )
    rows = F.array(
        F.struct(F.concat(F.lit("p"), key).alias("id"), F.col("p_name").alias("n")),
        F.struct(F.concat(F.lit("b"), key).alias("id"), F.upper(F.left("p_type", (2 + key % 3).cast("int"))).alias("n")),
        F.struct(F.concat(F.lit("d"), key).alias("id"), F.floor("p_retailprice").cast("long").cast("string").alias("n")),
        F.struct(F.concat(F.lit("n"), key).alias("id"), made.alias("n")),
    )
    df = p.select(F.explode(rows).alias("r")).select("r.*")
    return df.select("id", "n", T.is_proper_noun(F.col("n")).alias("proper"))


@query("domain_class", f"""WITH d AS (
  SELECT doc_id, text, {S.pick(dims.CANDIDATE_TYPES, f'doc_id % {len(dims.CANDIDATE_TYPES)}')} AS ctype,
    {S.pick(dims.FAMILIES, f'doc_id % {len(dims.FAMILIES)}')} AS family FROM documents)
SELECT doc_id, ctype, family, {S.classify('ctype', 'family', 'text')} AS domain FROM d""")
def domain_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select(
        "doc_id", "text",
        B._pick(dims.CANDIDATE_TYPES, F.col("doc_id") % len(dims.CANDIDATE_TYPES)).alias("ctype"),
        B._pick(dims.FAMILIES, F.col("doc_id") % len(dims.FAMILIES)).alias("family"),
    )
    return docs.select(
        "doc_id", "ctype", "family", T.classify_domain(F.col("ctype"), F.col("family"), F.col("text")).alias("domain")
    )


_TAGGED = "text || ' #' || source || '活 を ' || '「' || source || ' 限定バッグ」 推し' || source || 'する'"


def _tagged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a synthetic tag, quote and behaviour derived from their source."""
    src = F.col("source")
    made = F.concat(
        F.col("text"), F.lit(" #"), src, F.lit("活 を "), F.lit("「"), src, F.lit(" 限定バッグ」 推し"), src, F.lit("する")
    )
    return spread(B.table(spark, sf_dir, "documents").select("doc_id", made.alias("text")))


_TAG = r"(#[\p{L}\p{N}_ぁ-んァ-ン一-龥ー]+)"


@query("hashtags", f"""WITH h AS (
  SELECT doc_id, pos, raw FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all({_TAGGED}, {S.lit(_TAG)}, 1) AS l FROM documents))),
n1 AS (SELECT doc_id, pos, CASE WHEN starts_with(n, '#') THEN n ELSE '#' || n END AS n FROM (SELECT doc_id, pos, {S.norm_topic('raw')} AS n FROM h)),
k1 AS (SELECT *, {S.norm_topic('n')} AS once FROM n1), k2 AS (SELECT *, {S.norm_topic('once')} AS twice FROM k1)
SELECT doc_id, n AS hashtag, min(pos) AS first_pos FROM k2 WHERE {S.keep_parts('once', 'twice')} GROUP BY ALL""")
def hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _tagged_docs(spark, sf_dir).select("doc_id", T.hashtags(F.col("text")).alias("h"), "text")
    raw = F.regexp_extract_all("text", F.lit(T.HASHTAG), F.lit(1))
    # Position of the first raw match of each kept tag.
    return df.select("doc_id", raw.alias("raw"), F.explode("h").alias("hashtag")).select(
        "doc_id", "hashtag", F.array_position(F.transform("raw", lambda r: T.normalize_topic_nf(r)), F.col("hashtag")).alias("first_pos")
    )


_TOPICS_SQL = f"""WITH base AS (SELECT doc_id, {_TAGGED} AS t FROM documents),
raw AS (
  SELECT doc_id, 0 AS grp, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(t, {S.lit(_TAG)}, 1) AS l FROM base)
""" + "".join(
    f"  UNION ALL SELECT doc_id, {i + 1}, unnest(l), generate_subscripts(l, 1) FROM (SELECT doc_id, regexp_extract_all(t, {S.lit('([^' + chr(92) + 's、。!！?？]{1,20}?' + tail + ')')}, 1) AS l FROM base)\n"
    for i, tail in enumerate(dims.BEHAVIOR_TAILS)
) + f"""  UNION ALL SELECT doc_id, 20, unnest(l), generate_subscripts(l, 1) FROM (SELECT doc_id, regexp_extract_all(t, {S.lit(T.QUOTED)}, 1) AS l FROM base)
  UNION ALL SELECT doc_id, 21, unnest(l), generate_subscripts(l, 1) FROM (SELECT doc_id, regexp_extract_all(t, '([^\\s、。!！?？]{{2,24}})', 1) AS l FROM base)),
d1 AS (SELECT DISTINCT s FROM raw),
m1 AS (SELECT s, {S.norm_topic('s')} AS n1 FROM d1),
m2 AS (SELECT *, {S.norm_topic('n1')} AS n2 FROM m1), m3 AS (SELECT *, {S.norm_topic('n2')} AS n3 FROM m2),
voc AS (SELECT s, n1, {S.topic_class('n1')} AS class, {S.keep_parts('n2', 'n3')} AS keep FROM m3),
hits AS (
  SELECT doc_id, grp, pos, CASE WHEN grp = 0 THEN 'HASHTAG' WHEN grp < 20 THEN 'BEHAVIOR' ELSE class END AS candidate_type, n1 AS name
  FROM raw JOIN voc USING (s) WHERE keep),
firsts AS (SELECT doc_id, candidate_type, name, min(grp * 1000000 + pos) AS o FROM hits GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS position FROM firsts)
"""


@query("topic_mentions", _TOPICS_SQL + f"""SELECT doc_id, position, candidate_type, name,
  CASE WHEN candidate_type = 'HASHTAG' THEN 'HIGH' WHEN candidate_type IN ('BEHAVIOR', 'STYLE', 'PRODUCT') THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  {S.classify('candidate_type', "'UNKNOWN'", 'name')} AS domain_class FROM ranked WHERE position <= 10""")
def topic_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.extract_topics(_tagged_docs(spark, sf_dir), keep=("doc_id",))


@query("phrase_mining")
def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined phrases of whole conversation turns (checked by brute force in tests)."""
    turns = spread(B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return topics.mine_topics(turns, keep=("conv_id", "turn"))


@query("gazetteer_tags", """WITH w AS (
  SELECT doc_id, word, min(pos) - 1 AS pos FROM (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos
    FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') AS l FROM documents)) WHERE word <> '' GROUP BY ALL),
g AS (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS word, 'GROUP' AS entity_type FROM conversations
  UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'PRODUCT' FROM part)
SELECT doc_id, slot, word AS name, entity_type FROM (
  SELECT doc_id, word, entity_type, row_number() OVER (PARTITION BY doc_id ORDER BY pos, entity_type) AS slot FROM w JOIN g USING (word)) WHERE slot <= 5""")
def gazetteer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.table(spark, sf_dir, "conversations").select(
        F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("name"), F.lit("GROUP").alias("entity_type")
    ).unionByName(
        B.table(spark, sf_dir, "part").select(
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), F.lit("PRODUCT").alias("entity_type"))
    ).distinct()
    names = stage(spark, sf_dir, "tag_names", lambda: found)
    return topics.gazetteer_tags(B.table(spark, sf_dir, "documents"), names, "doc_id")


# --- rows of differing shape --------------------------------------------------------------------------

_SHAPES = ("hashtag", "song", "creator", "video")
_SURFACE_SQL = "['hashtag', 'song', 'creator', 'video'][user_id % 4 + 1]"
_BROKEN_SQL = "user_id % 13 = 5"


def _shaped_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One API payload per user, its rows in the shape of one of four surfaces; some payloads are cut off."""
    ev = B.table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("k"), "value")
    lit = F.lit
    number, views, name = F.col("event_id") % 40, (F.col("value") * 100).cast("long"), F.concat(lit("k"), "k")
    shape = F.col("user_id") % 4
    row = (
        F.when(shape == 0, F.to_json(F.struct(name.alias("hashtag_name"), number.alias("rank"), views.alias("video_views"))))
        .when(shape == 1, F.to_json(F.struct(lit("").alias("song_name"), name.alias("music_name"), number.cast("string").alias("rank_index"),
                                             F.struct(F.concat(lit("by "), name).alias("nickname")).alias("author"))))
        .when(shape == 2, F.to_json(F.struct(name.alias("creator_name"), number.alias("position"), F.struct(views.alias("views")).alias("stats"))))
        .otherwise(F.to_json(F.struct(name.alias("title"), number.alias("rank"), F.array(F.concat(lit("#"), name)).alias("hashtags"), lit("many").alias("vv"))))
    )
    listed = ev.withColumn("row", row).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "row"))).alias("rows"))
    inner = F.concat(lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), lit("]"))
    body = F.when(F.col("user_id") % 4 == 2, F.concat(lit('{"items":'), inner, lit("}"))).otherwise(F.concat(lit('{"data":{"list":'), inner, lit("}}")))
    surface = B._pick(_SHAPES, F.col("user_id") % 4)
    cut_off = F.when(F.col("user_id") % 13 == 5, F.substring("body", 1, 9)).otherwise(F.col("body"))
    return listed.withColumn("body", body).select("user_id", surface.alias("surface"), cut_off.alias("body"))


@query("shaped_rows", f"""SELECT user_id, surface, position, rank, title, CASE WHEN surface = 'song' THEN 'by ' || title END AS artist,
  CASE WHEN surface IN ('hashtag', 'creator') THEN views END AS views, CASE WHEN surface = 'video' THEN '#' || title END AS hashtags FROM (
  SELECT user_id, {_SURFACE_SQL} AS surface, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, event_id % 40 AS rank,
    'k' || json_extract_string(props, '$.k') AS title, CAST(trunc(value * 100) AS BIGINT) AS views FROM events WHERE NOT ({_BROKEN_SQL}))""")
def shaped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four surfaces in one pass without a schema, each field under whichever name it has."""
    found = VR.rows(_shaped_payloads(spark, sf_dir), "body", ["user_id", "surface"])
    return found.withColumn("hashtags", F.array_join("hashtags", ","))


@query("shape_drift", f"""SELECT surface, count(*) AS payloads, count(*) FILTER (WHERE {_BROKEN_SQL}) AS broken, 0 AS without_list,
  CASE surface WHEN 'hashtag' THEN 'OBJECT<hashtag_name: STRING, rank: BIGINT, video_views: BIGINT>'
    WHEN 'song' THEN 'OBJECT<author: OBJECT<nickname: STRING>, music_name: STRING, rank_index: STRING, song_name: STRING>'
    WHEN 'creator' THEN 'OBJECT<creator_name: STRING, position: BIGINT, stats: OBJECT<views: BIGINT>>'
    ELSE 'OBJECT<hashtags: ARRAY<STRING>, rank: BIGINT, title: STRING, vv: STRING>' END AS shape
FROM (SELECT DISTINCT user_id, {_SURFACE_SQL} AS surface FROM events) GROUP BY ALL""")
def shape_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the payloads of each surface look like, and how many are broken."""
    return VR.drift(_shaped_payloads(spark, sf_dir), "body", "surface")


# Names of one to four words, cut out of the benchmark's items; an item's first words also occur in documents.
_NAMES = """
plain AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
names AS (SELECT name, min(kind) AS kind FROM (
  SELECT array_to_string(w[1 + 3 * k : 1 + 3 * k + k], ' ') AS name, ['PERSON', 'GROUP', 'WORK', 'KEYWORD'][k + 1] AS kind FROM plain, (VALUES (0), (1), (2), (3)) t(k)) WHERE name <> '' GROUP BY ALL)
"""


@query("name_mentions", f"""WITH RECURSIVE {_NAMES.replace('GROUP BY ALL)', 'GROUP BY name)')},
docs AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
places AS (
  SELECT doc_id, i, max(n) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs), (VALUES (1), (2), (3), (4)) t(n)
  WHERE i + n - 1 <= len(w) AND array_to_string(w[i : i + n - 1], ' ') IN (SELECT name FROM names) GROUP BY ALL),
next_ AS (SELECT *, (SELECT min(i) FROM places q WHERE q.doc_id = p.doc_id AND q.i >= p.i + p.n) AS next_i FROM places p),
taken AS (
  SELECT doc_id, min(i) AS i FROM places GROUP BY ALL
  UNION ALL SELECT t.doc_id, n.next_i FROM taken t JOIN next_ n ON n.doc_id = t.doc_id AND n.i = t.i WHERE n.next_i IS NOT NULL)
SELECT doc_id, name, kind AS entity_type, count(*) AS times, min(start) AS start FROM (
  SELECT doc_id, array_to_string(w[p.i : p.i + p.n - 1], ' ') AS name, CASE WHEN p.i = 1 THEN 0 ELSE length(array_to_string(w[1 : p.i - 1], ' ')) + 1 END AS start
  FROM taken JOIN places p USING (doc_id, i) JOIN docs USING (doc_id)) JOIN names USING (name) GROUP BY ALL""")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of several words in whole documents: where each is first mentioned and how often."""
    words = F.split(gazetteer.plain_form(F.col("text")), " ")
    kinds = ("PERSON", "GROUP", "WORK", "KEYWORD")
    names = B.table(spark, sf_dir, "benchmark").select(F.explode(F.array(*[
        F.struct(F.array_join(F.slice(words, 1 + 3 * k, k + 1), " ").alias("name"), F.lit(kind).alias("entity_type")) for k, kind in enumerate(kinds)])).alias("n")).select("n.*")
    found = gazetteer.name_mentions(B.table(spark, sf_dir, "documents"), names, "doc_id")
    return found.groupBy("doc_id", "name", "entity_type").agg(F.count("*").alias("times"), F.min("start").alias("start"))


@query("clean_truncate", """SELECT doc_id, length(c) AS n, sha1(c) AS clean_sha FROM (
  SELECT doc_id, CASE WHEN length(t) > 160 THEN left(t, 159) || '…' ELSE t END AS c FROM (
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\n\\t]', ' ', 'g'), '[\\p{C}]', '', 'g'), ' +', ' ', 'g')) AS t FROM documents))""")
def clean_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.clean_text(F.col("text"), 160)
    return B.table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select(
        "doc_id", F.length("c").alias("n"), F.sha1("c").alias("clean_sha")
    )


@query("template_summary", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name || 'がトレンドに浮上しています。(スコア: ' || printf('%.1f', p_size / 4.0) || ')'
  ELSE p_name || 'が' || p_brand || CASE WHEN p_size % 2 = 0 THEN '・' || p_type ELSE '' END || 'で注目されています。(スコア: ' || printf('%.1f', p_size / 4.0) || ')' END AS summary
  FROM (SELECT * REPLACE (p_size * 2 AS p_size) FROM part)""")
def template_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size") * 2)
    size = F.col("p_size")
    buckets = F.when(size % 5 == 0, F.array().cast("array<string>")).otherwise(
        F.filter(F.array(F.col("p_brand"), F.when(size % 2 == 0, F.col("p_type"))), lambda b: b.isNotNull())
    )
    return p.select("p_partkey", T.template_summary(F.col("p_name"), size / 4.0, buckets).alias("summary"))


@query("safe_urls", """WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(url, '://', '://user@') WHEN 1 THEN replace(url, 'http', 'javascript')
    WHEN 2 THEN 'http://10.0.' || (page_id % 200) || '.1/x' ELSE url END AS url FROM pages)
SELECT page_id, CASE WHEN page_id % 6 IN (0, 1, 2) THEN '' ELSE regexp_replace(url, '#.*$', '') END AS safe FROM u""")
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, url = F.col("page_id"), F.col("url")
    made = (
        F.when(p % 6 == 0, F.replace(url, F.lit("://"), F.lit("://user@")))
        .when(p % 6 == 1, F.replace(url, F.lit("http"), F.lit("javascript")))
        .when(p % 6 == 2, F.concat(F.lit("http://10.0."), p % 200, F.lit(".1/x")))
        .otherwise(url)
    )
    return B.table(spark, sf_dir, "pages").select("page_id", urls.safe_url(made).alias("safe"))


@query("bracket_aliases", f"""WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '（' || p_brand || '）' WHEN p_partkey % 3 = 1 THEN p_name || ' (' || p_type || ')(' || p_brand || ')!' ELSE p_name END AS n FROM part)
SELECT p_partkey, {S.norm_name("trim(regexp_replace(n, '[（(][^）)]+[）)]', '', 'g'))")} AS canonical,
  array_to_string(regexp_extract_all(n, '[（(]([^）)]+)[）)]', 1), '|') AS aliases FROM b""")
def bracket_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = (
        F.when(k % 3 == 0, F.concat("p_name", F.lit("（"), "p_brand", F.lit("）")))
        .when(k % 3 == 1, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")("), "p_brand", F.lit(")!")))
        .otherwise(F.col("p_name"))
    )
    canonical, aliases = T.bracket_aliases(F.col("n"))
    return B.table(spark, sf_dir, "part").select("p_partkey", name.alias("n")).select(
        "p_partkey", canonical.alias("canonical"), F.array_join(aliases, "|").alias("aliases")
    )


# --- payloads ---------------------------------------------------------------------------------------

_ANCHOR = r'<a[^>]*href="/([^"]*)"[^>]*>'


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(B.table(spark, sf_dir, "pages").withColumnRenamed("html", "body"))


@query("page_items", f"""WITH h AS (
  SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) AS rank FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]*href="/([^"]*)"[^>]*>', 1) AS l FROM pages)),
c AS (SELECT page_id, rank, {S.trim("regexp_replace(raw, '[ ]+', ' ', 'g')")} AS keyword FROM h),
k AS (SELECT *, {S.norm_topic('keyword')} AS n1 FROM c), k2 AS (SELECT *, {S.norm_topic('n1')} AS n2 FROM k)
SELECT page_id, keyword, min(rank) AS rank FROM k2 WHERE keyword <> '' AND {S.keep_parts('n1', 'n2')} GROUP BY ALL""")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.keyword_items(_pages(spark, sf_dir), _ANCHOR, 1)


@query("page_fields", """WITH r AS (
  SELECT page_id, unnest(l) AS row, generate_subscripts(l, 1) AS ordinal FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>.*?</li>') AS l FROM pages))
SELECT page_id, ordinal, regexp_extract(row, 'href="([^"]*)"', 1) AS href, regexp_extract(row, '>([^<>]+)</a>', 1) AS label, ordinal AS rank FROM r""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"href": (r'href="([^"]*)"', 1), "label": (r">([^<>]+)</a>", 1), "rank": (r"data-rank=\"(\d+)\"", 1)}
    return X.table_rows(_pages(spark, sf_dir), r"(?s)<li>.*?</li>", fields)


@query("page_titles", """WITH h AS (
  SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) AS rank FROM (SELECT page_id, regexp_extract_all(html, '(?is)<title>([^<]+)</title>', 1) AS l FROM pages))
SELECT page_id, count(*) AS titles, min(rank) AS best_rank FROM h WHERE trim(raw) <> '' GROUP BY ALL""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = X.title_items(_pages(spark, sf_dir), ("MDPR",))
    return items.groupBy("page_id").agg(F.count("*").alias("titles"), F.min("rank").alias("best_rank"))


@query("product_items", """SELECT p_partkey, 1 AS rank, p_name AS item_name, p_brand AS brand, p_type AS category FROM part""")
def product_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages rendered from parts; odd parts only carry the script JSON."""
    tag = F.format_string('<ul><li class="x" data-item-name="%s" data-brand="%s" data-category="%s"></li></ul>', "p_name", "p_brand", "p_type")
    script = F.format_string('<script>{"itemName": "%s", "n": 1, "shopName": "%s", "categoryName": "%s"}</script>', "p_name", "p_brand", "p_type")
    pages = B.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 2 == 0, tag).otherwise(script).alias("body")
    )
    return X.product_items(pages, "p_partkey")


@query("show_items", """SELECT p_partkey, p_size AS rank, p_name AS title, p_brand || ',' || p_type AS cast_names, CAST(floor(p_retailprice) AS BIGINT) AS points FROM part""")
def show_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programme tables rendered from parts, parsed back to rank, title, cast and points."""
    row = F.format_string(
        "<table><tr><td>%d位</td><td><h4 class='t'>%s</h4><div>最新回出演者 <a href='#'>%s</a> <a href='#'>%s</a></div><div>7</div><div>%d</div></td></tr><tr><td>x</td></tr></table>",
        F.col("p_size"), F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.floor("p_retailprice").cast("long"),
    )
    items = X.show_items(B.table(spark, sf_dir, "part").select("p_partkey", row.alias("body")), "p_partkey")
    return items.select("p_partkey", "rank", "title", F.array_join("cast", ",").alias("cast_names"), F.col("points").cast("long").alias("points"))


@query("chart_union", """WITH hot AS (SELECT p_name AS track, p_brand AS artist, min(p_size * 100000 + p_partkey) AS rank FROM part WHERE p_type <> 'SMALL' GROUP BY ALL),
art AS (SELECT p_name AS track, p_brand AS artist, min(p_partkey) AS rank FROM part GROUP BY ALL)
SELECT coalesce(h.track, a.track) AS track, coalesce(h.artist, a.artist) AS artist, CASE WHEN h.track IS NULL THEN 1 ELSE 0 END AS surface_order, coalesce(h.rank, a.rank) AS rank
FROM hot h FULL OUTER JOIN art a ON a.track = h.track AND a.artist = h.artist""")
def chart_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "part")
    cols = [F.col("p_name").alias("track"), F.col("p_brand").alias("artist")]
    hot = p.where(F.col("p_type") != "SMALL").select(*cols, (F.col("p_size") * 100000 + F.col("p_partkey")).alias("rank"))
    return X.merge_chart_surfaces([hot, p.select(*cols, F.col("p_partkey").alias("rank"))])


@query("json_feed_items", """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank,
  'part' || l_partkey AS name, 'supp' || l_suppkey AS "artistName" FROM lineitem QUALIFY rank <= 5""")
def json_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON feeds (one per order) parsed back to ranked items, five per feed."""
    li = B.table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = li.withColumn("n", F.row_number().over(w))
    item = F.struct(
        "n", F.concat(F.lit("part"), "l_partkey").alias("name"), F.concat(F.lit("supp"), "l_suppkey").alias("artistName")
    )
    feeds = rows.groupBy("l_orderkey").agg(
        F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(item)).alias("results")).alias("feed"))).alias("body")
    )
    schema = "feed struct<results: array<struct<name: string, artistName: string>>>"
    return X.json_feed_items(feeds, schema, "feed.results", 5, "l_orderkey")


@query("xml_items", """SELECT p_partkey, unnest([1, 2]) AS rank, unnest([p_name, p_type]) AS title, unnest([p_size || '+', '']) AS traffic,
  unnest(['https://n.example/' || p_partkey, '']) AS url FROM part WHERE p_partkey % 5 <> 0""")
def xml_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS rendered from parts; every fifth body is malformed and yields nothing."""
    body = F.format_string(
        '<rss><channel><item><title>%s</title><ht:approx_traffic>%d+</ht:approx_traffic><ht:news_item><ht:news_item_url>https://n.example/%d</ht:news_item_url></ht:news_item></item><item><title>%s</title></item></channel></rss>',
        F.col("p_name"), F.col("p_size"), F.col("p_partkey"), F.col("p_type"),
    )
    broken = F.when(F.col("p_partkey") % 5 == 0, F.replace(body, F.lit("</channel>"), F.lit(""))).otherwise(body)
    return X.rss_items(B.table(spark, sf_dir, "part").select("p_partkey", broken.alias("body")), "p_partkey")


@query("sitemap_items", """SELECT p_partkey, 1 AS rank, p_name AS title, 'https://s.example/article/' || replace(p_name, ' ', '-') || '/' AS url FROM part""")
def sitemap_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    body = F.concat(
        F.lit("<urlset><url><loc>https://s.example/tag/x</loc></url><url><loc>https://s.example/article/"), slug,
        F.lit("/</loc></url><url><loc>https://s.example/article/2/"), slug, F.lit("</loc></url></urlset>"),
    )
    return X.sitemap_items(B.table(spark, sf_dir, "part").select("p_partkey", body.alias("body")), "p_partkey")


@query("surface_rows", f"""WITH p AS (SELECT *, ['hashtag', 'song', 'creator', 'video'][p_partkey % 4 + 1] AS surface FROM part WHERE p_size > 3),
r AS (SELECT p_partkey AS page_id, p_size - 3 AS rank, surface, CASE surface WHEN 'hashtag' THEN '#' || p_name WHEN 'song' THEN p_name WHEN 'creator' THEN p_brand ELSE p_type END AS name,
  CASE WHEN surface = 'song' THEN p_brand ELSE '' END AS artist, CASE WHEN surface = 'video' THEN '#' || p_brand ELSE '' END AS hashtags FROM p),
n AS (SELECT *, {S.norm_topic('name')} AS n1 FROM r), n2_ AS (SELECT *, {S.norm_topic('n1')} AS n2 FROM n)
SELECT page_id, rank, surface, name, artist, hashtags FROM n2_ WHERE surface <> 'hashtag' OR {S.keep_parts('n1', 'n2')}""")
def surface_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API rows with alternative field names, one surface per part."""
    surface = B._pick(("hashtag", "song", "creator", "video"), F.col("p_partkey") % 4)
    none = F.lit(None).cast("string")
    rows = B.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"), (F.col("p_size") - 3).alias("rank"), surface.alias("surface"),
        F.col("p_name").alias("hashtag_name"), F.lit("").alias("song_name"), F.col("p_name").alias("music_name"),
        F.col("p_type").alias("title"), F.col("p_name").alias("name"), F.col("p_brand").alias("creator_name"),
        none.alias("author_name"), none.alias("nickname"), F.lit("").alias("video_desc"), none.alias("video_name"),
        none.alias("artist_name"), F.array("p_brand").alias("hashtags"),
    )
    df = X.surface_rows(rows)
    return df.select(
        "page_id", "rank", "surface", "name", "artist",
        F.when(F.col("surface") == "video", F.array_join("hashtags", ",")).otherwise("").alias("hashtags"),
    )


_REGIONAL = f"""
rev AS (
  SELECT {S.pick(dims.ASIA_COUNTRIES, 'c_nationkey % 10')} AS country, 'part' || l_partkey AS key, sum(l_extendedprice * (1 - l_discount)) AS revenue
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
lists AS (SELECT country, key, row_number() OVER (PARTITION BY country ORDER BY round(revenue, 4) DESC, key) AS rank FROM rev),
merged AS (
  SELECT key, sum(1 / log2(rank + 1) * CASE WHEN country = 'JP' THEN 1.0 ELSE 0.6 END) AS regional_score, count(*) AS n_countries, min(rank) AS best_rank,
    string_agg(country || ':' || rank, ',' ORDER BY CASE WHEN country = 'JP' THEN 0 ELSE 1 END, rank, country) AS regions
  FROM lists GROUP BY ALL HAVING max(CASE WHEN country = 'JP' THEN 1 ELSE 0 END) = 1 OR count(*) >= 2)
"""


def _regional_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per country (by customer nation) all parts by revenue."""
    li = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = B.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rev = (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(cust, F.col("o_custkey") == cust.c_custkey)
        .groupBy(B._pick(dims.ASIA_COUNTRIES, F.col("c_nationkey") % 10).alias("country"), F.concat(F.lit("part"), "l_partkey").alias("key"))
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
    )
    w = Window.partitionBy("country").orderBy(F.desc("revenue"), "key")
    return rev.withColumn("rank", F.row_number().over(w)).drop("revenue")


@query("regional_merge", f"""WITH {_REGIONAL}
SELECT key, row_number() OVER (ORDER BY round(regional_score, 9) DESC, n_countries DESC, best_rank, key) AS merged_rank, round(regional_score, 6) AS regional_score,
  n_countries, best_rank, 'rank:' || row_number() OVER (ORDER BY round(regional_score, 9) DESC, n_countries DESC, best_rank, key) || '|regions:' || regions AS metric
FROM merged QUALIFY merged_rank <= 20""")
def regional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = X.merge_regions(_regional_lists(spark, sf_dir))
    metric = X.regions_metric(F.col("merged_rank"), F.col("country_ranks"))
    return merged.select("key", "merged_rank", r6("regional_score"), "n_countries", "best_rank", metric.alias("metric"))


@query("query_variants", """WITH t AS (SELECT o_orderkey, o_orderpriority || '/' || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN '、' || o_custkey || ' | x,y・z' ELSE '' END AS title FROM orders WHERE o_orderkey % 1 = 0)
SELECT o_orderkey, array_to_string(list_filter(list_transform(string_split_regex(title, '[／/・,，、|｜]'), lambda p: trim(p)), lambda p: p <> '')[1:5], ';') AS variants FROM t""".replace(" WHERE o_orderkey % 1 = 0", ""))
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(
        F.col("o_orderpriority"), F.lit("/"), F.col("o_orderstatus"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("、"), F.col("o_custkey").cast("string"), F.lit(" | x,y・z"))).otherwise(""),
    )
    return B.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.query_variants(title), ";").alias("variants"))


@query("trend_rows", """SELECT p_partkey, p_name || '・' || p_type AS title, 1 AS rank, p_size || 'K+' AS volume, p_brand AS started, p_name || ';' || p_type AS query_variants, 2 AS breakdown_count,
  'rank:1,volume:' || p_size || 'K+,started:' || p_brand AS metric FROM part""")
def trend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend pages rendered from parts in both known layouts."""
    title = F.concat("p_name", F.lit("・"), "p_type")
    attrs = F.format_string('<div data-term="%s" x data-search-volume="%dK+" data-started="%s"></div>', title, F.col("p_size"), F.col("p_brand"))
    cells = F.format_string("<table><tr class='r'><td>%s</td> <td>%dK+</td><td>%s</td></tr></table>", title, F.col("p_size"), F.col("p_brand"))
    body = F.when(F.col("p_partkey") % 2 == 0, attrs).otherwise(cells)
    rows = X.trend_rows(B.table(spark, sf_dir, "part").select("p_partkey", body.alias("body")), "p_partkey")
    return rows.select(
        "p_partkey", "title", "rank", "volume", "started", joined("query_variants", ";"), "breakdown_count",
        X.trend_metric(F.col("rank"), F.col("volume"), F.col("started")).alias("metric"),
    )


@query("embedded_json", """SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN '' ELSE role || turn END AS names FROM conversations""")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array alone, fenced, or inside a sentence around the whole turn text."""
    payload = F.format_string('[{"name": "%s%d"}]', F.col("role"), F.col("turn").cast("int"))
    # Brackets and fences of the turn itself are blanked, so the array is the only one.
    prose = F.regexp_replace("text", r"[\[\]`]", " ")
    t = F.col("turn") % 4
    text = (
        F.when(t == 0, payload).when(t == 1, F.concat(prose, F.lit("\n```json\n"), payload, F.lit("\n```\nend")))
        .when(t == 2, F.concat(prose, F.lit(" see "), payload, F.lit(" end"))).otherwise(prose)
    )
    arr = X.embedded_json(text, "array<struct<name: string>>")
    return B.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(F.transform(arr, lambda x: x["name"]), ",").alias("names")
    )


_ALLOW = {"publishers": ["Brand#1", "Brand#2", "Brand#3"], "titles": ["red widget"], "deny_terms": ["ring"]}


@query("allow_deny", """SELECT p_partkey, p_name AS title, p_brand AS publisher FROM part
WHERE NOT contains(lower(p_name), 'ring') AND (p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') OR p_name = 'red widget')""")
def allow_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = B.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"))
    return X.allowed_publications(items, _ALLOW)


def _fanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = B.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), F.col("p_size").alias("rank"), F.col("p_name").alias("item_name"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("brand"),
    )
    return X.fan_out(items, X.PRODUCT_PARTS["fashion"], keep=("ordinal",))


_FAN = """fan AS (
  SELECT p_partkey AS ordinal, p_size AS rank, 'PRODUCT' AS candidate_type, p_name AS name, 1 / log2(greatest(p_size, 1) + 1) AS metric_value FROM part
  UNION ALL SELECT p_partkey, p_size, 'BRAND', p_brand, 1 / log2(greatest(p_size, 1) + 1) * 0.75 FROM part WHERE p_partkey % 4 <> 0)"""


@query("candidate_fanout", f"WITH {_FAN} SELECT ordinal, rank, candidate_type, name, round(metric_value, 6) AS metric_value FROM fan")
def candidate_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fanned(spark, sf_dir).select("ordinal", "rank", "candidate_type", "name", r6("metric_value"))


@query("show_fanout", """SELECT p_partkey, p_size AS rank, unnest(['SHOW', 'PERSON', 'PERSON']) AS candidate_type, unnest([p_name, p_brand, p_type]) AS name,
  round(1 / log2(greatest(p_size, 1) + 1) * unnest([1.0, 0.22, 0.22]), 6) AS metric_value, 'show:' || p_size || ':' || p_name AS work_cluster_id FROM part""")
def show_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = B.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("rank"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("cast")
    )
    return X.fan_out_shows(items, "p_partkey", emit_cast=True).select(
        "p_partkey", "rank", "candidate_type", "name", r6("metric_value"), "work_cluster_id"
    )


@query("topic_fanout")
def topic_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles to at most three topics each, with LOW confidence raised."""
    items = X.title_items(_pages(spark, sf_dir), ("MDPR",))
    return topics.raise_confidence(topics.extract_topics(items, "title", keep=("page_id", "rank"), limit=3))


@query("signal_rollup", f"""WITH {_FAN}
SELECT candidate_type, name, round(sum(metric_value), 6) AS exposure_signal, round(ln(1 + count(*)), 6) AS mention_signal, min(ordinal) AS first_ordinal FROM fan GROUP BY ALL""")
def signal_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fan = _fanned(spark, sf_dir)
    keys = ("candidate_type",)
    counts = X.roll_up_signals(fan, keys, "mentions").select("candidate_type", "name", F.round("signal", 6).alias("mention_signal"))
    sums = X.roll_up_signals(fan, keys).select("candidate_type", "name", F.round("signal", 6).alias("exposure_signal"), "first_ordinal")
    return sums.join(counts, ["candidate_type", "name"])


@query("payload_fingerprint", """SELECT page_id, strlen(html) AS response_bytes, left(sha1(html), 16) AS body_hash, sha1(left(html, 512)) AS excerpt_sha,
  left(sha1('page|' || page_id || '|' || url), 16) AS item_id FROM pages""")
def payload_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.fingerprint(_pages(spark, sf_dir))
    ident = X.item_id(F.lit("page"), F.col("page_id").cast("string"), F.col("url"))
    return df.select("page_id", "response_bytes", "body_hash", F.sha1("body_excerpt").alias("excerpt_sha"), ident.alias("item_id"))


@query("attention_baseline", """SELECT 'user' || user_id AS title, count(*) AS views, round(ln(1 + count(*)), 6) AS attention FROM events
WHERE event_type = 'view' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY ALL""")
def attention_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = B.table(spark, sf_dir, "events").where(F.col("event_type") == "view").select(
        F.concat(F.lit("user"), "user_id").alias("title"), F.to_date("ts").alias("date"), F.lit(1).cast("long").alias("views")
    )
    return X.attention_baseline(views, "2024-01-05", "2024-01-25").select("title", "views", r6("attention"))
