"""Text functions, topic extraction and payload parsing on small fixtures."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.functions import text as T
from swellcast.functions import urls
from swellcast.functions.unicode import html_unescape, sequence_ratio
from swellcast.operators import topics
from swellcast.sources import payloads as X


def values(spark, rows, *cols, schema="t string"):
    return spark.createDataFrame([(r,) for r in rows], schema).select(*cols).collect()


def norm(t):
    t = unicodedata.normalize("NFKC", t or "").strip()
    t = re.sub("[\U00010000-\U0010ffff]", "", t)
    t = re.sub(r"[\"'`“”‘’\[\]\(\)【】<>＜＞]", " ", t)
    t = re.sub(r"[!！?？…。．・〜~]+$", "", t)
    t = re.sub(r"\s+", " ", t).strip()
    for suffix, lemma in dims.LEMMA_RULES:
        if t.endswith(suffix):
            return t[: -len(suffix)] + lemma
    return t


def key(t):
    return re.sub(r"[\s_\-・:：/／]+", "", norm(t).lower().replace("#", ""))


def keep(t):
    n = norm(t)
    tag = norm(n)
    tag = (tag[1:] if tag.startswith("#") else tag).lower()
    low = norm(n).lower()
    drop = [*dims.KEYWORDS["generic_event_keywords"], *dims.LIVE_WORDS, *dims.FINANCE_WORDS]
    return bool(n) and tag not in dims.STOP_PHRASES and n.lower() not in dims.STOP_PHRASES and not any(
        w.lower() in low for w in drop) and len(key(n)) > 1


SURFACES = [
    "ラブブをつけてる!!!", "#平成 レトロ", "ランキング", "ＡＢＣ　ｄｅｆ・", "試合速報", "株価の話", "x", "", "【公式】した",
    "𝕏絵文字😀を持ってる", "ぬい活してる…", "view more", "  spaced\t\nout  ", "\"quoted\" (した)", "コラボ限定してる",
    "AA した。", "abc! !", "ﾊﾝｶｸ",
]


def test_topic_functions_match_plain_python(spark):
    t = F.col("t")
    rows = values(spark, SURFACES, "t", T.normalize_topic(t).alias("n"), T.topic_key(t).alias("k"), T.keep_topic(t).alias("keep"))
    for r in rows:
        assert (r.n, r.k, r.keep) == (norm(r.t), key(r.t), keep(r.t)), r.t


def test_names_and_brackets(spark):
    t = F.col("t")
    canonical, aliases = T.bracket_aliases(t)
    rows = values(
        spark, ["timelesz（タイムレス）", "YOASOBI (ヨアソビ)", "plain name", "Ｓｎｏｗ　Ｍａｎ！"],
        canonical.alias("c"), aliases.alias("a"), T.match_key(t).alias("k"),
    )
    assert [(r.c, r.a) for r in rows[:3]] == [("timelesz", ["タイムレス"]), ("YOASOBI", ["ヨアソビ"]), ("plain name", [])]
    assert rows[3].k == "snowman"


def test_proper_nouns_and_urls(spark):
    names = {"IU": True, "iu": True, "ab": False, "12345": False, "!!!": False, "News": False, "これが": False, "ヒカキン": True}
    got = values(spark, list(names), "t", T.is_proper_noun(F.col("t")).alias("p"))
    assert {r.t: r.p for r in got} == names
    cases = {
        "https://e.com/a?b=1#c": "https://e.com/a?b=1", "javascript:alert(1)": "", "http://127.0.0.1/": "", "http://[::1]/": "",
        "http://172.20.1.1/": "", "http://172.32.1.1/x": "http://172.32.1.1/x", "https://u:p@e.com/": "", "http://printer.local/": "",
        "": "", "https://e.com/" + "a" * 2100: "",
    }
    got = values(spark, list(cases), "t", urls.safe_url(F.col("t")).alias("u"))
    assert {r.t: r.u for r in got} == cases


TEXTS = [
    "今日は #ぬい活 と #平成レトロ が流行。推し活する人が増えた! 「限定バッグ」を買う",
    "ラブブをつけてる子が多い。シール交換が人気 コーデ を見る",
    "plain english words repeated plain english words, and 速報 の 発売 news",
    "",
    "word " * 400 + "最後の一言チャレンジ",
    "発売 " * 300 + "tail one two",
]


def topic_walk(text, limit=10):
    out, seen = [], set()

    def behaviors():
        found = []
        for tail in dims.BEHAVIOR_TAILS:
            for m in re.findall(rf"([^\s、。!！?？]{{1,20}}?{tail})", text):
                n = norm(m)
                if keep(n) and n not in found:
                    found.append(n)
        return found

    def tags():
        found = []
        for raw in re.findall(r"(#[\wぁ-んァ-ン一-龥ー]+)", text):
            n = norm(raw)
            n = n if n.startswith("#") else f"#{n}"
            if keep(n) and n not in found:
                found.append(n)
        return found

    def cls(s):
        n = norm(s)
        for name, words in (("STYLE", dims.STYLE_TOKENS), ("PRODUCT", dims.PRODUCT_TOKENS), ("BRAND", dims.BRAND_TOKENS), ("BEHAVIOR", dims.BEHAVIOR_TOKENS)):
            if any(w in n for w in words):
                return name
        return "PHRASE"

    free = re.findall("[「『“\"]([^」』”\"]{2,24})[」』”\"]", text) + re.findall(r"([^\s、。!！?？]{2,24})", text)
    stream = [("HASHTAG", t) for t in tags()] + [("BEHAVIOR", b) for b in behaviors()] + [(cls(f), f) for f in free]
    for kind, surface in stream:
        n = norm(surface)
        if keep(n) and (kind, n) not in seen:
            seen.add((kind, n))
            out.append((kind, surface if kind == "HASHTAG" else n))
            if len(out) == limit:
                break
    return out


def test_topic_extraction_matches_walk_over_whole_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {}
    for r in topics.extract_topics(df, keep=("id",)).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((r.candidate_type, r.name))
    for i, text in enumerate(TEXTS):
        assert got.get(i, []) == topic_walk(text), text[:40]


def test_topic_class_reads_the_normalised_surface(spark):
    t = F.col("t")
    rows = values(spark, SURFACES, "t", T.topic_class_nf(t).alias("whole"), T.topic_class_of(T.normalize_topic_nf(t)).alias("shared"))
    assert [r.whole for r in rows] == [r.shared for r in rows]
    df = spark.createDataFrame([(0, "word " * 50 + "and " * 50 + " ".join(f"t{i} same" for i in range(12)))], "id int, text string")
    got = [(r.candidate_type, r.name) for r in topics.extract_topics(df, keep=("id",)).orderBy("position").collect()]
    assert got == topic_walk(df.first().text)


def test_phrase_mining_falls_back(spark):
    df = spark.createDataFrame([(0, "ラブブ人形が好き"), (1, "")], "id int, text string")
    rows = topics.mine_topics(df, keep=("id",)).collect()
    assert {r.id for r in rows} == {0}
    mined = values(spark, ["サンリオ ラブブ #推しが一番"], T.mined_phrases(F.col("t")).alias("m"))[0].m
    assert mined[0] == "#推し" and "サンリオ" in mined and "ラブブ" in mined


def test_tagger_hook(spark):
    def tagger(batches):
        for pdf in batches:
            hit = pdf[pdf.text.str.contains("IU")]
            yield hit.assign(name="IU", entity_type="PERSON")[["id", "name", "entity_type"]]

    df = spark.createDataFrame([(1, "IU sings"), (2, "none")], "id int, text string")
    rows = topics.tag_entities(df, tagger, "id int, name string, entity_type string").collect()
    assert [(r.id, r.name) for r in rows] == [(1, "IU")]


def test_keyword_and_product_pages(spark):
    body = (
        '<span class="keyword">A&amp;B</span><span class="x word">速報 発売</span><a href="/realtime/search?p=1">ぬい活</a>'
        '<span class="word">A&amp;B</span>'
    )
    items = X.keyword_items(values_df(spark, body), X.REALTIME_WORD, 3).orderBy("rank").collect()
    assert [(r.keyword, r["rank"]) for r in items] == [("A&B", 1), ("ぬい活", 3)]
    tag = '<li data-item-name="Bag" data-brand="X" data-category="c"></li><li data-item-name="Cap" data-brand=""></li>'
    got = X.product_items(values_df(spark, tag)).orderBy("rank").collect()
    assert [(r.item_name, r.brand, r.category) for r in got] == [("Bag", "X", "c"), ("Cap", "", "")]


def values_df(spark, body):
    return spark.createDataFrame([(1, body)], "page_id int, body string")


def test_stream_and_music_tables(spark):
    html = '<table><tr><td class="rank">01</td><td class="title">Show A</td></tr><tr><td class="rank">x</td><td class="title">Show B</td></tr></table>'
    rows = X.table_rows(values_df(spark, html), X.TABLE_ROW, X.STREAM_FIELDS).orderBy("ordinal").collect()
    assert [(r["rank"], r.title) for r in rows] == [(1, "Show A"), (2, "Show B")]
    html = '<tr data-rank="3"><td><span class="track-name"> T </span><span class="artist-name">A</span></td></tr>'
    row = X.table_rows(values_df(spark, html), X.TABLE_ROW, X.MUSIC_FIELDS).first()
    assert (row["rank"], row.track, row.artist) == (3, "T", "A")


def test_regional_merge_order(spark):
    rows = [("KR", "#にほん", 3), ("JP", "#にほん", 1), ("TH", "#にほん", 4), ("JP", "#メガ割", 2), ("KR", "#한국", 1)]
    merged = X.merge_regions(spark.createDataFrame(rows, "country string, key string, rank int")).orderBy("merged_rank").collect()
    assert [r.key for r in merged] == ["#にほん", "#メガ割"]
    assert merged[0].country_ranks == {"JP": 1, "KR": 3, "TH": 4}


def test_embedded_json_forms(spark):
    cases = ['[{"name": "a"}]', 'x ```json\n[{"name": "b"}]\n``` y', 'see [{"name": "c"}] end', "nothing", "[broken"]
    rows = values(spark, cases, X.embedded_json(F.col("t"), "array<struct<name: string>>").alias("j"))
    assert [[x.name for x in r.j] for r in rows] == [["a"], ["b"], ["c"], [], []]


def test_small_functions(spark):
    assert values(spark, ["&lt;b&gt; &hearts; x"], html_unescape(F.col("t")).alias("u"))[0].u == "<b> ♥ x"
    assert values(spark, ["a\x00b​c  d\ne"], T.clean_text(F.col("t"), 100).alias("c"))[0].c == "abc d e"
    r = spark.range(1).select(sequence_ratio(F.lit("abcd"), F.lit("abxcd")).alias("r")).first().r
    assert r == pytest.approx(8 / 9)


def test_topic_scores_normalise_three_times(spark):
    rows = [(t,) for t in ("", " #Tokyo event ", "limited bag tour", "の発売 event!!", "ゴール live show", "「推し活」の  メイク", "a", None)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    one = df.select(T.specificity_nf(t), T.objectness_nf(t), T.genericity_nf(t), T.live_bias_nf(t))
    together = df.select(T.topic_scores_nf(t).alias("s")).select("s.*")
    assert [tuple(r) for r in together.collect()] == [tuple(r) for r in one.collect()]

    def normalised(frame):
        return frame._jdf.queryExecution().analyzed().toString().count("\"'`“")

    assert normalised(together) * 2 < normalised(one)


def test_words_meet_the_names_before_the_shuffle(spark):
    texts = spark.createDataFrame([(1, "cd Ab cd. ab"), (2, "zz"), (3, None)], "k int, t string")
    names = spark.createDataFrame([("ab", "GROUP"), ("cd", "PRODUCT")], "name string, entity_type string")
    tags = topics.gazetteer_tags(texts, names, "k", "t")
    assert {tuple(r) for r in tags.collect()} == {(1, 1, "cd", "PRODUCT"), (1, 2, "ab", "GROUP")}
    plan = tags._jdf.queryExecution().optimizedPlan().toString()
    # A plan prints what comes later first: only words that are names are grouped.
    assert plan.index("min(pos") < plan.index("Join Inner")
