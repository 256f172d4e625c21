"""Surface text as column expressions: keys, keep tests, specificity, classes.

Functions named ``*_nf`` expect text that is already NFKC-normalised and stay
inside the JVM, so they can run inside higher-order array functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.functions.numeric import any_of, clamp
from swellcast.functions.unicode import nfkc, nfkc_each

# --- Fixed values: patterns ------------------------------------------------------------
# Every character Unicode counts as white space (and the ASCII separators 1C to 1F).
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# White space that is not already one plain blank, so ordinary gaps cost no replacement.
SPACE = r"(?U)[\s\x1c-\x1f]{2,}|[[\s\x1c-\x1f]&&[^ ]]"
NAME_TAIL = "!?！？。、…"
NAME_SEPARATORS = WHITE + "-_・:：/／"
BRACKET = r"[（\(]([^）\)]+)[）\)]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
TOPIC_NOISE = "\"'`“”‘’[]()【】<>＜＞"
TOPIC_TAIL = "!！?？…。．・〜~"
TOPIC_SEPARATORS = WHITE + "_-・:：/／"
TOKEN = r"[ぁ-んァ-ン一-龥a-zA-Z0-9]+"
HASHTAG = r"(#[\p{L}\p{N}_ぁ-んァ-ン一-龥ー]+)"
QUOTED = "[「『“\"]([^」』”\"]{2,24})[」』”\"]"
PHRASE = r"(?U)([^\s、。!！?？]{2,24})"
MINED_PHRASE = r"(?U)([^\s、。!！?？]{2,20})"
KATAKANA = r"([ァ-ヴー]{3,}(?:[ァ-ヴー]+)*)"
HASHTAG_PARTICLE = r"(が|を|で|と|は|に|も).*$"
DELIMITERS = r"(?U)[\s、。!！?？]+"
BEHAVIORS = tuple(rf"(?U)([^\s、。!！?？]{{1,20}}?{tail})" for tail in dims.BEHAVIOR_TAILS)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (keeps expression trees small)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Substring test against a fixed word list.

    A chain of byte searches: far cheaper on long texts than a regex alternation.
    """
    lowered = [w.lower() for w in words]
    return let(text, lambda t: any_of([t.contains(w) for w in lowered]))


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def remove_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


# --- names -------------------------------------------------------------------------------


def normalize_name_nf(text: Column) -> Column:
    t = F.regexp_replace(trim_space(text), SPACE, " ")
    return trim_space(F.rtrim(t, F.lit(NAME_TAIL)))


def normalize_name(text: Column) -> Column:
    return normalize_name_nf(nfkc(text))


def match_key_nf(text: Column) -> Column:
    return remove_chars(F.lower(normalize_name_nf(text)), NAME_SEPARATORS)


def match_key(text: Column) -> Column:
    return match_key_nf(nfkc(text))


def bracket_aliases(text: Column) -> tuple[Column, Column]:
    """``name（alias）`` to (canonical name, array of aliases)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(BRACKET), F.lit(1)), lambda v: trim_space(v))
    canonical = normalize_name(trim_space(F.regexp_replace(text, BRACKET, "")))
    return canonical, F.filter(found, lambda v: v != "")


# --- topics ------------------------------------------------------------------------------


def lemmatize(text: Column) -> Column:
    """Rewrite one inflected ending to its dictionary form.

    The suffixes exclude each other, so one replacement per dictionary form is the
    same as an ordered rule list, and the input appears only once.
    """
    longest = max(len(s) for s, _ in dims.LEMMA_RULES)

    def rewrite(t: Column) -> Column:
        tail = F.right(t, F.lit(longest))
        for lemma in dict.fromkeys(lemma for _, lemma in dims.LEMMA_RULES):
            suffixes = "|".join(s for s, to in dims.LEMMA_RULES if to == lemma)
            tail = F.regexp_replace(tail, f"(?:{suffixes})$", lemma)
        return F.concat(F.left(t, F.length(t) - longest), tail)

    # Most texts end in none of the suffixes and pass through untouched.
    last = "|".join(sorted({s[-1] for s, _ in dims.LEMMA_RULES}))
    return let(text, lambda t: F.when(F.right(t, F.lit(1)).rlike(last), rewrite(t)).otherwise(t))


def normalize_topic_nf(text: Column) -> Column:
    t = F.regexp_replace(trim_space(F.coalesce(text, F.lit(""))), ASTRAL, "")
    t = F.translate(t, TOPIC_NOISE, " " * len(TOPIC_NOISE))
    t = F.rtrim(t, F.lit(TOPIC_TAIL))
    return lemmatize(trim_space(F.regexp_replace(t, SPACE, " ")))


def normalize_topic(text: Column) -> Column:
    return normalize_topic_nf(nfkc(text))


def _strip_hash(normalized: Column) -> Column:
    return F.lower(F.regexp_replace(normalized, "^#", ""))


def _key_of(normalized: Column) -> Column:
    return remove_chars(F.lower(normalized), "#" + TOPIC_SEPARATORS)


def hashtag_key_nf(text: Column) -> Column:
    return _strip_hash(normalize_topic_nf(text))


def topic_key_nf(text: Column) -> Column:
    return _key_of(normalize_topic_nf(text))


def topic_key(text: Column) -> Column:
    return topic_key_nf(nfkc(text))


def _event(normalized: Column) -> Column:
    return contains_any(F.lower(normalized), dims.KEYWORDS["generic_event_keywords"])


def _live(normalized: Column) -> Column:
    return contains_any(F.lower(normalized), dims.LIVE_WORDS)


def _finance(normalized: Column) -> Column:
    return contains_any(F.lower(normalized), dims.FINANCE_WORDS)


def has_event_word(text: Column) -> Column:
    return _event(normalize_topic_nf(text))


def has_live_word(text: Column) -> Column:
    return _live(normalize_topic_nf(text))


def has_finance_word(text: Column) -> Column:
    return _finance(normalize_topic_nf(text))


_DROP_WORDS = (*dims.KEYWORDS["generic_event_keywords"], *dims.LIVE_WORDS, *dims.FINANCE_WORDS)


def keep_topic_nf(text: Column) -> Column:
    """Whether a surface is worth tracking. Every test normalises its own input again."""

    def inner(once: Column) -> Column:
        return (
            (once != "")
            & ~F.lower(once).isin(*dims.STOP_PHRASES)
            & let(
                normalize_topic_nf(once),
                lambda twice: ~_strip_hash(twice).isin(*dims.STOP_PHRASES)
                & ~contains_any(F.lower(twice), _DROP_WORDS)
                & (F.length(_key_of(twice)) > 1),
            )
        )

    return let(normalize_topic_nf(text), inner)


def keep_topic(text: Column) -> Column:
    return keep_topic_nf(nfkc(text))


def _specificity(once: Column, twice: Column) -> Column:
    core = F.length(_key_of(twice))
    tokens = F.size(F.regexp_extract_all(once, F.lit(TOKEN), F.lit(0)))
    value = F.least(F.lit(1.0), 0.18 * tokens + 0.04 * core)
    value = value * F.when(_strip_hash(twice).isin(*dims.STOP_PHRASES), 0.3).otherwise(1.0)
    value = value * F.when(_event(twice), 0.45).otherwise(1.0)
    value = value * F.when(_live(twice), 0.35).otherwise(1.0)
    return (
        F.when(once == "", 0.0)
        .when(core <= 2, 0.1)
        .otherwise(F.round(clamp(value, 0.0, 1.0), 4))
    )


def specificity_nf(text: Column) -> Column:
    """Score 0..1 of how specific a topic surface is."""
    return let(
        normalize_topic_nf(text),
        lambda once: let(normalize_topic_nf(once), lambda twice: _specificity(once, twice)),
    )


def _objectness(once: Column) -> Column:
    low = F.lower(once)
    return (
        F.when(once == "", 0.0)
        .when(contains_any(low, dims.KEYWORDS["behavior_object_blacklist"]), 0.15)
        .when(contains_any(low, dims.KEYWORDS["behavior_object_whitelist"]), 0.9)
        .when(once.rlike("[をの]"), 0.7)
        .when(once.rlike("(?:" + "|".join(dims.OBJECT_SUFFIXES) + ")$"), 0.6)
        .otherwise(0.35)
    )


def objectness_nf(text: Column) -> Column:
    """How concrete the object of a behaviour is."""
    return let(normalize_topic_nf(text), _objectness)


def _genericity(once: Column, twice: Column, specificity: Column) -> Column:
    words = dims.KEYWORDS["generic_phrase_blacklist"]
    return (
        F.when((once == "") | once.isin(*words), 1.0)
        .when(_event(twice), 0.8)
        .when(contains_any(F.lower(once), words), 0.75)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - specificity))
    )


def genericity_nf(text: Column) -> Column:
    return let(
        normalize_topic_nf(text),
        lambda once: let(normalize_topic_nf(once), lambda twice: _genericity(once, twice, specificity_nf(once))),
    )


def _live_bias(normalized: Column) -> Column:
    return F.when(_live(normalized), 1.0).when(_finance(normalized), 0.9).otherwise(0.0)


def topic_scores_nf(text: Column) -> Column:
    """specificity, objectness, genericity and live_bias as one struct.

    Equal to the four functions one by one, but they normalise a text nine times and this three times.
    """

    def scores(once: Column, twice: Column, thrice: Column) -> Column:
        return F.struct(
            _specificity(once, twice).alias("specificity"), _objectness(once).alias("objectness"),
            _genericity(once, twice, _specificity(twice, thrice)).alias("genericity"), _live_bias(twice).alias("live_bias"),
        )

    return let(normalize_topic_nf(text), lambda once: let(normalize_topic_nf(once), lambda twice: let(
        normalize_topic_nf(twice), lambda thrice: scores(once, twice, thrice))))


def live_bias_nf(text: Column, title: Column | None = None, surface: Column | None = None) -> Column:
    """1.0 for live or disaster coverage, 0.9 for finance or politics, else 0."""
    empty = F.lit("")
    parts = [
        normalize_topic_nf(empty if p is None else p) for p in (text, title, surface)
    ]
    return let(
        normalize_topic_nf(F.concat_ws(" ", *parts)),
        _live_bias,
    )


def topic_class_of(normalized: Column) -> Column:
    """Class of a surface that is normalised already."""

    def pick(t: Column) -> Column:
        has = lambda words: any_of([t.contains(w) for w in words])
        return (
            F.when(has(dims.STYLE_TOKENS), "STYLE")
            .when(has(dims.PRODUCT_TOKENS), "PRODUCT")
            .when(has(dims.BRAND_TOKENS), "BRAND")
            .when(has(dims.BEHAVIOR_TOKENS), "BEHAVIOR")
            .otherwise("PHRASE")
        )

    return let(normalized, pick)


def topic_class_nf(surface: Column) -> Column:
    return topic_class_of(normalize_topic_nf(surface))


def topic_confidence(topic_type: Column) -> Column:
    return (
        F.when(topic_type == "HASHTAG", "HIGH")
        .when(topic_type.isin("BEHAVIOR", "STYLE", "PRODUCT"), "MEDIUM")
        .otherwise("LOW")
    )


# --- extraction over whole texts -----------------------------------------------------------


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _normalized(raw: Column) -> Column:
    return F.transform(nfkc_each(raw), lambda v: normalize_topic_nf(v))


def _kept_distinct(surfaces: Column) -> Column:
    return F.array_distinct(F.filter(surfaces, lambda v: keep_topic_nf(v)))


def hashtags(text: Column) -> Column:
    """Distinct kept hashtags of a text, in first-seen order."""
    tagged = F.transform(
        _normalized(_all(text, HASHTAG)),
        lambda t: F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), t)),
    )
    return _kept_distinct(tagged)


def mined_hashtags(text: Column) -> Column:
    def cut(t: Column) -> Column:
        trimmed = F.regexp_replace(t, HASHTAG_PARTICLE, "")
        return F.when(t.startswith("#") & (trimmed != ""), trimmed).otherwise(t)

    return _kept_distinct(F.transform(_normalized(_all(text, HASHTAG)), cut))


def _holds(ending: str):
    return lambda piece: piece.contains(ending)


def _matches(pattern: str):
    return lambda piece: F.regexp_extract_all(piece, F.lit(pattern), F.lit(1))


def behavior_phrases(text: Column) -> Column:
    """Behaviour phrases in order of pattern, then position.

    A phrase never crosses a delimiter, so the lazy patterns only run on the pieces
    that hold one of their endings.
    """
    endings = [tail.split("(")[0] for tail in dims.BEHAVIOR_TAILS]
    pieces = F.filter(
        F.split(F.coalesce(text, F.lit("")), DELIMITERS),
        lambda p: any_of([p.contains(e) for e in dict.fromkeys(endings)]),
    )

    def found(ps: Column) -> Column:
        per_pattern = [
            F.flatten(
                F.transform(
                    F.filter(ps, _holds(ending)),
                    _matches(pattern),
                )
            )
            for ending, pattern in zip(endings, BEHAVIORS)
        ]
        return F.flatten(F.array(*per_pattern))

    return _kept_distinct(_normalized(let(pieces, found)))


def mined_phrases(text: Column, limit: int = 8) -> Column:
    parts = F.concat(
        mined_hashtags(text),
        behavior_phrases(text),
        _kept_distinct(_normalized(_all(text, KATAKANA))),
        _kept_distinct(_normalized(_all(text, MINED_PHRASE))),
    )
    return F.slice(F.array_distinct(parts), 1, limit)


# --- proper nouns and domains ------------------------------------------------------------------


def is_proper_noun(name: Column) -> Column:
    t = trim_space(name)
    hiragana_only = t.rlike("^[\\u3040-\\u309f ]*$")
    return (
        F.when(t.isin(*dims.PROPER_NOUN_WHITELIST), True)
        .when(F.upper(t).isin(*dims.PROPER_NOUN_WHITELIST), True)
        .when(F.length(t) <= 2, False)
        .when(t.rlike(r"^\p{Nd}+$"), False)
        .when(t.rlike(r"^[^\p{L}\p{N}]+$"), False)
        .when(F.lower(t).isin(*[w.lower() for w in dims.PROPER_NOUN_BLACKLIST]), False)
        .otherwise(~(hiragana_only & (F.length(t) <= 3)))
    )


def classify_domain(
    candidate_type: Column,
    family: Column,
    text: Column,
    title: Column | None = None,
    publisher: Column | None = None,
) -> Column:
    """Domain of a surface from its source family, then keywords, then its type."""
    empty = F.lit("")
    title = empty if title is None else F.coalesce(title, empty)
    publisher = empty if publisher is None else F.coalesce(publisher, empty)
    low = F.lower(F.concat_ws(" ", F.coalesce(text, empty), title, publisher))
    goods = candidate_type.isin("STYLE", "PRODUCT", "BRAND")
    return (
        F.when(family.isin("MUSIC_CHART", "SHOW_CHART"), "ENTERTAINMENT")
        .when(family == "FASHION_STYLE", "FASHION_BEAUTY")
        .when((family == "COMMERCE") & goods, "CONSUMER_CULTURE")
        .when(contains_any(low, dims.KEYWORDS["business_keywords"]), "BUSINESS_PROFESSIONAL")
        .when(
            contains_any(F.lower(publisher), dims.KEYWORDS["business_publishers"]),
            "BUSINESS_PROFESSIONAL",
        )
        .when(
            candidate_type.isin(*dims.PERSON_TYPES, "MUSIC_TRACK", *dims.WORK_TYPES),
            "ENTERTAINMENT",
        )
        .when(contains_any(low, dims.KEYWORDS["fashion_keywords"]), "FASHION_BEAUTY")
        .when(contains_any(low, dims.KEYWORDS["consumer_keywords"]), "CONSUMER_CULTURE")
        .when(contains_any(low, dims.KEYWORDS["entertainment_keywords"]), "ENTERTAINMENT")
        .when(goods, "FASHION_BEAUTY")
        .when(candidate_type.isin("PHRASE", "HASHTAG", "BEHAVIOR", "KEYWORD"), "CONSUMER_CULTURE")
        .otherwise("OTHER")
    )


# --- summaries and display text ----------------------------------------------------------------


def clean_text(text: Column, max_length: int) -> Column:
    """Printable text with single spaces, cut to ``max_length`` with an ellipsis."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\n\t]", " ")
    printable = F.regexp_replace(spaced, r"[\p{C}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", "")
    t = F.trim(F.regexp_replace(printable, " +", " "))
    return F.when(
        F.length(t) > max_length, F.concat(F.left(t, F.lit(max_length - 1)), F.lit("…"))
    ).otherwise(t)


def template_summary(name: Column, score: Column, buckets: Column) -> Column:
    """One-line summary; ``buckets`` is an array ordered by contribution."""
    top = F.array_join(F.slice(buckets, 1, 3), "・")
    value = F.format_string("%.1f", score)
    return F.when(
        F.size(buckets) > 0,
        F.concat(name, F.lit("が"), top, F.lit("で注目されています。(スコア: "), value, F.lit(")")),
    ).otherwise(
        F.concat(name, F.lit("がトレンドに浮上しています。(スコア: "), value, F.lit(")"))
    )
