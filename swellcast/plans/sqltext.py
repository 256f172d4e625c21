"""Text rules as ANSI/DuckDB SQL snippets for the oracle queries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from swellcast import dims


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return f"CAST({value!r} AS DOUBLE)" if isinstance(value, float) else str(value)
    return "'" + str(value).replace("'", "''") + "'"


def case(expr: str, values: Mapping[str, object], default: object) -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items())
    return f"(CASE {expr} {arms} ELSE {lit(default)} END)"


def pick(values: Sequence[str], index: str) -> str:
    return "([" + ", ".join(lit(v) for v in values) + f"][CAST({index} AS INT) + 1])"


def one_of(expr: str, values: Sequence[str]) -> str:
    return f"({expr} IN ({', '.join(lit(v) for v in values)}))"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, 'g')"


def contains_any(expr: str, words: Sequence[str]) -> str:
    return matches(expr, "|".join(re.escape(w.lower()) for w in words))


def trim(expr: str) -> str:
    return sub(expr, r"^\s+|\s+$", "")


def norm_name(expr: str) -> str:
    t = sub(trim(expr), r"\s+", " ")
    return trim(sub(t, r"[!?！？。、…]+$", ""))


def match_key(expr: str) -> str:
    return sub(f"lower({norm_name(expr)})", r"[\s\-_・:：/／]", "")


def norm_topic(expr: str) -> str:
    t = sub(trim(f"coalesce({expr}, '')"), r"[\x{10000}-\x{10FFFF}]", "")
    t = sub(t, "[\"'`“”‘’\\[\\]\\(\\)【】<>＜＞]", " ")
    t = sub(t, r"[!！?？…。．・〜~]+$", "")
    t = trim(sub(t, r"\s+", " "))
    for lemma in dict.fromkeys(to for _, to in dims.LEMMA_RULES):
        t = sub(t, "(?:" + "|".join(s for s, to in dims.LEMMA_RULES if to == lemma) + ")$", lemma)
    return t


def key_of(normalized: str) -> str:
    return sub(f"replace(lower({normalized}), '#', '')", r"[\s_\-・:：/／]+", "")


def strip_hash(normalized: str) -> str:
    return f"lower(regexp_replace({normalized}, '^#', ''))"


def keep_parts(once: str, twice: str) -> str:
    """Keep test from a surface normalised once and twice."""
    drop = (*dims.KEYWORDS["generic_event_keywords"], *dims.LIVE_WORDS, *dims.FINANCE_WORDS)
    return (
        f"({once} <> '' AND NOT {one_of(f'lower({once})', dims.STOP_PHRASES)}"
        f" AND NOT {one_of(strip_hash(twice), dims.STOP_PHRASES)}"
        f" AND NOT {contains_any(f'lower({twice})', drop)} AND length({key_of(twice)}) > 1)"
    )


def specificity(once: str, twice: str) -> str:
    core = f"length({key_of(twice)})"
    tokens = f"len(regexp_extract_all({once}, '[ぁ-んァ-ン一-龥a-zA-Z0-9]+'))"
    value = (
        f"least(1.0, CAST(0.18 AS DOUBLE) * {tokens} + CAST(0.04 AS DOUBLE) * {core})"
        f" * (CASE WHEN {one_of(strip_hash(twice), dims.STOP_PHRASES)} THEN CAST(0.3 AS DOUBLE) ELSE 1.0 END)"
        f" * (CASE WHEN {contains_any(f'lower({twice})', dims.KEYWORDS['generic_event_keywords'])} THEN CAST(0.45 AS DOUBLE) ELSE 1.0 END)"
        f" * (CASE WHEN {contains_any(f'lower({twice})', dims.LIVE_WORDS)} THEN CAST(0.35 AS DOUBLE) ELSE 1.0 END)"
    )
    return (
        f"(CASE WHEN {once} = '' THEN 0.0 WHEN {core} <= 2 THEN 0.1 "
        f"ELSE round(CAST({value} AS DOUBLE), 4) END)::DOUBLE"
    )


def objectness(once: str) -> str:
    low = f"lower({once})"
    return (
        f"(CASE WHEN {once} = '' THEN 0.0"
        f" WHEN {contains_any(low, dims.KEYWORDS['behavior_object_blacklist'])} THEN 0.15"
        f" WHEN {contains_any(low, dims.KEYWORDS['behavior_object_whitelist'])} THEN 0.9"
        f" WHEN {matches(once, '[をの]')} THEN 0.7"
        f" WHEN {matches(once, '(?:' + '|'.join(dims.OBJECT_SUFFIXES) + ')$')} THEN 0.6"
        f" ELSE 0.35 END)::DOUBLE"
    )


def genericity(once: str, twice: str, thrice: str) -> str:
    words = dims.KEYWORDS["generic_phrase_blacklist"]
    return (
        f"(CASE WHEN {once} = '' OR {one_of(once, words)} THEN 1.0"
        f" WHEN {contains_any(f'lower({twice})', dims.KEYWORDS['generic_event_keywords'])} THEN 0.8"
        f" WHEN {contains_any(f'lower({once})', words)} THEN 0.75"
        f" ELSE greatest(0.0, 1.0 - {specificity(twice, thrice)}) END)::DOUBLE"
    )


def live_bias(twice: str) -> str:
    return (
        f"(CASE WHEN {contains_any(f'lower({twice})', dims.LIVE_WORDS)} THEN 1.0"
        f" WHEN {contains_any(f'lower({twice})', dims.FINANCE_WORDS)} THEN 0.9 ELSE 0.0 END)::DOUBLE"
    )


def topic_class(once: str) -> str:
    has = lambda words: matches(once, "|".join(re.escape(w) for w in words))
    return (
        f"(CASE WHEN {has(dims.STYLE_TOKENS)} THEN 'STYLE' WHEN {has(dims.PRODUCT_TOKENS)} THEN 'PRODUCT'"
        f" WHEN {has(dims.BRAND_TOKENS)} THEN 'BRAND' WHEN {has(dims.BEHAVIOR_TOKENS)} THEN 'BEHAVIOR'"
        f" ELSE 'PHRASE' END)"
    )


def classify(ctype: str, family: str, text: str) -> str:
    low = f"lower(coalesce({text}, '') || '  ')"
    goods = one_of(ctype, ("STYLE", "PRODUCT", "BRAND"))
    entity = one_of(ctype, (*dims.PERSON_TYPES, "MUSIC_TRACK", *dims.WORK_TYPES))
    kw = lambda name: contains_any(low, dims.KEYWORDS[name])
    return (
        f"(CASE WHEN {family} IN ('MUSIC_CHART', 'SHOW_CHART') THEN 'ENTERTAINMENT'"
        f" WHEN {family} = 'FASHION_STYLE' THEN 'FASHION_BEAUTY'"
        f" WHEN {family} = 'COMMERCE' AND {goods} THEN 'CONSUMER_CULTURE'"
        f" WHEN {kw('business_keywords')} THEN 'BUSINESS_PROFESSIONAL'"
        f" WHEN {entity} THEN 'ENTERTAINMENT'"
        f" WHEN {kw('fashion_keywords')} THEN 'FASHION_BEAUTY'"
        f" WHEN {kw('consumer_keywords')} THEN 'CONSUMER_CULTURE'"
        f" WHEN {kw('entertainment_keywords')} THEN 'ENTERTAINMENT'"
        f" WHEN {goods} THEN 'FASHION_BEAUTY'"
        f" WHEN {one_of(ctype, ('PHRASE', 'HASHTAG', 'BEHAVIOR', 'KEYWORD'))} THEN 'CONSUMER_CULTURE'"
        f" ELSE 'OTHER' END)"
    )
