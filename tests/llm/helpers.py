"""Small tables that every operator must take, and plain-Python references."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls everywhere, empty and blank texts, a repeated row, a copy, a clash of column names.
EDGE_ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "same words here again and again", "en", None, 31),
    (5, "same words here again and again", "en", "b", 31), (5, "same words here again and again", "en", "b", 31),
    (None, "no id at all", None, None, 12), (6, "Ünï çödé 🙂 ▁ x", "fr", "c", 14), (7, "long " * 30_000, "en", "c", 150_000),
    (8, "a\x00b　c d", None, "c", 7),
]


def docs(spark, rows=None, clash=True):
    df = spark.createDataFrame(EDGE_ROWS if rows is None else rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        for name in ("kept", "score", "node", "size", "key", "uid", "n_tokens", "_score", "label", "bit", "spans", "_tag", "_sha", "_hits", "_owners", "_items", "tag", "_id"):
            df = df.withColumn(name, F.lit("x"))
    return df


def lower_ascii(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
