"""Arrow functions for the two text measures Spark has no built-in for."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(s: pd.Series) -> pd.Series:
    def one(values):
        if values is None:
            return None
        return [None if v is None else unicodedata.normalize("NFKC", v) for v in values]

    return s.map(one)


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if x is None or y is None else SequenceMatcher(a=x, b=y).ratio()
            for x, y in zip(a, b)
        ],
        dtype="float64",
    )


def nfkc(text: Column) -> Column:
    """Compatibility-normalised text; plain ASCII never leaves the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(NON_ASCII), text)), text)


def nfkc_each(values: Column) -> Column:
    """``nfkc`` over an array; arrays without non-ASCII text never leave the JVM."""
    needs = F.exists(values, lambda v: v.rlike(NON_ASCII))
    return F.coalesce(_nfkc_each(F.when(needs, values)), values)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching-block similarity in 0..1; call it after every cheaper test."""
    return _sequence_ratio(a, b)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else html.unescape(v))


def html_unescape(text: Column) -> Column:
    """Entities resolved; text without an ampersand never leaves the JVM."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)
