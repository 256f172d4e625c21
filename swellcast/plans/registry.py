"""All registered queries and their SQL oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from swellcast.session import apply_defaults

GROUPS = ("queries_events", "queries_learning", "queries_text", "queries_ops", "queries_state")


def _modules():
    return [import_module(f"swellcast.plans.{g}") for g in GROUPS]


def _prepared(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(apply_defaults(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(fn) for m in _modules() for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
