"""Every registered query with an oracle gives the same rows as its SQL."""

from __future__ import annotations

import pytest
from settings import SF_DIR
from oracle_check import canonical, compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    df = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return
    cur = con.execute(ORACLES[name])
    problem = compare(canonical(df.columns, rows), canonical([c[0] for c in cur.description], cur.fetchall()))
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
