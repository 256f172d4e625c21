"""Run registered queries against their SQL oracles: ``python tests/oracle_check.py [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    """Columns by name, values normalised, rows in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "<null>"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "nan" if v != v else repr(v + 0.0)
        if isinstance(v, int):
            return repr(v)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark_result, oracle_result) -> str | None:
    cols_a, rows_a = spark_result
    cols_b, rows_b = oracle_result
    if cols_a != cols_b:
        return f"columns differ: {cols_a} vs {cols_b}"
    if rows_a == rows_b:
        return None
    only_a = sorted(set(rows_a) - set(rows_b))
    only_b = sorted(set(rows_b) - set(rows_a))
    return (
        f"{len(rows_a)} vs {len(rows_b)} rows, {len(only_a)} only in spark, {len(only_b)} only in oracle\n"
        f"   cols {cols_a}\n   spark  {only_a[:3]}\n   oracle {only_b[:3]}"
    )


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    import __spark_entry__ as entry
    from swellcast.session import build_session

    spark = build_session(
        "oracle-check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "10g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in oracles:
                print(f"ROWS  {name:26s} {len(rows):7d} rows {took:6.1f}s", flush=True)
                continue
            cur = con.execute(oracles[name])
            expected = canonical([c[0] for c in cur.description], cur.fetchall())
            problem = compare(canonical(df.columns, rows), expected)
        except Exception as exc:  # noqa: BLE001
            problem, rows, took = f"{type(exc).__name__}: {str(exc)[:700]}", [], time.time() - start
        if problem:
            bad += 1
            print(f"FAIL  {name:26s} {took:6.1f}s {problem}", flush=True)
        else:
            print(f"ok    {name:26s} {len(rows):7d} rows {took:6.1f}s", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
