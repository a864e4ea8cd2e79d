"""Runs a registered query and its SQL twin and compares the rows.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value: object) -> object:
    if value is None:
        return "<null>"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return f"bool:{value}"
    if isinstance(value, float):
        if math.isnan(value):
            return "<null>"
        return f"float:{value!r}"
    if isinstance(value, int):
        return f"int:{value}"
    return f"{type(value).__name__}:{value}"


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(_cell(row[i])) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(df.columns)} vs {sorted(names)}"
    want = canonical(names, cur.fetchall())
    if len(got) != len(want):
        return f"row counts differ: {len(got)} vs {len(want)}"
    if got != want:
        pairs = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(pairs)} rows differ, columns {sorted(names)}, first: {pairs[0][0]} vs {pairs[0][1]}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from gristmill.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                 "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[2:] or list(queries)
    bad = 0
    for name in names:
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                n = len(queries[name](spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as exc:  # reported per query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - started:.1f}s {problem or ''}",
              flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
