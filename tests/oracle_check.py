"""Compare registered queries with their SQL on the test tables.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "is_integer") or hasattr(value, "as_integer_ratio"):
        return round(float(value), 9)
    return value


def _normal(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a description of the first difference."""
    df = query(spark, sf_dir)
    got = _normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want = _normal([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = [r for r in got[1][:50] if r not in set(want[1])][:2]
        return f"{len(got[1])} rows != {len(want[1])} rows; extra {extra}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"\n  spark {a}\n  sql   {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from faultloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, queries[name], oracles[name], sf_dir)
                status = "ok" if problem is None else f"DIFF {problem}"
            else:
                status = f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as exc:  # report and go on with the next query
            status = f"FAIL {type(exc).__name__}: {str(exc)[:600]}"
        bad += not status.startswith(("ok", "rows"))
        print(f"{name:24s} {time.time() - start:6.2f}s {status}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
