"""Run registered queries beside their SQL and compare columns and rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


SECONDS: dict[str, float] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return "\0" if v is None else str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str, queries, oracles) -> str | None:
    """None if equal (or without SQL), else the first differences."""
    started = time.time()
    df = queries[name](spark, sf_dir)
    got = normal(df.columns, df.collect())
    SECONDS[name] = time.time() - started
    if name not in oracles:
        return None if got[1] else "no rows"
    rel = con.execute(oracles[name])
    want = normal([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        ours, theirs = set(got[1]), set(want[1])
        extra = [r for r in got[1] if r not in theirs][:3]
        missing = [r for r in want[1] if r not in ours][:3]
        return f"rows {len(got[1])} vs {len(want[1])}\n  only ours: {extra}\n  only SQL:  {missing}"
    return None


def main(argv):
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as e
    from corpusmill.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for name in names:
        t = time.time()
        try:
            problem = compare(spark, con, name, sf_dir, queries, oracles)
        except Exception as ex:  # report and go on with the next query
            problem = f"{type(ex).__name__}: {str(ex)[:1500]}"
        n_sql = "" if name in oracles else " (no SQL)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{n_sql} {SECONDS.get(name, 0):.1f}s of {time.time() - t:.1f}s" + (f"\n  {problem}" if problem else ""), flush=True)
        bad += problem is not None
    print(f"{len(names) - bad}/{len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
