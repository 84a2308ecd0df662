"""Runs queries beside their SQL: python tests/compare.py [--sf DIR] NAME..."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{0.0 if v == 0 else v:.9g}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(value(x) for x in v) + "]"
        return str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def differences(spark, con, name: str, sf_dir: str, query, sql: str) -> str:
    """Empty if both sides agree."""
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = canonical(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{name}: {len(got)} and {len(want)} rows; only Spark {sorted(a)[:3]}; only SQL {sorted(b)[:3]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from loomgraph.session import local_session

    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if a != "--sf"] or list(entry.oracle_sql())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            sql = entry.oracle_sql().get(n)
            if sql is None:
                print("rows", n, entry.queries()[n](spark, sf).count(), f"{time.time() - t:.1f}s", flush=True)
                continue
            d = differences(spark, con, n, sf, entry.queries()[n], sql)
        except Exception as e:  # noqa: BLE001
            d = f"{n}: {type(e).__name__} {str(e)[:600]}"
        bad += bool(d)
        print("DIFF" if d else "same", d or n, f"{time.time() - t:.1f}s", flush=True)
    print("differing:", bad)
