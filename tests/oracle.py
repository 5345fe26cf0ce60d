"""Run registered queries against DuckDB: python tests/oracle.py [sf] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short reason."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    want = rows_of(names, cur.fetchall())
    kinds = {n: str(d[1]) for n, d in zip(names, cur.description)}
    loose = [f"{n}:{t}/{kinds[n]}" for n, t in df.dtypes
             if (t in ("int", "bigint")) != (kinds[n] in ("INTEGER", "BIGINT", "NUMBER"))]
    for n, t in df.dtypes:
        k = kinds[n]
        if (t == "int" and k != "INTEGER") or (t == "bigint" and k != "BIGINT") or \
                (t == "double" and k != "DOUBLE"):
            loose.append(f"{n}:{t}/{k}")
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return (f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:2]}; "
                f"only sql {sorted(b - a)[:2]}")
    return f"types {loose}" if loose else None


def main() -> None:
    from stylegraph.registry.all import QUERIES, SQL
    from stylegraph.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(folder)
    bad = []
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in SQL:
                verdict = compare(df, con, SQL[name])
            else:
                n = df.count()
                verdict = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok ' if not verdict else 'BAD'} {name} {time.time() - t:.1f}s "
              f"{'' if name in SQL else '(rows only) '}{verdict or ''}", flush=True)
        if verdict:
            bad.append(name)
    print(len(names), "queries", len(bad), "bad", bad)


if __name__ == "__main__":
    main()
