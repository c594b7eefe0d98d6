"""Run registered queries against their SQL in DuckDB: python -m tests.compare [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (int, float)):
        v = float(v)
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql):
    cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    ocols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols != ocols:
        return False, f"columns {cols} vs {ocols}", len(got)
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b]
        return False, f"{len(bad)} rows differ, first {diff[:4]} in {g[:6]}", len(got)
    return True, "", len(got)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.local import session

    args = sys.argv[1:]
    path = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = session(), connect(path)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if args and not any(name == a or (a not in queries and name.startswith(a)) for a in args):
            continue
        t = time.time()
        try:
            df = fn(spark, path)
            if name in oracle:
                ok, why, n = compare(df, con, oracle[name])
            else:
                rows = df.collect()
                n = len(rows)
                ok, why = True, f"rows only: {rows[0] if rows else None}"[:240]
        except Exception as e:  # report and go on
            ok, why, n = False, f"{type(e).__name__}: {str(e)[:700]}", -1
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {n:7d} rows {time.time() - t:6.1f}s {why}", flush=True)
    print("failed:", failed)
