"""Run registered queries against their oracle SQL on one scale factor."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple(map(repr, r)))


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"rows {len(got)} ({took:.1f}s, no oracle)"
    start = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want_cols, want = rows_of(names, res.fetchall())
    took_sql = time.time() - start
    if cols != want_cols:
        return False, f"columns {cols} <> {want_cols}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or list(map(type, g)) != list(map(type, w))]
    if len(got) != len(want) or bad:
        return False, f"rows {len(got)} / {len(want)}, {len(bad)} differ, first {bad[:1]}"
    return True, f"rows {len(got)} ({took:.1f}s / sql {took_sql:.1f}s)"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from corpusmill.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = oracle_connection(sf_dir)
    sqls = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:
            ok, note = False, "".join(traceback.format_exception_only(e))[:600]
        print("ok  " if ok else "FAIL", name, note[:900], flush=True)
        if not ok:
            failed.append(name)
    print(len(failed), "failed:", failed)
