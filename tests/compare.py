"""Compare registered queries with their SQL on one data folder: python tests/compare.py sf0.01 [name-part ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    got_cols, got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        only_g = [g for g in got if g not in set(want)][:2] if len(got) < 200000 else []
        only_w = [w for w in want if w not in set(got)][:2] if len(want) < 200000 else []
        return f"rows {len(got)} != {len(want)}: extra {only_g} missing {only_w}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: {got_cols} got {bad[0][0]} want {bad[0][1]}"
    return None if got else "EMPTY"


def main(sf: str, *parts: str) -> None:
    import __spark_entry__ as entry
    from tidewrack.session import local_session

    folder = f"/root/testdata/{sf}"
    spark, con = local_session("compare", 8), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            if name in sql:
                df = fn(spark, folder)
                t1 = time.time()
                problem = difference(df, con, sql[name])
            else:
                problem = None if fn(spark, folder).count() else "EMPTY"
                t1 = t
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - t:.1f}s {'' if name in sql else '(no SQL)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(len(failed), "failed:", failed)


if __name__ == "__main__":
    main(*(sys.argv[1:] or ["sf0.01"]))
