"""Side-by-side run of every registered query and its oracle SQL.

usage: python tests/check_oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}" if v != 0 else "0"
    if v is None:
        return "\0"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data), sorted(cols)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "rows", len(got), t1 - t0, 0.0, ""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    g, gc = rows_of(df.columns, got)
    w, wc = rows_of(cols, want)
    note = ""
    if gc != wc:
        note = f"columns {gc} vs {wc}"
    elif g != w:
        only_g = [x for x in g if x not in set(w)][:2]
        only_w = [x for x in w if x not in set(g)][:2]
        note = f"rows {len(g)} vs {len(w)}; spark-only {only_g}; sql-only {only_w}"[:900]
    return ("ok" if not note else "DIFF"), len(got), t1 - t0, t2 - t1, note


def main(argv):
    from evisift.session import local_session

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    pats = argv[1:]
    spark = local_session()
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            st, n, ts, td, note = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            st, n, ts, td, note = "ERROR", 0, 0.0, 0.0, str(e).strip()[:700]
        bad += st in ("DIFF", "ERROR")
        print(f"{st:5} {name:32} rows={n:<7} spark={ts:6.2f}s duckdb={td:6.2f}s {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
