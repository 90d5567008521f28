"""Compare registered queries with their DuckDB SQL: python tests/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from screenlens.session import local_session, release

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def kind(value):
    return "null" if value is None else type(value).__name__


def compare(df, sql, con):
    names = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if sql is None:
        return "rows-only", len(mine), ""
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return "SCHEMA", len(mine), f"{names} vs {sorted(cols)}"
    order = [cols.index(c) for c in names]
    theirs = [tuple(plain(row[i]) for i in order) for row in rel.fetchall()]
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    mine.sort(key=key)
    theirs.sort(key=key)
    for i, c in enumerate(names):
        a = {kind(r[i]) for r in mine} - {"null"}
        b = {kind(r[i]) for r in theirs} - {"null"}
        if a != b and a and b:
            return "TYPE", len(mine), f"{c}: {a} vs {b}"
    if mine != theirs:
        only_a = [r for r in mine if r not in set(theirs)][:3]
        only_b = [r for r in theirs if r not in set(mine)][:3]
        return "VALUES", len(mine), f"{len(mine)} vs {len(theirs)} {names}\n   spark {only_a}\n   duck  {only_b}"
    return "ok" if mine else "EMPTY", len(mine), ""


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    queries = entry.queries()
    for name in sqls:
        assert name in queries, f"oracle without query: {name}"
    for name, run in queries.items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = run(spark, sf_dir)
            status, rows, note = compare(df, sqls.get(name), con)
        except Exception as e:  # report and go on to the next query
            status, rows, note = "ERROR", 0, f"{type(e).__name__}: {str(e)[:1500]}"
        if status not in ("ok", "rows-only"):
            bad += 1
        release(spark)
        print(f"{status:9} {name:28} rows={rows:<7} {time.time() - t0:6.2f}s {note}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
