"""Compare registered queries with their oracle: python tests/check_oracle.py [sf] [name part ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    df = fn(spark, sf_dir)
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = canonical([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        only = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"rows {len(got)} / {len(want)}; spark only {only[0]}; oracle only {only[1]}"
    return "ok" if got else "ok (empty)"


def main() -> None:
    from spotlake.catalog import load
    from spotlake.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = load()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                state = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                state = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as e:  # report and go on
            state = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += not state.startswith(("ok", "rows only"))
        print(f"{time.time() - start:6.1f}s {name}: {state}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
