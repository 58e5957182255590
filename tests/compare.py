"""Runs queries next to their SQL text and reports differences. ``python tests/compare.py SF [names]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import numpy as np

from swayline.sources.roles import TABLES


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _ordered(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    key = df.map(lambda v: (v is None, f"{v:.5f}" if isinstance(v, float) else str(v)))
    return df.loc[key.sort_values(list(df.columns)).index].reset_index(drop=True)


def difference(spark_df, con, sql):
    """'' when both sides hold the same rows, else a short description."""
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = _ordered(got), _ordered(want)
    for c in got.columns:
        a, b = got[c].tolist(), want[c].tolist()
        floats = any(isinstance(v, float) for v in a + b)
        for i, (x, y) in enumerate(zip(a, b)):
            if x is None or y is None:
                same = x is None and y is None
            elif floats:
                same = abs(x - y) <= 1e-9
            else:
                same = str(x)[:10] == str(y)[:10] if c in ("date", "last_date") else x == y
            if not same:
                return f"{c}[{i}]: {x!r} != {y!r}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from swayline.session import local_session

    spark = local_session()
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    con = oracle_connection(sf_dir)
    sqls = entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in sqls:
                rows = df.count()
                took = time.time() - start
                print(f"{name}: {difference(df, con, sqls[name]) or 'ok'} ({rows} rows, {took:.1f}s)", flush=True)
            else:
                rows = df.toPandas()
                print(f"{name}: no sql ({len(rows)} rows, {time.time() - start:.1f}s)", flush=True)
                print(rows.head(12).to_string(), flush=True)
        except Exception as error:
            print(f"{name}: FAILED {str(error)[:1500]}", flush=True)
