"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}") if math.isfinite(x) else x
    return str(x)[:10] if hasattr(x, "year") else x


def check(df, con, sql):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.select(*names).collect()), key=repr)
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    assert sorted(have) == names, (sorted(have), names)
    at = [have.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1.1e-6 * max(1, abs(y))) for x, y in zip(a, b))]
    assert not bad, bad[:3]
    return len(got)
