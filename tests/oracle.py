"""Spark rows against DuckDB rows, order and map order aside."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def compare(df, con, sql):
    want = con.sql(sql)
    names = sorted(want.columns)
    assert names == sorted(df.columns)
    at = [want.columns.index(c) for c in names]
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    expected = sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
    assert got == expected
