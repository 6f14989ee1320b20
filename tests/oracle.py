"""Compares a registered query with its SQL on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


def rows_of(df, names):
    return sorted(tuple(str(plain(r[c])) for c in names) for r in df)


def differences(spark, con, query, sql, sf_dir):
    """(spark rows, sql rows, first rows that only one side has)."""
    got = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names), (got.columns, names)
    want = rows_of([dict(zip(names, r, strict=True)) for r in cur.fetchall()], sorted(names))
    have = rows_of(got.collect(), sorted(names))
    return len(have), len(want), sorted(set(have) - set(want))[:3], sorted(set(want) - set(have))[:3]
