"""Spark results against DuckDB: same columns, types and rows, in any order."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def assert_same(df, con, sql):
    cols = sorted(df.columns)
    want = con.sql(sql)
    assert cols == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    got = Counter(tuple(r) for r in df.select(*cols).collect())
    names = ", ".join(f'"{c}"' for c in cols)
    assert got == Counter(con.sql(f"SELECT {names} FROM ({sql})").fetchall())
