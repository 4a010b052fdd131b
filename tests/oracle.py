"""Comparison of a Spark result with DuckDB's on the same Parquet tables."""

from __future__ import annotations

import os

import duckdb

from quarry.session import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(relation, columns: list[str]) -> list[tuple]:
    at = [list(relation.columns).index(c) for c in columns]
    return sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def assert_same(df, relation) -> None:
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert ours == rows_of(relation, columns)
