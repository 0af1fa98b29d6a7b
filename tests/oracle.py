"""Compare registered queries with their DuckDB SQL on the same Parquet files."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canonical(rows: list[dict]) -> list[tuple]:
    """Rows as tuples by column name, in a stable order."""

    def plain(v):
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        if isinstance(v, list):
            return tuple(plain(x) for x in v)
        return v

    return sorted((tuple((k, plain(r[k])) for k in sorted(r)) for r in rows), key=repr)


def spark_rows(df) -> list[dict]:
    return df.toArrow().to_pylist()


def sql_rows(connection, sql: str) -> list[dict]:
    return connection.sql(sql).to_arrow_table().to_pylist()
