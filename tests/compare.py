"""Compares a Spark result with a DuckDB result: names, types, rows in any order."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# DuckDB type -> Spark type
_TYPES = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
}


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or ``None``."""
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    expected_types = {row[0]: _TYPES.get(row[1], row[1]) for row in described}
    types = dict(df.dtypes)
    if types != expected_types:
        return f"columns differ: {sorted(types.items())} != {sorted(expected_types.items())}"
    names = sorted(types)
    got = Counter(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    expected = Counter(tuple(r) for r in con.execute(f"SELECT {quoted} FROM ({sql})").fetchall())
    if got == expected:
        return None
    return (
        f"{sum(got.values())} rows, expected {sum(expected.values())}; "
        f"only here {list((got - expected).items())[:2]}, missing {list((expected - got).items())[:2]}"
    )
