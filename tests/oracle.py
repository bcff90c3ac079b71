"""Compare a query with its SQL on the same tables, as multisets of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, decimal.Decimal):
        return value.normalize()
    return value


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


# DuckDB and Spark names of the same type.
TYPES = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences in columns, types and rows; empty when the results are the same."""
    result = con.sql(sql)
    problems = []
    spark_types = dict(df.dtypes)
    sql_types = {c: TYPES.get(str(t), str(t).lower().replace(" ", "")) for c, t in zip(result.columns, result.types)}
    if spark_types != sql_types:
        problems.append(f"types differ: {sorted(spark_types.items() ^ sql_types.items())}")
    if set(spark_types) != set(sql_types):
        return problems
    ours, theirs = rows(df.columns, df.collect()), rows(result.columns, result.fetchall())
    if ours != theirs:
        problems.append(
            f"rows differ: {sum(ours.values())} and {sum(theirs.values())}; "
            f"only here {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}"
        )
    elif not ours:
        problems.append("both are empty")
    return problems
