"""Columns that are computed once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expression is not repeated where they are used.

    Spark merges projections and pushes filters by copying expressions. Parsing or a long
    CASE copied twenty times is slow to run and makes the generated code too large to be
    compiled. A generated row is not copied; filters on other columns still pass it.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[e.alias(n) for n, e in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
