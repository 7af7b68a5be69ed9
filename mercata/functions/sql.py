"""Rendering Python values as Spark SQL literals (for expressions built as
one SQL string, which costs a single call into the JVM)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def sql_literal(value: Any) -> str:
    """An exact Spark SQL literal for ``value``."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, decimal.Decimal):
        return f"({value}BD)"
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return f"CAST('{value}' AS DOUBLE)"
        return f"({value!r}D)"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def values_table(spark: SparkSession, rows: Sequence[Sequence[Any]], names: Sequence[str]) -> DataFrame:
    """A small fixed table as a VALUES relation, whose size the planner knows
    (rows from Python are of unknown size to it)."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(f'`{n}`' for n in names)})")
