"""Reshape steps: pivot on a fixed value list and reindex onto a dimension."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_values(
    df: DataFrame,
    index: Sequence[str],
    pivot: str,
    values: Sequence[Any],
    value: str,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per ``index``, one column per pivot value; missing cells are
    NULL.  The explicit value list avoids Spark's extra distinct-values job
    and keeps the output schema fixed."""
    out = df.groupBy(*index).pivot(pivot, list(values)).agg(F.first(value))
    if names:
        for v, name in zip(values, names):
            out = out.withColumnRenamed(str(v), name)
    return out


def reindex_on(df: DataFrame, dimension: DataFrame, key: str, order: str) -> DataFrame:
    """Keep every member of a small literal ``dimension`` (absent ones become
    rows of NULLs) and sort by its ``order`` column, like pandas ``reindex``.
    Both sides are a handful of rows; AQE picks the join from their measured
    size."""
    return dimension.join(df, key, "left").orderBy(order)
