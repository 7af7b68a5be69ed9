"""Top-k with a deterministic order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``ORDER BY order LIMIT k``.  Put a unique column last in ``order`` so
    ties cannot change the result.  Spark runs this as a distributed
    TakeOrderedAndProject: each task keeps its own k best rows."""
    return df.orderBy(*order).limit(k)
