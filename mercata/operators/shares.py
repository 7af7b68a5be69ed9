"""Share of a column's total, ``ROUND(100 * x / SUM(x) OVER (), k)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.arith import round_ratio, unscaled


def share_of_total(
    grouped: DataFrame, column: str, out: str, scale: int = 2, value_scale: int = 0
) -> DataFrame:
    """Add ``out`` = exact percentage of ``column`` in its grand total.

    Meant for an *aggregated* frame with few rows (statuses, segments, tiers,
    scores): the grand total is a window over the whole frame, which Spark
    evaluates in one task -- over those few rows only, after the heavy
    aggregation.  (A scalar-subquery total would avoid the single task but
    makes Spark recompute the aggregation for every share column.)
    ``value_scale`` is the decimal scale of ``column`` (2 for money).  A zero
    total gives NULL instead of a division error.
    """
    tmp = f"__total_{out}"
    with_total = grouped.withColumn(tmp, F.sum(F.col(column)).over(Window.partitionBy()))
    num, den = unscaled(column, value_scale), unscaled(tmp, value_scale)
    return with_total.withColumn(
        out, F.when(F.col(tmp) != 0, round_ratio(num, F.when(F.col(tmp) != 0, den), scale, factor=100))
    ).drop(tmp)
