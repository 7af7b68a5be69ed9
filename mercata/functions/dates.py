"""Calendar helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month of purchase by which orders and items may be stored.
MONTH = "purchase_month"


def to_date(value: str | dt.date) -> Column:
    """A DATE literal."""
    if isinstance(value, str):
        value = dt.date.fromisoformat(value)
    return F.lit(value)


def month_start(ts: Column | str) -> Column:
    """``DATE_TRUNC('month', ts)::DATE``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.trunc(c.cast("date"), "month")


def month_index(ts: Column | str, cohort: Column | str) -> Column:
    """Calendar months from ``cohort`` to ``ts``: ``(y1 - y0) * 12 + (m1 - m0)``.

    31 Jan -> 1 Feb is 1 (not ``months_between``, which counts days)."""
    a = F.col(ts) if isinstance(ts, str) else ts
    b = F.col(cohort) if isinstance(cohort, str) else cohort
    return ((F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))).cast("int")


def within_months(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the months that ``[start, end)`` touches, if ``df`` is stored by
    purchase month; else ``df`` as it is."""
    if MONTH not in df.columns:
        return df
    month = F.col(MONTH)
    return df.filter((month >= F.trunc(F.lit(start).cast("timestamp_ntz").cast("date"), "month")) & (month < F.lit(end).cast("timestamp_ntz")))
