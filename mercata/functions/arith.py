"""Exact arithmetic for report measures.

Reports round ratios and averages the way a ``NUMERIC`` engine does: exactly,
half away from zero.  Spark's decimal division keeps a bounded number of
digits and double rounding is not exact, so :func:`round_ratio` works on
integers: ``round(f * n / d, k) = sign(n) * floor((2 * f * 10^k * |n| + d) /
(2 * d)) / 10^k`` for ``d > 0``.  Everything is decimal(38,0) arithmetic,
evaluated once per output group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D38 = "decimal(38,0)"
MICROS_PER_DAY = 86_400_000_000
MICROS_PER_SECOND = 1_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unscaled(c: Column | str, scale: int) -> Column:
    """A decimal with ``scale`` digits as its integer of units (cents for 2)."""
    return (_col(c) * F.lit(10**scale)).cast(D38)


def _floor_div(n: Column, d: Column) -> Column:
    """Exact floor division of decimal(38,0) ``n >= 0`` by ``d > 0``."""
    return ((n - F.pmod(n, d)) / d).cast(D38)


def round_ratio(num: Column | str, den: Column | str, scale: int, factor: int = 1) -> Column:
    """``ROUND(factor * num / den, scale)`` exactly, half away from zero.

    ``num`` and ``den`` must be integer valued (use :func:`unscaled` for
    decimals) and ``den`` non-zero; either may be negative.  Returns
    ``decimal(38, scale)``; NULL when either input is NULL.
    """
    n = _col(num).cast(D38)
    d = _col(den).cast(D38)
    twice = F.lit(2 * factor * 10**scale).cast(D38)
    q = _floor_div(F.abs(n) * twice + F.abs(d), F.abs(d) * F.lit(2).cast(D38))
    signed = F.when((n < 0) != (d < 0), -q).otherwise(q)
    return (signed / F.lit(10**scale).cast(D38)).cast(f"decimal(38,{scale})")


def micros_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in microseconds (bigint); NULL if either is NULL."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def split_micros(us: Column) -> tuple[Column, Column]:
    """Split microseconds into whole seconds and the signed remainder, so
    sums over billions of rows stay exact in two bigints (a single bigint sum
    of microseconds overflows after a few million 30-day intervals)."""
    seconds = (us - us % MICROS_PER_SECOND) / MICROS_PER_SECOND
    return seconds.cast("bigint"), (us % MICROS_PER_SECOND).cast("bigint")


def days_fraction(start: Column | str, end: Column | str) -> Column:
    """Fractional days between two timestamps as a double (IEEE division of
    the exact microsecond count, so every engine gets the same value)."""
    return micros_between(start, end).cast("double") / float(MICROS_PER_DAY)


def exact_avg(total: Column | str, count: Column | str, scale: int, value_scale: int = 0) -> Column:
    """``ROUND(AVG(x), scale)`` from ``SUM(x)`` and ``COUNT(x)``: exact, half
    away from zero; NULL when nothing was counted.  ``value_scale`` is the
    decimal scale of ``x`` (2 for money)."""
    n = _col(count)
    den = F.when(n > 0, n.cast(D38) * F.lit(10**value_scale).cast(D38))
    return round_ratio(unscaled(total, value_scale), den, scale)


def total_micros(sum_seconds: Column | str, sum_rest: Column | str) -> Column:
    """The total, as decimal(38,0), of sums of the two parts that
    :func:`split_micros` makes."""
    return _col(sum_seconds).cast(D38) * F.lit(MICROS_PER_SECOND).cast(D38) + _col(sum_rest).cast(D38)


def avg_days(sum_seconds: Column | str, sum_rest: Column | str, count: Column | str, scale: int) -> Column:
    """``ROUND(AVG(EXTRACT(EPOCH FROM interval) / 86400), scale)``, exact."""
    n = _col(count)
    den = F.when(n > 0, n.cast(D38) * F.lit(MICROS_PER_DAY).cast(D38))
    return round_ratio(total_micros(sum_seconds, sum_rest), den, scale)
