"""Column-level helpers: exact rounding of ratios, time differences, month
arithmetic and rule/band labelling.  All are built-in Spark expressions, so
they stay inside whole-stage codegen."""

from mercata.functions.arith import (
    avg_days,
    exact_avg,
    total_micros,
    days_fraction,
    micros_between,
    round_ratio,
    split_micros,
    unscaled,
)
from mercata.functions.dates import month_index, month_start, to_date
from mercata.functions.labels import band, label_by_rules

__all__ = [
    "avg_days",
    "exact_avg",
    "total_micros",
    "band",
    "days_fraction",
    "label_by_rules",
    "micros_between",
    "month_index",
    "month_start",
    "round_ratio",
    "split_micros",
    "to_date",
    "unscaled",
]
