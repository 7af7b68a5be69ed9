"""Cohort retention reports (3.1-3.4) and the heatmap data (N3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.arith import round_ratio
from mercata.functions.dates import to_date
from mercata.operators.reshape import pivot_values
from mercata.operators.topk import top_k
from mercata.plans.entities import PERSON, Tables, active_months, customer_activity, first_orders
from mercata.plans.rules import DEFAULT_FROM_COHORT, DEFAULT_SAMPLE_COHORT

Day = str | dt.date


def new_customers_by_cohort(t: Tables) -> DataFrame:
    """3.1 people per first-purchase month."""
    return (
        first_orders(t)
        .groupBy("cohort_month")
        .agg(F.count(F.lit(1)).alias("new_customers_in_cohort"))
        .orderBy("cohort_month")
    )


def cohort_activity_sample(t: Tables, cohort: Day = DEFAULT_SAMPLE_COHORT, k: int = 20) -> DataFrame:
    """3.2 the first ``k`` activity rows (order grain) of one cohort."""
    return top_k(
        customer_activity(t, cohort),
        [F.col(PERSON).asc(), F.col("month_index").asc(), F.col("order_month").asc()],
        k,
    )


def cohort_activity_counts(t: Tables) -> DataFrame:
    """``cohort_month, month_index, active_customers, cohort_size`` for every
    observed cell.  Active people are counted once per month (distinct pairs),
    and the cohort size is the month-0 count, since every person is active in
    their own first month -- so no join back to a cohort table is needed."""
    cells = active_months(t).groupBy("cohort_month", "month_index").agg(
        F.count(F.lit(1)).alias("active_customers")
    )
    size = F.sum(F.when(F.col("month_index") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month")
    )
    return cells.withColumn("cohort_size", size)


def retention_long(t: Tables, from_cohort: Day = DEFAULT_FROM_COHORT, max_index: int = 6) -> DataFrame:
    """3.3 retention per cohort and month index ``0..max_index`` (long form)."""
    cells = cohort_activity_counts(t).filter(
        (F.col("cohort_month") >= to_date(from_cohort)) & (F.col("month_index") <= max_index)
    )
    return cells.select(
        "cohort_month",
        "cohort_size",
        "month_index",
        "active_customers",
        round_ratio("active_customers", "cohort_size", 2, factor=100).alias("retention_pct"),
    ).orderBy("cohort_month", "month_index")


def retention_matrix(t: Tables, from_cohort: Day = DEFAULT_FROM_COHORT, months: int = 6) -> DataFrame:
    """3.4 one row per cohort, ``month_1_pct .. month_<months>_pct``; months
    without any returning person are 0.00 (a filtered count, not a pivot)."""
    idx = F.col("month_index")
    agg = [F.count_if(idx == 0).alias("cohort_size")] + [
        F.count_if(idx == m).alias(f"_m{m}") for m in range(1, months + 1)
    ]
    grouped = (
        active_months(t)
        .filter(F.col("cohort_month") >= to_date(from_cohort))
        .groupBy("cohort_month")
        .agg(*agg)
    )
    return grouped.select(
        "cohort_month",
        "cohort_size",
        *[
            round_ratio(f"_m{m}", "cohort_size", 2, factor=100).alias(f"month_{m}_pct")
            for m in range(1, months + 1)
        ],
    ).orderBy("cohort_month")


def retention_heatmap_long(t: Tables, from_cohort: Day = DEFAULT_FROM_COHORT, max_index: int = 6) -> DataFrame:
    """N3 (query) ``cohort_month, month_index, retention_pct`` for 0..max_index."""
    return retention_long(t, from_cohort, max_index).select("cohort_month", "month_index", "retention_pct")


def retention_heatmap(t: Tables, from_cohort: Day = DEFAULT_FROM_COHORT, months: int = 6) -> DataFrame:
    """N3 (matrix) cohort label ``yyyy-MM`` x ``month_1 .. month_<months>``;
    a cell with no returning person is NULL (a pivot of observed cells),
    month 0 dropped."""
    long = retention_heatmap_long(t, from_cohort, months).withColumn(
        "cohort", F.date_format("cohort_month", "yyyy-MM")
    )
    values = list(range(1, months + 1))
    wide = pivot_values(long, ["cohort"], "month_index", values, "retention_pct", [f"month_{m}" for m in values])
    return wide.orderBy("cohort")
