"""Monthly revenue trend (N1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.arith import round_ratio, unscaled
from mercata.functions.dates import month_start, within_months
from mercata.plans.entities import Tables, delivered_orders, order_revenue
from mercata.plans.rules import DEFAULT_REVENUE_RANGE


def monthly_revenue(
    t: Tables,
    start: str = DEFAULT_REVENUE_RANGE[0],
    end: str = DEFAULT_REVENUE_RANGE[1],
    month_over_month: bool = False,
) -> DataFrame:
    """``month, orders, revenue`` of delivered orders purchased in
    ``[start, end)``.

    The range is a half-open filter on the raw timestamp, so it reaches the
    Parquet scan; of tables stored by month (``write_dated_tables``) only the
    range's months are read, items included.  Items are summed per order before the join; ``orders``
    counts those order rows (unique per order id).  ``month_over_month`` adds
    the previous month's revenue and the change in percent (a LAG over the
    aggregated months)."""
    ts = F.col("order_purchase_timestamp")
    t = {**t, **{name: within_months(t[name], start, end) for name in ("orders", "order_items") if name in t}}
    orders = delivered_orders(t, "order_id", "order_purchase_timestamp").filter(
        (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))
    )
    out = (
        orders.join(order_revenue(t), "order_id")
        .groupBy(month_start("order_purchase_timestamp").alias("month"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("order_total").alias("revenue"))
    )
    if month_over_month:
        prev = F.lag("revenue").over(Window.orderBy("month"))
        out = out.withColumn("prev_revenue", prev).withColumn(
            "revenue_change_pct",
            F.when(
                F.col("prev_revenue") > 0,
                round_ratio(
                    unscaled(F.col("revenue") - F.col("prev_revenue"), 2),
                    F.when(F.col("prev_revenue") > 0, unscaled("prev_revenue", 2)),
                    2,
                    factor=100,
                ),
            ),
        )
    return out.orderBy("month")


def revenue_totals(
    t: Tables,
    start: str = DEFAULT_REVENUE_RANGE[0],
    end: str = DEFAULT_REVENUE_RANGE[1],
) -> DataFrame:
    """Totals of the revenue trend over ``[start, end)``: ``total_revenue``,
    ``total_orders`` (the column sums of :func:`monthly_revenue`)."""
    months = monthly_revenue(t, start, end)
    return months.agg(
        F.sum("revenue").alias("total_revenue"),
        F.sum("orders").alias("total_orders"),
    )
