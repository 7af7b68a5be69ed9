"""Derived entities shared by the reports (the source's repeated CTEs).

Every function takes ``t``, a mapping of table name to DataFrame, and returns
a lazy DataFrame.  Keys declared as primary keys in the source schema
(``orders.order_id``, ``customers.customer_id``, ``sellers.seller_id``,
``products.product_id``) are relied on as unique -- the duplicate-key reports
check them.  ``order_reviews`` has no key: several reviews per order and
repeated review ids are handled exactly.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.arith import micros_between
from mercata.functions.dates import month_index, month_start, to_date
from mercata.operators.ntile import NtileSpec, add_ntiles, asc, desc
from mercata.operators.skew import salted_join
from mercata.plans.rules import DELIVERED, NEGATIVE_MAX_SCORE

Tables = Mapping[str, DataFrame]
Anchor = str | dt.date | None

PERSON = "customer_unique_id"
#: Prefix of entities prepared beforehand (``run_all``) among the tables.
ENTITY = "entity:"


def delivered_orders(t: Tables, *columns: str) -> DataFrame:
    """Orders with status ``delivered`` (filter pushed to the scan)."""
    orders = t["orders"].filter(F.col("order_status") == DELIVERED)
    return orders.select(*columns) if columns else orders


def order_revenue(t: Tables) -> DataFrame:
    """``order_id, order_total`` = SUM(price + freight_value) per order.

    Aggregated *before* any join so an order's items cannot fan out a join;
    partial aggregation runs map-side."""
    if f"{ENTITY}order_revenue" in t:
        return t[f"{ENTITY}order_revenue"]
    return t["order_items"].groupBy("order_id").agg(
        F.sum(F.col("price") + F.col("freight_value")).alias("order_total")
    )


def customer_orders(t: Tables) -> DataFrame:
    """Delivered orders that have items, with their person and revenue:
    ``customer_unique_id, order_id, order_date, order_total``."""
    orders = delivered_orders(t, "order_id", "customer_id", "order_purchase_timestamp")
    customers = t["customers"].select("customer_id", PERSON)
    return (
        orders.join(order_revenue(t), "order_id")
        .join(customers, "customer_id")
        .select(
            PERSON,
            "order_id",
            F.col("order_purchase_timestamp").cast("date").alias("order_date"),
            "order_total",
        )
    )


def anchor_column(t: Tables, anchor: Anchor) -> Column:
    """The recency anchor: a literal date, or (``None``) the latest delivered
    purchase date as a scalar subquery."""
    if anchor is not None:
        return to_date(anchor)
    return delivered_orders(t).agg(F.max("order_purchase_timestamp").cast("date")).scalar()


def rfm_raw(t: Tables, anchor: Anchor = None) -> DataFrame:
    """Per person: ``recency_days`` (anchor minus last order date),
    ``frequency`` (orders) and ``monetary`` (total spend, exact decimal).

    ``frequency`` counts rows of ``customer_orders``, which are unique per
    order under the order/customer keys, so it equals COUNT(DISTINCT
    order_id) without the extra distinct shuffle.  Grouping by person runs a
    partial aggregate first, so a person owning a large share of all orders
    does not overload one task."""
    return (
        customer_orders(t)
        .groupBy(PERSON)
        .agg(
            F.max("order_date").alias("last_order_date"),
            F.count(F.lit(1)).alias("frequency"),
            F.sum("order_total").alias("monetary"),
        )
        .select(
            PERSON,
            F.datediff(anchor_column(t, anchor), F.col("last_order_date")).alias("recency_days"),
            "frequency",
            "monetary",
        )
    )


# NTILE orderings of the scores, each completed by the person id so that ties
# (most people buy once) split deterministically and evenly.
R_SPEC = NtileSpec(5, (asc("recency_days"), asc(PERSON)), "r_score")
F_SPEC = NtileSpec(5, (desc("frequency"), desc("monetary"), asc(PERSON)), "f_score")
M_SPEC = NtileSpec(5, (desc("monetary"), asc(PERSON)), "m_score")


def rfm_scored(t: Tables, anchor: Anchor = None, scores: str = "rfm", **ntile_options) -> DataFrame:
    """``rfm_raw`` plus the requested quintile scores (``r``, ``f``, ``m``).

    Scores follow the source's orderings: recency ascending and monetary
    descending, so score 1 holds the most recent / biggest spenders."""
    specs = [{"r": R_SPEC, "f": F_SPEC, "m": M_SPEC}[s] for s in scores]
    return add_ntiles(rfm_raw(t, anchor), specs, **ntile_options)


def person_orders(t: Tables) -> DataFrame:
    """Every delivered order (with or without items) with its person:
    ``customer_unique_id, order_id, order_purchase_timestamp``."""
    orders = delivered_orders(t, "order_id", "customer_id", "order_purchase_timestamp")
    customers = t["customers"].select("customer_id", PERSON)
    return orders.join(customers, "customer_id").select(PERSON, "order_id", "order_purchase_timestamp")


def first_orders(t: Tables) -> DataFrame:
    """``customer_unique_id, cohort_month``: month of the first delivered order."""
    return person_orders(t).groupBy(PERSON).agg(
        month_start(F.min("order_purchase_timestamp")).alias("cohort_month")
    )


def active_months(t: Tables) -> DataFrame:
    """Distinct ``(customer_unique_id, cohort_month, month_index)``.

    Orders are first reduced to distinct (person, month) pairs -- a partial
    aggregate, so even a person with a huge number of orders leaves at most
    one row per calendar month.  The cohort is then the minimum month per
    person, a window over those few rows."""
    if f"{ENTITY}active_months" in t:
        return t[f"{ENTITY}active_months"]
    months = (
        person_orders(t)
        .select(PERSON, month_start("order_purchase_timestamp").alias("order_month"))
        .distinct()
    )
    cohort = F.min("order_month").over(Window.partitionBy(PERSON))
    return months.select(
        PERSON,
        cohort.alias("cohort_month"),
        "order_month",
    ).select(PERSON, "cohort_month", month_index("order_month", "cohort_month").alias("month_index"))


def customer_activity(t: Tables, cohort: str | dt.date | None = None, split_hot: bool = False) -> DataFrame:
    """Order grain: ``customer_unique_id, cohort_month, order_month,
    month_index`` for every delivered order, optionally of one cohort.
    ``split_hot``: persons with a large share of all orders are found first
    (one job) and dealt over tasks, at any size; else adaptive execution splits
    them once they pass its threshold."""
    first = first_orders(t)
    if cohort is not None:
        first = first.filter(F.col("cohort_month") == to_date(cohort))
    joined = salted_join(person_orders(t), first, [PERSON]) if split_hot else person_orders(t).join(first, PERSON)
    return (
        joined.select(
            PERSON,
            "cohort_month",
            month_start("order_purchase_timestamp").alias("order_month"),
            month_index("order_purchase_timestamp", "cohort_month").alias("month_index"),
        )
    )


def reviewed_deliveries(t: Tables, require_estimate: bool) -> DataFrame:
    """Reviews of delivered orders with a delivery date: ``review_score``,
    ``delivery_us`` (purchase -> delivery) and ``vs_estimate_us`` (estimate ->
    delivery; NULL without an estimate), both exact microseconds."""
    orders = delivered_orders(t).filter(F.col("order_delivered_customer_date").isNotNull())
    if require_estimate:
        orders = orders.filter(F.col("order_estimated_delivery_date").isNotNull())
    orders = orders.select(
        "order_id",
        micros_between("order_purchase_timestamp", "order_delivered_customer_date").alias("delivery_us"),
        micros_between("order_estimated_delivery_date", "order_delivered_customer_date").alias(
            "vs_estimate_us"
        ),
    )
    return t["order_reviews"].select("order_id", "review_score").join(orders, "order_id")


def order_review_stats(t: Tables) -> DataFrame:
    """Per delivered order with reviews: ``n_reviews`` (rows), ``n_scored``
    (non-null scores), ``score_sum`` and ``n_negative``.

    Joining items to reviews multiplies rows per order; these per-order sums,
    weighted by an item count, reproduce every measure of that fan-out join
    without materialising it."""
    if f"{ENTITY}order_review_stats" in t:
        return t[f"{ENTITY}order_review_stats"]
    score = F.col("review_score")
    stats = t["order_reviews"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count(score).alias("n_scored"),
        F.sum(score).cast("bigint").alias("score_sum"),
        F.count_if(score <= NEGATIVE_MAX_SCORE).alias("n_negative"),
    )
    return stats.join(delivered_orders(t, "order_id"), "order_id")


def weighted_review_measures(weight: Column) -> list[Column]:
    """Aggregates over (order x group) rows carrying ``order_review_stats``:
    the sums the fan-out join would produce for COUNT(*), COUNT(score),
    SUM(score) and COUNT(*) FILTER (negative)."""
    return [
        F.sum(weight * F.col("n_reviews")).alias("n_rows"),
        F.sum(weight * F.col("n_scored")).alias("n_scored"),
        F.sum(weight * F.col("score_sum")).alias("score_sum"),
        F.sum(weight * F.col("n_negative")).alias("n_negative"),
    ]
