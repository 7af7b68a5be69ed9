"""Satisfaction and operations reports (4.1-4.6) and the delivery charts'
data (N4, N5).

Delivery times are exact microsecond differences; bands compare those
microseconds with whole-day cut points, so no fractional day is ever
rounded.  The seller and category reports join items to reviews per order
(a many-to-many fan-out in the source); here items are first reduced to one
row per (order, seller) or (order, category) with an item count, and every
measure of the fan-out join is rebuilt from item-count-weighted sums -- same
numbers, the item x review product is never materialised.  Reviews are
reduced to one row per order where only sums are needed; the worst-seller
report keeps review-grain rows for its exact count of distinct review ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.arith import (
    MICROS_PER_DAY,
    avg_days,
    exact_avg,
    round_ratio,
    split_micros,
    unscaled,
)
from mercata.functions.labels import band
from mercata.functions.sql import values_table
from mercata.operators.reshape import pivot_values, reindex_on
from mercata.operators.shares import share_of_total
from mercata.operators.topk import top_k
from mercata.plans.entities import (
    ENTITY,
    Tables,
    delivered_orders,
    order_review_stats,
    reviewed_deliveries,
    weighted_review_measures,
)
from mercata.plans.rules import (
    ACCURACY_CUTS_DAYS,
    ACCURACY_LABELS,
    ESTIMATE_STATUS_LABELS,
    NEGATIVE_MAX_SCORE,
    SELLER_TIER_CUTS,
    SELLER_TIER_LABELS,
    SPEED_CUTS_DAYS,
    SPEED_LABELS,
    SPEED_LABELS_PLAIN,
    UNKNOWN_CATEGORY,
)

REVIEW_SCORE = "review_score"


def review_distribution(t: Tables) -> DataFrame:
    """4.1 reviews of delivered orders per score, with share."""
    reviews = t["order_reviews"].select("order_id", "review_score").join(
        delivered_orders(t, "order_id"), "order_id"
    )
    grouped = reviews.groupBy("review_score").agg(F.count(F.lit(1)).alias("review_count"))
    return share_of_total(grouped, "review_count", "pct_of_reviews", 2).orderBy(
        F.col("review_score").desc_nulls_first()
    )


def _delivery_aggs(late: bool = True) -> list[Column]:
    sec, rest = split_micros(F.col("delivery_us"))
    aggs = [
        F.count(F.lit(1)).alias("orders"),
        F.sum(sec).alias("_d_sec"),
        F.sum(rest).alias("_d_rest"),
        F.count("delivery_us").alias("_d_n"),
    ]
    if late:
        aggs.append(F.count_if(F.col("vs_estimate_us") > 0).alias("_late"))
    return aggs


def delivery_by_score(t: Tables) -> DataFrame:
    """4.2 per review score: reviews, average delivery days, average days
    against the estimate and share delivered late (both dates required)."""
    rows = reviewed_deliveries(t, require_estimate=True)
    sec, rest = split_micros(F.col("vs_estimate_us"))
    grouped = rows.groupBy("review_score").agg(
        *_delivery_aggs(),
        F.sum(sec).alias("_e_sec"),
        F.sum(rest).alias("_e_rest"),
        F.count("vs_estimate_us").alias("_e_n"),
    )
    return grouped.select(
        "review_score",
        "orders",
        avg_days("_d_sec", "_d_rest", "_d_n", 1).alias("avg_delivery_days"),
        avg_days("_e_sec", "_e_rest", "_e_n", 1).alias("avg_days_vs_estimate"),
        round_ratio("_late", "orders", 1, factor=100).alias("pct_delivered_late"),
    ).orderBy(F.col("review_score").desc_nulls_first())


def delivery_by_score_simple(t: Tables) -> DataFrame:
    """N4 per review score: average delivery days and share late; the
    estimate is not required (no estimate = not late)."""
    grouped = reviewed_deliveries(t, require_estimate=False).groupBy("review_score").agg(*_delivery_aggs())
    return grouped.select(
        "review_score",
        avg_days("_d_sec", "_d_rest", "_d_n", 1).alias("avg_delivery_days"),
        round_ratio("_late", "orders", 1, factor=100).alias("pct_delivered_late"),
    ).orderBy(F.col("review_score").desc_nulls_first())


def speed_band(labels: Sequence[str] = SPEED_LABELS) -> Column:
    us = F.col("delivery_us")
    return band(SPEED_CUTS_DAYS, labels, lambda days: us < F.lit(days * MICROS_PER_DAY))


def accuracy_band() -> Column:
    us = F.col("vs_estimate_us")
    return band(ACCURACY_CUTS_DAYS, ACCURACY_LABELS, lambda days: us <= F.lit(days * MICROS_PER_DAY))


def estimate_status() -> Column:
    """On time or early at <= 0 days against the estimate, else (also with no
    estimate) late."""
    return band([0], ESTIMATE_STATUS_LABELS, lambda days: F.col("vs_estimate_us") <= F.lit(days))


def _score_measures() -> list[Column]:
    score = F.col(REVIEW_SCORE)
    return [
        F.count(F.lit(1)).alias("orders"),
        F.sum(score).alias("_score_sum"),
        F.count(score).alias("_scored"),
        F.count_if(score <= NEGATIVE_MAX_SCORE).alias("_neg"),
    ]


def speed_x_accuracy(t: Tables, min_orders: int = 100) -> DataFrame:
    """4.3 review outcome per (speed band, estimate-accuracy band) cell with
    at least ``min_orders`` reviews."""
    rows = reviewed_deliveries(t, require_estimate=True)
    grouped = (
        rows.groupBy(speed_band().alias("delivery_speed_band"), accuracy_band().alias("estimate_accuracy_band"))
        .agg(*_score_measures())
        .filter(F.col("orders") >= min_orders)
    )
    return grouped.select(
        "delivery_speed_band",
        "estimate_accuracy_band",
        "orders",
        exact_avg("_score_sum", "_scored", 2).alias("avg_review_score"),
        round_ratio("_neg", "orders", 1, factor=100).alias("pct_negative_reviews"),
    ).orderBy("delivery_speed_band", "estimate_accuracy_band")


def negative_rate_speed_x_late(t: Tables) -> DataFrame:
    """N5 (query) share of negative reviews per speed band and on-time/late
    status; delivery date required, estimate not."""
    grouped = (
        reviewed_deliveries(t, require_estimate=False)
        .groupBy(speed_band(SPEED_LABELS_PLAIN).alias("delivery_band"), estimate_status().alias("estimate_status"))
        .agg(*_score_measures())
    )
    return grouped.select(
        "delivery_band",
        "estimate_status",
        round_ratio("_neg", "orders", 1, factor=100).alias("pct_negative"),
    ).orderBy("delivery_band", "estimate_status")


def negative_rate_matrix(t: Tables) -> DataFrame:
    """N5 (matrix) one row per speed band in business order (absent bands
    kept as NULL rows), columns ``on_time_or_early`` and ``late``."""
    long = negative_rate_speed_x_late(t)
    wide = pivot_values(
        long, ["delivery_band"], "estimate_status", ESTIMATE_STATUS_LABELS, "pct_negative",
        ["on_time_or_early", "late"],
    )
    bands = values_table(long.sparkSession, [(label, i) for i, label in enumerate(SPEED_LABELS_PLAIN)], ["delivery_band", "band_order"])
    bands = bands.withColumn("band_order", F.col("band_order").cast("int"))
    return reindex_on(wide, bands, "delivery_band", "band_order").select(
        "delivery_band", "band_order", "on_time_or_early", "late"
    )


def items_per_order(t: Tables, key: str) -> DataFrame:
    """Items of delivered, reviewed orders reduced to ``(order_id, key)`` with
    item count and revenue, along with the order's review sums.

    Items meet the orders first: that join deals them by order_id (or finds
    them dealt so in bucketed tables), and the reduction keeps that layout, so
    they are moved once."""
    if f"{ENTITY}items_per_{key}" in t:
        return t[f"{ENTITY}items_per_{key}"]
    stats = ["n_reviews", "n_scored", "score_sum", "n_negative"]
    items = t["order_items"].select("order_id", key, (F.col("price") + F.col("freight_value")).alias("item_total"))
    return items.join(order_review_stats(t), "order_id").groupBy("order_id", key, *stats).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("item_total").alias("item_revenue")
    )


def worst_sellers(t: Tables, min_reviews: int = 50, k: int = 25) -> DataFrame:
    """4.4 sellers with at least ``min_reviews`` distinct reviews, highest
    negative share first.

    Items are reduced to (order, seller, item count) and joined to the review
    rows of their orders; each row stands for ``n_items`` rows of the source's
    fan-out join.  One review of each order carries a flag, so orders are a
    plain sum and only review ids (which may repeat) are counted distinct."""
    score = F.col(REVIEW_SCORE)
    n_items = F.col("n_items")
    nth = F.row_number().over(Window.partitionBy("order_id").orderBy("review_id"))
    reviews = t["order_reviews"].select("order_id", "review_id", REVIEW_SCORE).withColumn("is_first", nth == 1)
    rows = items_per_order(t, "seller_id").select("order_id", "seller_id", "n_items").join(reviews, "order_id")
    measures = rows.groupBy("seller_id").agg(
        F.count_if("is_first").alias("total_orders"),
        F.count_distinct("review_id").alias("total_reviews"),
        F.sum(n_items).alias("n_rows"),
        F.sum(F.when(score.isNotNull(), n_items)).alias("n_scored"),
        F.sum(n_items * score).alias("score_sum"),
        F.sum(F.when(score <= NEGATIVE_MAX_SCORE, n_items)).alias("n_negative"),
    )
    sellers = t["sellers"].select("seller_id", "seller_state").distinct()
    joined = measures.filter(F.col("total_reviews") >= min_reviews).join(sellers, "seller_id")
    out = joined.select(
        "seller_id",
        "seller_state",
        "total_orders",
        "total_reviews",
        exact_avg("score_sum", "n_scored", 2).alias("avg_review_score"),
        round_ratio(F.coalesce(F.col("n_negative"), F.lit(0)), "n_rows", 1, factor=100).alias("pct_negative_reviews"),
    )
    return top_k(
        out,
        [F.col("pct_negative_reviews").desc(), F.col("total_orders").desc(), F.col("seller_id").asc(), F.col("seller_state").asc()],
        k,
    )


def seller_tier(cuts: Sequence[Decimal] = SELLER_TIER_CUTS, labels: Sequence[str] = SELLER_TIER_LABELS) -> Column:
    """Tier from the unrounded average score, compared exactly as
    ``score_sum >= cut * n_scored``."""
    s, n = F.col("score_sum"), F.col("n_scored")
    return band(cuts, labels, lambda cut: (n > 0) & (s >= F.lit(Decimal(cut)) * n))


def seller_quality_tiers(
    t: Tables,
    min_orders: int = 10,
    cuts: Sequence[Decimal] = SELLER_TIER_CUTS,
    labels: Sequence[str] = SELLER_TIER_LABELS,
) -> DataFrame:
    """4.5 sellers with at least ``min_orders`` reviewed delivered orders,
    bucketed by average review score: sellers, orders and revenue per tier
    with shares.  Revenue is counted once per review row, as in the source's
    fan-out join."""
    n_items = F.col("n_items")
    sellers = (
        items_per_order(t, "seller_id")
        .groupBy("seller_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum(F.col("item_revenue") * F.col("n_reviews")).alias("gross_revenue"),
            F.sum(n_items * F.col("score_sum")).alias("score_sum"),
            F.sum(n_items * F.col("n_scored")).alias("n_scored"),
        )
        .filter(F.col("orders") >= min_orders)
    )
    tiers = sellers.groupBy(seller_tier(cuts, labels).alias("quality_tier")).agg(
        F.count(F.lit(1)).alias("seller_count"),
        F.sum("orders").alias("total_orders"),
        F.sum("gross_revenue").alias("_revenue"),
    )
    tiers = share_of_total(tiers, "total_orders", "pct_orders", 1)
    tiers = share_of_total(tiers, "_revenue", "pct_revenue", 1, value_scale=2)
    return tiers.select(
        "quality_tier",
        "seller_count",
        "total_orders",
        "pct_orders",
        round_ratio(unscaled("_revenue", 2), F.lit(100), 0).alias("total_revenue"),
        "pct_revenue",
    ).orderBy("quality_tier")


def product_categories(t: Tables) -> DataFrame:
    """``product_id, category``: English name, else the raw name, else
    ``unknown`` (left join to the translation table)."""
    products = t["products"].select("product_id", "product_category_name")
    translation = t["product_category_translation"].select(
        "product_category_name", "product_category_name_english"
    )
    return products.join(translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce(
            F.col("product_category_name_english"), F.col("product_category_name"), F.lit(UNKNOWN_CATEGORY)
        ).alias("category"),
    )


def category_satisfaction(t: Tables, min_orders: int = 200, k: int = 20) -> DataFrame:
    """4.6 categories with at least ``min_orders`` reviewed delivered orders,
    highest negative share first."""
    items = t["order_items"].select("order_id", "product_id").join(product_categories(t), "product_id")
    stats = ["n_reviews", "n_scored", "score_sum", "n_negative"]
    per_order = items.join(order_review_stats(t), "order_id").groupBy("order_id", "category", *stats).agg(F.count(F.lit(1)).alias("n_items"))
    grouped = (
        per_order.groupBy("category")
        .agg(F.count(F.lit(1)).alias("orders"), *weighted_review_measures(F.col("n_items")))
        .filter(F.col("orders") >= min_orders)
    )
    out = grouped.select(
        "category",
        "orders",
        exact_avg("score_sum", "n_scored", 2).alias("avg_review_score"),
        round_ratio("n_negative", "n_rows", 1, factor=100).alias("pct_negative_reviews"),
    )
    return top_k(out, [F.col("pct_negative_reviews").desc(), F.col("category").asc()], k)
