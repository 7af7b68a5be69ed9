"""RFM reports (2.1-2.6) and the two-tier segment revenue chart data (N2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.functions.arith import exact_avg
from mercata.functions.labels import label_by_rules
from mercata.operators.shares import share_of_total
from mercata.operators.topk import top_k
from mercata.plans.entities import PERSON, Anchor, Tables, customer_orders, delivered_orders, rfm_raw, rfm_scored
from mercata.plans.rules import (
    PURCHASE_PATTERN_DEFAULT,
    PURCHASE_PATTERN_RULES,
    RFM_DEFAULT,
    RFM_RULES,
    TIER1_LABEL,
    TIER2_LABEL,
    TIER2_SEGMENTS,
    TWO_TIER_DEFAULT,
    TWO_TIER_RULES,
)


def analysis_window(t: Tables) -> DataFrame:
    """2.1 latest delivered purchase date and the delivered order count."""
    return delivered_orders(t).agg(
        F.max("order_purchase_timestamp").cast("date").alias("analysis_anchor_date"),
        F.count(F.lit(1)).alias("total_delivered_orders"),
    )


def rfm_top(t: Tables, anchor: Anchor = None, k: int = 20) -> DataFrame:
    """2.2 raw RFM of the ``k`` biggest spenders."""
    return top_k(rfm_raw(t, anchor), [F.col("monetary").desc(), F.col(PERSON).asc()], k)


def rfm_segment(score_cols: dict[str, str] | None = None) -> F.Column:
    """Standard RFM segment label over columns r_score, f_score, m_score."""
    names = score_cols or {"r": "r_score", "f": "f_score", "m": "m_score"}
    return label_by_rules(RFM_RULES, RFM_DEFAULT, names)


def two_tier_segment() -> F.Column:
    """Two-tier segment label over frequency, r_score and m_score."""
    cols = {"freq": "frequency", "r": "r_score", "m": "m_score"}
    return label_by_rules(TWO_TIER_RULES, TWO_TIER_DEFAULT, cols)


def _scored(t: Tables, anchor: Anchor, scores: str, scored: DataFrame | None, ntile_options: dict) -> DataFrame:
    """The caller's precomputed scores (``run_all`` scores once for every
    segment report), else a fresh scoring."""
    return scored if scored is not None else rfm_scored(t, anchor, scores, **ntile_options)


def rfm_segments(
    t: Tables, anchor: Anchor = None, k: int | None = 25, scored: DataFrame | None = None, **ntile_options
) -> DataFrame:
    """2.3 RFM scores and segment per person; the ``k`` biggest spenders
    (``k=None`` returns everyone).  ``scored``: precomputed
    :func:`~mercata.plans.entities.rfm_scored` output with r, f and m."""
    scored = _scored(t, anchor, "rfm", scored, ntile_options).select(
        PERSON, "recency_days", "frequency", "monetary", "r_score", "f_score", "m_score",
        rfm_segment().alias("segment"),
    )
    if k is None:
        return scored
    return top_k(scored, [F.col("monetary").desc(), F.col(PERSON).asc()], k)


def _segment_summary(segmented: DataFrame) -> DataFrame:
    grouped = segmented.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("monetary").alias("total_revenue"),
        F.sum("frequency").alias("_orders"),
        F.sum("recency_days").alias("_recency"),
    )
    grouped = share_of_total(grouped, "customers", "pct_customers", 2)
    grouped = share_of_total(grouped, "total_revenue", "pct_revenue", 2, value_scale=2)
    return grouped.select(
        "segment",
        "customers",
        "pct_customers",
        "total_revenue",
        "pct_revenue",
        exact_avg("total_revenue", "customers", 2, value_scale=2).alias("avg_customer_value"),
        exact_avg("_orders", "customers", 2).alias("avg_orders"),
        exact_avg("_recency", "customers", 0).alias("avg_recency_days"),
    ).orderBy(F.col("total_revenue").desc(), "segment")


def rfm_segment_summary(
    t: Tables, anchor: Anchor = None, scored: DataFrame | None = None, **ntile_options
) -> DataFrame:
    """2.4 customers, revenue and averages per standard RFM segment."""
    scored = _scored(t, anchor, "rfm", scored, ntile_options)
    return _segment_summary(scored.withColumn("segment", rfm_segment()))


def customer_frequency(t: Tables) -> DataFrame:
    """``customer_unique_id, order_count`` over delivered orders with items."""
    return customer_orders(t).groupBy(PERSON).agg(F.count(F.lit(1)).alias("order_count"))


def purchase_frequency(t: Tables) -> DataFrame:
    """2.5 how many people bought once, twice, ... with their share."""
    grouped = (
        customer_frequency(t)
        .withColumn("purchase_pattern", label_by_rules(PURCHASE_PATTERN_RULES, PURCHASE_PATTERN_DEFAULT, {"n": "order_count"}))
        .groupBy("purchase_pattern")
        .agg(F.count(F.lit(1)).alias("customers"), F.min("order_count").alias("_min_orders"))
    )
    return (
        share_of_total(grouped, "customers", "pct_of_customers", 2)
        .orderBy("_min_orders")
        .select("purchase_pattern", "customers", "pct_of_customers")
    )


def two_tier_segmented(
    t: Tables, anchor: Anchor = None, scored: DataFrame | None = None, **ntile_options
) -> DataFrame:
    """Per person: raw RFM, r/m quintiles over everyone, two-tier segment.
    ``scored`` may carry r and m (and f, unused): the r and m orderings are
    the same as in the standard scoring."""
    scored = _scored(t, anchor, "rm", scored, ntile_options)
    return scored.withColumn("segment", two_tier_segment())


def two_tier_segment_summary(
    t: Tables, anchor: Anchor = None, scored: DataFrame | None = None, **ntile_options
) -> DataFrame:
    """2.6 the segment summary of 2.4 for the two-tier segmentation."""
    return _segment_summary(two_tier_segmented(t, anchor, scored, **ntile_options))


def segment_tier() -> F.Column:
    """Tier of a two-tier segment label (repeat vs one-time buyers)."""
    return F.when(F.col("segment").isin(*TIER2_SEGMENTS), F.lit(TIER2_LABEL)).otherwise(F.lit(TIER1_LABEL))


def two_tier_segment_revenue(
    t: Tables, anchor: Anchor = None, tier: str | None = None, scored: DataFrame | None = None, **ntile_options
) -> DataFrame:
    """N2 ``segment, customers, total_revenue, tier`` (chart data); ``tier``
    keeps one tier only (the chart's per-panel selection)."""
    out = (
        two_tier_segmented(t, anchor, scored, **ntile_options)
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("total_revenue"))
        .withColumn("tier", segment_tier())
    )
    if tier is not None:
        out = out.filter(F.col("tier") == tier)
    return out.orderBy(F.col("total_revenue").desc(), "segment")
