"""The reports: one function per query of the source analysis, each taking a
mapping of table name to DataFrame and returning a lazy DataFrame."""

from mercata.plans.cohort import (
    cohort_activity_sample,
    new_customers_by_cohort,
    retention_heatmap,
    retention_heatmap_long,
    retention_long,
    retention_matrix,
)
from mercata.plans.quality import (
    domain_report,
    duplicate_orders,
    key_report,
    order_coverage,
    order_null_counts,
    orders_without_items,
    row_counts,
    status_distribution,
)
from mercata.plans.revenue import monthly_revenue, revenue_totals
from mercata.plans.rfm import (
    analysis_window,
    purchase_frequency,
    rfm_segment_summary,
    rfm_segments,
    rfm_top,
    two_tier_segment_revenue,
    two_tier_segment_summary,
)
from mercata.plans.satisfaction import (
    category_satisfaction,
    delivery_by_score,
    delivery_by_score_simple,
    negative_rate_matrix,
    negative_rate_speed_x_late,
    review_distribution,
    seller_quality_tiers,
    speed_x_accuracy,
    worst_sellers,
)

__all__ = [name for name in dir() if not name.startswith("_")]
