"""Label rules of the reports.

Fixed values: every label text, cut point and rule order below must equal the
source analysis exactly (rules are tried top to bottom, first match wins).
Bounds are inclusive ``(low, high)``; ``None`` is open.
"""

from __future__ import annotations

from decimal import Decimal

# Standard RFM segments over (r, f, m) scores 1-5.
RFM_RULES = [
    ("Champions", {"r": (4, None), "f": (4, None), "m": (4, None)}),
    ("Loyal", {"r": (3, None), "f": (3, None), "m": (4, None)}),
    ("New Customers", {"r": (4, None), "f": (None, 2)}),
    ("Potential Loyalists", {"r": (3, None), "f": (3, None)}),
    ("At Risk", {"r": (None, 2), "f": (4, None), "m": (4, None)}),
    ("Need Attention", {"r": (None, 2), "f": (3, None)}),
    ("Cannot Lose Them", {"r": (None, 2), "m": (3, None)}),
    ("Hibernating", {"r": (None, 1)}),
]
RFM_DEFAULT = "Others"

# Two-tier segments over (frequency, r, m).
TWO_TIER_RULES = [
    ("VIP Repeat (4+ orders)", {"freq": (4, None)}),
    ("Loyal Repeat (3 orders)", {"freq": (3, 3)}),
    ("Active Repeat (2 orders, recent)", {"freq": (2, 2), "r": (3, None)}),
    ("Lapsed Repeat (2 orders, dormant)", {"freq": (2, 2)}),
    ("New High-Value", {"freq": (1, 1), "r": (4, None), "m": (4, None)}),
    ("New Customer", {"freq": (1, 1), "r": (4, None)}),
    ("Lost High-Value", {"freq": (1, 1), "r": (None, 2), "m": (4, None)}),
    ("Lost / Hibernating", {"freq": (1, 1), "r": (None, 2)}),
]
TWO_TIER_DEFAULT = "One-Time Mid-Tier"

# The repeat-buyer segments and the tier names of the segment chart.
TIER2_SEGMENTS = [
    "VIP Repeat (4+ orders)",
    "Loyal Repeat (3 orders)",
    "Active Repeat (2 orders, recent)",
    "Lapsed Repeat (2 orders, dormant)",
]
TIER2_LABEL = "Tier 2: Repeat Buyers"
TIER1_LABEL = "Tier 1: One-Time Buyers"

# Purchase-frequency buckets over order_count.
PURCHASE_PATTERN_RULES = [
    ("1 order (one-time)", {"n": (1, 1)}),
    ("2 orders", {"n": (2, 2)}),
    ("3 orders", {"n": (3, 3)}),
    ("4-5 orders", {"n": (4, 5)}),
]
PURCHASE_PATTERN_DEFAULT = "6+ orders"

# Delivery-speed bands, days < cut (right-open).
SPEED_CUTS_DAYS = [7, 14, 21, 30]
SPEED_LABELS = ["1. Under 7 days", "2. 7-13 days", "3. 14-20 days", "4. 21-29 days", "5. 30+ days"]
SPEED_LABELS_PLAIN = ["Under 7 days", "7-13 days", "14-20 days", "21-29 days", "30+ days"]

# Estimate-accuracy bands, days vs estimate <= cut.
ACCURACY_CUTS_DAYS = [-7, -3, 0, 3]
ACCURACY_LABELS = [
    "A. Early by 7+ days",
    "B. Early by 3-6 days",
    "C. On time or 1-2 early",
    "D. Late by 1-3 days",
    "E. Late by 4+ days",
]
# Two-way estimate status (<= 0 days vs estimate, else late).
ESTIMATE_STATUS_LABELS = ["On time or early", "Late"]

# Seller quality tiers, average review score >= cut.
SELLER_TIER_CUTS = [Decimal("4.5"), Decimal("4.0"), Decimal("3.5"), Decimal("3.0")]
SELLER_TIER_LABELS = [
    "1. Excellent (4.5+)",
    "2. Good (4.0-4.49)",
    "3. Adequate (3.5-3.99)",
    "4. Poor (3.0-3.49)",
    "5. Very Poor (<3.0)",
]

# A review is negative at score <= 2; the status that counts.
NEGATIVE_MAX_SCORE = 2
DELIVERED = "delivered"
UNKNOWN_CATEGORY = "unknown"

# Defaults of the source analysis.
DEFAULT_ANCHOR = "2018-10-17"
DEFAULT_FROM_COHORT = "2017-01-01"
DEFAULT_SAMPLE_COHORT = "2017-01-01"
DEFAULT_REVENUE_RANGE = ("2017-01-01", "2018-09-01")
ROW_COUNT_LABELS = {"product_category_translation": "category_translation"}
