"""Independent DuckDB SQL for every registered query.

The statements are written from the report definitions (SURVEY, section
2.13) over the raw test tables, not from the Spark plans: orders, lines and
opinions are joined plainly, distinct things are counted as such, and NTILE
is worked out from ranks.  Labels and cut points come from the one place that
holds these fixed values, ``mercata.plans.rules``; its rule order is tested
apart on all score triples.  Roundings are done in integers, half away from
zero (DuckDB divides decimals in DOUBLE, which cannot round exactly).
Outputs use BIGINT for counts and scores and DOUBLE for money and
percentages, the types ``__spark_entry__`` normalises the Spark results to.
"""

from __future__ import annotations

from mercata.plans import rules as R
from mercata.sources.testdata import (
    FIXTURE_ANCHOR,
    FIXTURE_FROM_COHORT,
    FIXTURE_REVENUE_RANGE,
    FIXTURE_SAMPLE_COHORT,
    FIXTURE_SELLER_CUTS,
    FIXTURE_SELLER_LABELS,
    FIXTURE_TRANSLATIONS,
)

DAY = 86_400_000_000  # microseconds

# --- the test tables as marketplace tables (same arithmetic as the fixture) ----
PURCHASES = """
purchase AS (
    SELECT o_orderkey AS oid, o_custkey AS person, o_orderdate AS bought_at,
           o_orderstatus AS flag,
           IF(o_orderstatus = 'F' AND o_orderkey % 97 <> 0,
              o_orderdate + to_hours(CAST(o_orderkey * 7919 % 1080 + 24 AS INTEGER)), NULL) AS arrived_at,
           IF(o_orderkey % 89 <> 0, o_orderdate + to_days(CAST(14 + o_orderkey * 31 % 21 AS INTEGER)), NULL) AS promised_at
    FROM orders
),
settled AS (SELECT *, epoch_us(arrived_at) - epoch_us(bought_at) AS way_us, epoch_us(arrived_at) - epoch_us(promised_at) AS delay_us FROM purchase WHERE flag = 'F')"""
LINES = """
line AS (
    SELECT l_orderkey AS oid, l_linenumber AS nr, l_partkey AS part, l_suppkey AS seller,
           CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * 100 AS BIGINT) + CAST(CAST(l_quantity AS DECIMAL(10,2)) * 100 AS BIGINT) AS cents
    FROM lineitem
)"""

OPINIONS = """
opinion AS (
    SELECT oid * 10 + k AS rid, oid,
           CAST(IF(arrived_at > promised_at, 1, 3) + (oid * 13 + k) % 3 AS BIGINT) AS stars
    FROM purchase CROSS JOIN (SELECT unnest([0, 1]) AS k)
    WHERE IF(k = 0, oid % 10 <> 0, oid % 50 = 1)
)"""

WORDINGS = "\nwording AS (SELECT * FROM (VALUES {}) AS w(raw, english))".format(", ".join(f"('{a}', '{b}')" for a, b in FIXTURE_TRANSLATIONS))
ARTICLES = """
article AS (
    SELECT p_partkey AS part, coalesce(w.english, kind, '{unknown}') AS category
    FROM (SELECT p_partkey, IF(p_partkey % 29 <> 0, p_type, NULL) AS kind FROM part) LEFT JOIN wording w ON w.raw = kind
)""".format(unknown=R.UNKNOWN_CATEGORY)
SHOPS = "\nshop AS (SELECT s_suppkey AS seller, n_name AS state FROM supplier, nation WHERE n_nationkey = s_nationkey)"
STATUS = "CASE flag WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END"


def stmt(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)}\n{select}"


def rounded(top: str, bottom: str, digits: int, factor: int = 1) -> str:
    """factor * top / bottom rounded to digits in integers, as DOUBLE; NULL for no or a zero bottom."""
    t, b = f"CAST({top} AS HUGEINT)", f"CAST({bottom} AS HUGEINT)"
    size = f"(2 * {factor * 10**digits} * abs({t}) + {b}) // nullif(2 * {b}, 0)"
    return f"(CAST(sign({t}) AS DOUBLE) * CAST({size} AS DOUBLE) / {10**digits})"


def money(cents: str) -> str:
    return f"(CAST(CAST({cents} AS DECIMAL(38,0)) / 100 AS DOUBLE))"


def quintile(order: str) -> str:
    """The fifth that a row's rank falls in; the first N mod 5 fifths have one row more."""
    i, n = f"(row_number() OVER (ORDER BY {order}) - 1)", "count(*) OVER ()"
    return f"(1 + IF({i} < ({n}) % 5 * (({n}) // 5 + 1), {i} // (({n}) // 5 + 1), ({n}) % 5 + ({i} - ({n}) % 5 * (({n}) // 5 + 1)) // greatest(1, ({n}) // 5)))"


def label(table, default: str, columns: dict[str, str]) -> str:
    """CASE text of a rule table."""
    arms = []
    for name, limits in table:
        tests = [t for key, (low, high) in limits.items() for t in ([f"{columns[key]} >= {low}"] if low is not None else []) + ([f"{columns[key]} <= {high}"] if high is not None else [])]
        arms.append(f"WHEN {' AND '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(arms)} ELSE '{default}' END"


def banded(value: str, cuts, labels, test: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} {test} {c * DAY} THEN '{name}'" for c, name in zip(cuts, labels)) + f" ELSE '{labels[-1]}' END"


SPENT = "\nspent AS (SELECT oid, sum(cents) AS cents FROM line GROUP BY ALL)"
#: One row per person who has a delivered order with items.
PEOPLE = """
people AS (
    SELECT person, date_diff('day', CAST(max(bought_at) AS DATE), {anchor}) AS recency_days, count(*) AS frequency, sum(cents) AS cents
    FROM settled SEMI JOIN line USING (oid) JOIN spent USING (oid) GROUP BY ALL
)"""
FIXED = f"DATE '{FIXTURE_ANCHOR}'"
LATEST = "(SELECT CAST(max(bought_at) AS DATE) FROM settled)"
SCORED = f"""
scored AS (
    SELECT *, {quintile('recency_days, person')} AS r_score, {quintile('frequency DESC, cents DESC, person')} AS f_score, {quintile('cents DESC, person')} AS m_score
    FROM people
)"""
SEGMENT = label(R.RFM_RULES, R.RFM_DEFAULT, {"r": "r_score", "f": "f_score", "m": "m_score"})
TWO_TIER = label(R.TWO_TIER_RULES, R.TWO_TIER_DEFAULT, {"freq": "frequency", "r": "r_score", "m": "m_score"})


def people(select: str, anchor: str = FIXED) -> str:
    return stmt(select, PURCHASES, LINES, SPENT, PEOPLE.format(anchor=anchor), SCORED)


def per_segment(segment: str) -> str:
    return people(f"""
SELECT segment, n AS customers, {rounded('n', 'sum(n) OVER ()', 2, 100)} AS pct_customers, {money('c')} AS total_revenue,
       {rounded('c', 'sum(c) OVER ()', 2, 100)} AS pct_revenue, {rounded('c', 'n * 100', 2)} AS avg_customer_value,
       {rounded('f', 'n', 2)} AS avg_orders, {rounded('d', 'n', 0)} AS avg_recency_days
FROM (SELECT {segment} AS segment, count(*) AS n, sum(cents) AS c, sum(frequency) AS f, sum(recency_days) AS d FROM scored GROUP BY ALL)""")


SCORES = f"person AS customer_unique_id, recency_days, frequency, {money('cents')} AS monetary, r_score, f_score, m_score, {SEGMENT} AS segment"
TIERS = "IF(segment IN ({}), '{}', '{}')".format(", ".join(f"'{x}'" for x in R.TIER2_SEGMENTS), R.TIER2_LABEL, R.TIER1_LABEL)
PANEL = f"SELECT segment, count(*) AS customers, {money('sum(cents)')} AS total_revenue, {TIERS} AS tier FROM (SELECT *, {TWO_TIER} AS segment FROM scored) GROUP BY ALL"

#: Every delivered order of a person with the month of the person's first.
TRAIL = """
trail AS (
    SELECT person, date_trunc('month', bought_at) AS active, min(date_trunc('month', bought_at)) OVER (PARTITION BY person) AS joined
    FROM settled
),
steps AS (SELECT person, CAST(joined AS DATE) AS joined, CAST(active AS DATE) AS active, date_diff('month', joined, active) AS nth FROM trail)"""
CELLS = f"""
cells AS (
    SELECT joined, nth, count(DISTINCT person) AS n, max(IF(nth = 0, count(DISTINCT person), 0)) OVER (PARTITION BY joined) AS size
    FROM steps GROUP BY joined, nth
),
shown AS (SELECT *, {rounded('n', 'size', 2, 100)} AS pct FROM cells WHERE joined >= DATE '{FIXTURE_FROM_COHORT}' AND nth <= 6)"""
RATED = "\nrated AS (SELECT stars, way_us, delay_us FROM opinion JOIN settled USING (oid) WHERE arrived_at IS NOT NULL)"
LATE = rounded("count(*) FILTER (delay_us > 0)", "count(*)", 1, 100)
WAY = rounded("sum(way_us)", f"count(way_us) * {DAY}", 1)
NEGATIVE = rounded(f"count(*) FILTER (stars <= {R.NEGATIVE_MAX_SCORE})", "count(*)", 1, 100)
MEAN = rounded("sum(stars)", "count(stars)", 2)
STATUS_BAND = f"IF(coalesce(delay_us <= 0, false), '{R.ESTIMATE_STATUS_LABELS[0]}', '{R.ESTIMATE_STATUS_LABELS[1]}')"


def rated(select: str, *more: str) -> str:
    return stmt(select, PURCHASES, OPINIONS, RATED, *more)


#: Every line of a delivered order beside every opinion on that order.
TOLD = "\ntold AS (SELECT line.*, rid, stars FROM line JOIN opinion USING (oid) SEMI JOIN settled USING (oid))"


def worst_sellers(opinions: str) -> str:
    return stmt(f"""
SELECT seller AS seller_id, state AS seller_state, total_orders, total_reviews, avg_review_score, pct_negative_reviews
FROM (SELECT seller, count(DISTINCT oid) AS total_orders, count(DISTINCT rid) AS total_reviews, {MEAN} AS avg_review_score, {NEGATIVE} AS pct_negative_reviews
      FROM told GROUP BY seller HAVING total_reviews >= 50) JOIN shop USING (seller)
ORDER BY pct_negative_reviews DESC, total_orders DESC, seller_id, seller_state LIMIT 25""", PURCHASES, LINES, opinions, TOLD, SHOPS)


def tier_report(cuts, labels) -> str:
    arms = " ".join(f"WHEN total >= CAST({cut} AS DECIMAL(4,2)) * n THEN '{name}'" for cut, name in zip(cuts, labels))
    return stmt(f"""
SELECT quality_tier, count(*) AS seller_count, CAST(sum(o) AS BIGINT) AS total_orders, {rounded('sum(o)', 'sum(sum(o)) OVER ()', 1, 100)} AS pct_orders,
       {rounded('sum(c)', '100', 0)} AS total_revenue, {rounded('sum(c)', 'sum(sum(c)) OVER ()', 1, 100)} AS pct_revenue
FROM (SELECT CASE {arms} ELSE '{labels[-1]}' END AS quality_tier, *
      FROM (SELECT seller, count(DISTINCT oid) AS o, sum(cents) AS c, sum(stars) AS total, count(stars) AS n FROM told GROUP BY seller) WHERE o >= 10)
GROUP BY quality_tier""", PURCHASES, LINES, OPINIONS, TOLD)


MONTHS = """
months AS (
    SELECT CAST(date_trunc('month', bought_at) AS DATE) AS month, count(*) AS n, sum(cents) AS c
    FROM settled JOIN spent USING (oid) WHERE bought_at >= TIMESTAMP '{}' AND bought_at < TIMESTAMP '{}' GROUP BY ALL
)""".format(*FIXTURE_REVENUE_RANGE)


def monthly(select: str) -> str:
    return stmt(select, PURCHASES, LINES, SPENT, MONTHS)


#: The nine tables: label, rows.
TABLE_SIZES = {
    "customers": "SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "orders": "SELECT count(*) FROM orders",
    "order_items": "SELECT count(*) FROM lineitem",
    "order_payments": "SELECT count(*) + count(*) FILTER (o_orderkey % 7 = 0) FROM orders",
    "order_reviews": "SELECT count(*) FILTER (o_orderkey % 10 <> 0) + count(*) FILTER (o_orderkey % 50 = 1) FROM orders",
    "products": "SELECT count(*) FROM part",
    "sellers": "SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "geolocation": "SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "category_translation": f"SELECT {len(FIXTURE_TRANSLATIONS)}",
}


def key_lines() -> str:
    """Duplicate and NULL lines of each primary key, orphan lines of each foreign key."""
    primary = [
        ("customers", "customer_id", "(SELECT o_orderkey AS a, 0 AS b FROM orders JOIN customer ON o_custkey = c_custkey)"),
        ("orders", "order_id", "(SELECT o_orderkey AS a, 0 AS b FROM orders)"),
        ("sellers", "seller_id", "(SELECT s_suppkey AS a, 0 AS b FROM supplier)"),
        ("products", "product_id", "(SELECT p_partkey AS a, 0 AS b FROM part)"),
        ("order_items", "order_id,order_item_id", "(SELECT l_orderkey AS a, l_linenumber AS b FROM lineitem)"),
        ("order_payments", "order_id,payment_sequential", "(SELECT o_orderkey AS a, 1 AS b FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 7 = 0)"),
        ("product_category_translation", "product_category_name", "(SELECT raw AS a, 0 AS b FROM wording)"),
    ]
    lines = []
    for table, columns, rows in primary:
        lines.append(f"SELECT 'duplicate primary key' AS \"check\", '{table}' AS table_name, '{columns}' AS columns, (SELECT count(*) FROM (SELECT a, b FROM {rows} GROUP BY a, b HAVING count(*) > 1)) AS violations")
        lines.append(f"SELECT 'null in primary key', '{table}', '{columns}', (SELECT count(*) FROM {rows} WHERE a IS NULL OR b IS NULL)")
    foreign = [
        ("orders", "customer_id", "customers", "orders", "o_orderkey", "orders JOIN customer ON o_custkey = c_custkey", "o_orderkey"),
        ("order_items", "order_id", "orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("order_items", "product_id", "products", "lineitem", "l_partkey", "part", "p_partkey"),
        ("order_items", "seller_id", "sellers", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("order_payments", "order_id", "orders", "orders", "o_orderkey", "orders", "o_orderkey"),
        ("order_reviews", "order_id", "orders", "opinion", "oid", "orders", "o_orderkey"),
    ]
    for table, column, parent, rows, key, parents, parent_key in foreign:
        lines.append(f"SELECT 'orphan of {parent}', '{table}', '{column}', (SELECT count(*) FROM {rows} WHERE {key} NOT IN (SELECT {parent_key} FROM {parents}))")
    return stmt("\nUNION ALL ".join(lines), PURCHASES, OPINIONS, WORDINGS)


STATES = "count(*) FILTER (length({}) <> 2)"

ORACLE_SQL: dict[str, str] = {
    # load audit and data quality
    "rep_row_counts": " UNION ALL ".join(f"SELECT '{name}' AS table_name, ({rows}) AS row_count" for name, rows in TABLE_SIZES.items()),
    "rep_order_coverage": "SELECT min(o_orderdate) AS earliest_order, max(o_orderdate) AS latest_order, count(*) AS total_orders, count(DISTINCT o_orderkey) AS unique_customers FROM orders",
    "rep_status_distribution": stmt(f"SELECT {STATUS} AS order_status, count(*) AS order_count, {rounded('count(*)', 'sum(count(*)) OVER ()', 2, 100)} AS pct_of_total FROM purchase GROUP BY ALL", PURCHASES),
    "rep_order_null_counts": stmt(
        "SELECT count(*) - count(oid) AS null_customer_id, count(*) - count(bought_at) AS null_purchase_time, count(*) - count(arrived_at) AS null_delivered_date, count(*) - count(promised_at) AS null_estimated_delivery FROM purchase",
        PURCHASES,
    ),
    "rep_duplicate_orders": "SELECT o_orderkey AS order_id, count(*) AS dup_count FROM orders GROUP BY ALL HAVING count(*) > 1",
    "rep_orders_without_items": "SELECT count(*) AS orders_without_items FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey",
    # RFM
    "rep_analysis_window": stmt("SELECT CAST(max(bought_at) AS DATE) AS analysis_anchor_date, count(*) AS total_delivered_orders FROM settled", PURCHASES),
    "rep_rfm_top": people(f"SELECT person AS customer_unique_id, recency_days, frequency, {money('cents')} AS monetary FROM people ORDER BY cents DESC, person LIMIT 20"),
    "rep_rfm_segments": people(f"SELECT {SCORES} FROM scored ORDER BY cents DESC, person LIMIT 25"),
    "rep_rfm_segments_latest": people(f"SELECT {SCORES} FROM scored ORDER BY cents DESC, person LIMIT 25", LATEST),
    "rep_rfm_segment_summary": per_segment(SEGMENT),
    "rep_purchase_frequency": people(f"""
SELECT {label(R.PURCHASE_PATTERN_RULES, R.PURCHASE_PATTERN_DEFAULT, {'n': 'frequency'})} AS purchase_pattern, count(*) AS customers,
       {rounded('count(*)', 'sum(count(*)) OVER ()', 2, 100)} AS pct_of_customers
FROM people GROUP BY ALL"""),
    "rep_two_tier_segment_summary": per_segment(TWO_TIER),
    "rep_two_tier_segment_revenue": people(PANEL),
    "rep_two_tier_panel": people(f"SELECT * FROM ({PANEL}) WHERE tier = '{R.TIER2_LABEL}'"),
    # cohorts
    "rep_new_customers_by_cohort": stmt("SELECT joined AS cohort_month, count(DISTINCT person) AS new_customers_in_cohort FROM steps GROUP BY ALL", PURCHASES, TRAIL),
    "rep_cohort_activity_sample": stmt(
        f"SELECT person AS customer_unique_id, joined AS cohort_month, active AS order_month, nth AS month_index FROM steps WHERE joined = DATE '{FIXTURE_SAMPLE_COHORT}' ORDER BY person, nth LIMIT 20",
        PURCHASES, TRAIL,
    ),
    "rep_retention_long": stmt("SELECT joined AS cohort_month, size AS cohort_size, nth AS month_index, n AS active_customers, pct AS retention_pct FROM shown", PURCHASES, TRAIL, CELLS),
    "rep_retention_matrix": stmt(
        "SELECT joined AS cohort_month, size AS cohort_size, " + ", ".join(f"coalesce(max(pct) FILTER (nth = {m}), 0) AS month_{m}_pct" for m in range(1, 7)) + " FROM shown GROUP BY joined, size",
        PURCHASES, TRAIL, CELLS,
    ),
    "rep_retention_heatmap_long": stmt("SELECT joined AS cohort_month, nth AS month_index, pct AS retention_pct FROM shown", PURCHASES, TRAIL, CELLS),
    "rep_retention_heatmap": stmt(
        "SELECT strftime(joined, '%Y-%m') AS cohort, " + ", ".join(f"max(pct) FILTER (nth = {m}) AS month_{m}" for m in range(1, 7)) + " FROM shown GROUP BY joined",
        PURCHASES, TRAIL, CELLS,
    ),
    # satisfaction and operations
    "rep_review_distribution": stmt(
        f"SELECT stars AS review_score, count(*) AS review_count, {rounded('count(*)', 'sum(count(*)) OVER ()', 2, 100)} AS pct_of_reviews FROM opinion SEMI JOIN settled USING (oid) GROUP BY stars",
        PURCHASES, OPINIONS,
    ),
    "rep_delivery_by_score": rated(f"""
SELECT stars AS review_score, count(*) AS orders, {WAY} AS avg_delivery_days, {rounded('sum(delay_us)', f'count(delay_us) * {DAY}', 1)} AS avg_days_vs_estimate, {LATE} AS pct_delivered_late
FROM rated WHERE delay_us IS NOT NULL GROUP BY stars"""),
    "rep_delivery_by_score_simple": rated(f"SELECT stars AS review_score, {WAY} AS avg_delivery_days, {LATE} AS pct_delivered_late FROM rated GROUP BY stars"),
    "rep_speed_x_accuracy": rated(f"""
SELECT {banded('way_us', R.SPEED_CUTS_DAYS, R.SPEED_LABELS, '<')} AS delivery_speed_band, {banded('delay_us', R.ACCURACY_CUTS_DAYS, R.ACCURACY_LABELS, '<=')} AS estimate_accuracy_band,
       count(*) AS orders, {MEAN} AS avg_review_score, {NEGATIVE} AS pct_negative_reviews
FROM rated WHERE delay_us IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100"""),
    "rep_negative_rate_speed_x_late": rated(
        f"SELECT {banded('way_us', R.SPEED_CUTS_DAYS, R.SPEED_LABELS_PLAIN, '<')} AS delivery_band, {STATUS_BAND} AS estimate_status, {NEGATIVE} AS pct_negative FROM rated GROUP BY 1, 2"
    ),
    "rep_negative_rate_matrix": rated(f"""
SELECT delivery_band, place - 1 AS band_order, on_time_or_early, late
FROM (SELECT unnest({R.SPEED_LABELS_PLAIN!r}) AS delivery_band, generate_subscripts({R.SPEED_LABELS_PLAIN!r}, 1) AS place)
LEFT JOIN (SELECT {banded('way_us', R.SPEED_CUTS_DAYS, R.SPEED_LABELS_PLAIN, '<')} AS delivery_band, {NEGATIVE} AS on_time_or_early
           FROM rated WHERE delay_us <= 0 GROUP BY 1) USING (delivery_band)
LEFT JOIN (SELECT {banded('way_us', R.SPEED_CUTS_DAYS, R.SPEED_LABELS_PLAIN, '<')} AS delivery_band, {NEGATIVE} AS late
           FROM rated WHERE delay_us > 0 OR delay_us IS NULL GROUP BY 1) USING (delivery_band)"""),
    "rep_worst_sellers": worst_sellers(OPINIONS),
    "op_worst_sellers_repeated_ids": worst_sellers(OPINIONS.replace("oid * 10 + k AS rid", "(oid * 10 + k) % 997 AS rid")),
    "rep_seller_quality_tiers": tier_report(R.SELLER_TIER_CUTS, R.SELLER_TIER_LABELS),
    "op_seller_tiers_fixture_cuts": tier_report(FIXTURE_SELLER_CUTS, FIXTURE_SELLER_LABELS),
    "rep_category_satisfaction": stmt(f"""
SELECT category, count(DISTINCT oid) AS orders, {MEAN} AS avg_review_score, {NEGATIVE} AS pct_negative_reviews
FROM told JOIN article USING (part) GROUP BY category HAVING count(DISTINCT oid) >= 200 ORDER BY pct_negative_reviews DESC, category LIMIT 20""",
        PURCHASES, LINES, OPINIONS, TOLD, WORDINGS, ARTICLES,
    ),
    # revenue
    "rep_monthly_revenue": monthly(f"SELECT month, n AS orders, {money('c')} AS revenue FROM months"),
    "op_monthly_revenue_mom": monthly(f"""
SELECT month, n AS orders, {money('c')} AS revenue, {money('p')} AS prev_revenue, IF(p > 0, {rounded('c - p', 'p', 2, 100)}, NULL) AS revenue_change_pct
FROM (SELECT *, lag(c) OVER (ORDER BY month) AS p FROM months)"""),
    "rep_revenue_totals": monthly(f"SELECT {money('sum(c)')} AS total_revenue, CAST(sum(n) AS BIGINT) AS total_orders FROM months"),
    # generic operators
    "op_global_ntile_asc": people("SELECT person AS customer_unique_id, recency_days, r_score FROM scored"),
    "op_global_ntile_composite": people(f"SELECT person AS customer_unique_id, frequency, {money('cents')} AS monetary, f_score FROM scored"),
    "op_rfm_scores_all": people(f"SELECT {SCORES} FROM scored"),
    "op_duplicate_item_keys": "SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS order_item_id, count(*) AS dup_count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "op_unmatched_orders": stmt(f"SELECT oid AS order_id, {STATUS} AS order_status FROM purchase ANTI JOIN lineitem ON l_orderkey = oid", PURCHASES),
    "op_key_report": key_lines(),
    "op_domain_report": stmt(
        f"SELECT 'customers' AS table_name, 'length(customer_state) = 2' AS rule, {STATES.format('n_name')} AS violations FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
        f" UNION ALL SELECT 'sellers', 'length(seller_state) = 2', {STATES.format('state')} FROM shop"
        f" UNION ALL SELECT 'geolocation', 'length(geolocation_state) = 2', {STATES.format('n_name')} FROM customer JOIN nation ON c_nationkey = n_nationkey"
        " UNION ALL SELECT 'order_reviews', 'review_score between 1 and 5', count(*) FILTER (stars < 1 OR stars > 5) FROM opinion",
        PURCHASES, OPINIONS, SHOPS,
    ),
    "op_left_join_coalesce": stmt("SELECT part AS product_id, category FROM article", WORDINGS, ARTICLES),
    "op_month_index": stmt("SELECT person AS customer_unique_id, joined AS cohort_month, active AS order_month, nth AS month_index FROM steps", PURCHASES, TRAIL),
    "op_month_index_hot": stmt("SELECT person AS customer_unique_id, joined AS cohort_month, active AS order_month, nth AS month_index FROM steps", PURCHASES.replace("o_custkey AS person", "IF(o_orderkey % 3 = 0, -1, o_custkey) AS person"), TRAIL),
    "op_days_between": stmt(f"SELECT oid AS order_id, CAST(way_us AS DOUBLE) / {DAY}.0 AS delivery_days, CAST(delay_us AS DOUBLE) / {DAY}.0 AS days_vs_estimate FROM settled", PURCHASES),
}
