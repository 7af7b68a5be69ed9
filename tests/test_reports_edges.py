"""Reports on hand-made rows: the edge cases each source query implies."""

import datetime as dt
from decimal import Decimal


from mercata import plans
from mercata.plans import entities as E

D = Decimal
T0 = dt.datetime(2018, 1, 10, 12, 0)


def order(oid, cid, status="delivered", ts=T0, delivered=None, estimated=None):
    return {
        "order_id": oid,
        "customer_id": cid,
        "order_status": status,
        "order_purchase_timestamp": ts,
        "order_delivered_customer_date": delivered,
        "order_estimated_delivery_date": estimated,
    }


def item(oid, n, price="10.00", freight="1.00", seller="s1", product="p1"):
    return {"order_id": oid, "order_item_id": n, "price": D(price), "freight_value": D(freight), "seller_id": seller, "product_id": product}


def test_revenue_grain_and_identity(mk):
    t = mk(
        orders=[
            order("o1", "c1"),
            order("o2", "c2", ts=dt.datetime(2018, 1, 20)),
            order("o3", "c3"),  # no items: absent from revenue joins
            order("o4", "c4", status="canceled"),
            order("o5", "c5", ts=dt.datetime(2018, 2, 1)),
        ],
        customers=[
            {"customer_id": "c1", "customer_unique_id": "P"},
            {"customer_id": "c2", "customer_unique_id": "P"},  # same person, second order id
            {"customer_id": "c3", "customer_unique_id": "Q"},
            {"customer_id": "c4", "customer_unique_id": "Q"},
            {"customer_id": "c5", "customer_unique_id": "R"},
        ],
        order_items=[item("o1", 1), item("o1", 2), item("o1", 3), item("o2", 1, "0.00", "0.00"), item("o4", 1), item("o5", 1, "5.50", "0.25")],
    )
    raw = {r["customer_unique_id"]: r for r in E.rfm_raw(t, "2018-01-20").collect()}
    assert set(raw) == {"P", "R"}
    assert raw["P"]["frequency"] == 2 and raw["P"]["monetary"] == D("33.00")
    assert raw["P"]["recency_days"] == 0
    assert raw["R"]["recency_days"] == -12  # order after the anchor: negative, kept
    monthly = {r["month"]: (r["orders"], r["revenue"]) for r in plans.monthly_revenue(t, "2018-01-01", "2018-02-01").collect()}
    assert monthly == {dt.date(2018, 1, 1): (2, D("33.00"))}
    assert plans.orders_without_items(t).first()["orders_without_items"] == 1
    # default anchor = latest delivered purchase date
    raw_default = {r["customer_unique_id"]: r["recency_days"] for r in E.rfm_raw(t).collect()}
    assert raw_default["R"] == 0


def test_purchase_frequency_buckets(mk):
    orders, customers, items = [], [], []
    for person, n in enumerate([1, 2, 3, 4, 5, 6, 40]):
        for k in range(n):
            oid = f"o{person}_{k}"
            orders.append(order(oid, oid))
            customers.append({"customer_id": oid, "customer_unique_id": f"p{person}"})
            items.append(item(oid, 1))
    t = mk(orders=orders, customers=customers, order_items=items)
    got = [(r["purchase_pattern"], r["customers"], r["pct_of_customers"]) for r in plans.purchase_frequency(t).collect()]
    assert got == [
        ("1 order (one-time)", 1, D("14.29")),
        ("2 orders", 1, D("14.29")),
        ("3 orders", 1, D("14.29")),
        ("4-5 orders", 2, D("28.57")),
        ("6+ orders", 2, D("28.57")),
    ]


def test_retention_cells(mk):
    jan, feb, mar = dt.datetime(2017, 1, 5), dt.datetime(2017, 2, 5), dt.datetime(2017, 3, 5)
    rows = [
        ("a1", "A", jan), ("a2", "A", dt.datetime(2017, 1, 25)),  # two orders in month 0: counted once
        ("b1", "B", jan), ("b2", "B", mar),  # returns in month 2 only
        ("c1", "C", feb),  # cohort nobody returns to
    ]
    t = mk(
        orders=[order(o, o, ts=ts) for o, _, ts in rows],
        customers=[{"customer_id": o, "customer_unique_id": p} for o, p, _ in rows],
    )
    matrix = {r["cohort_month"]: r for r in plans.retention_matrix(t, "2017-01-01").collect()}
    jan_row = matrix[dt.date(2017, 1, 1)]
    assert jan_row["cohort_size"] == 2
    assert jan_row["month_1_pct"] == D("0.00") and jan_row["month_2_pct"] == D("50.00")
    feb_row = matrix[dt.date(2017, 2, 1)]
    assert feb_row["cohort_size"] == 1 and feb_row["month_1_pct"] == D("0.00")
    long = {(r["cohort_month"], r["month_index"]): r["retention_pct"] for r in plans.retention_long(t, "2017-01-01").collect()}
    assert long[(dt.date(2017, 1, 1), 0)] == D("100.00")
    assert (dt.date(2017, 1, 1), 1) not in long
    heat = {r["cohort"]: r for r in plans.retention_heatmap(t, "2017-01-01").collect()}
    assert heat["2017-01"]["month_1"] is None and heat["2017-01"]["month_2"] == D("50.00")
    assert heat["2017-02"]["month_1"] is None
    sizes = {r["cohort_month"]: r["new_customers_in_cohort"] for r in plans.new_customers_by_cohort(t).collect()}
    assert sizes == {dt.date(2017, 1, 1): 2, dt.date(2017, 2, 1): 1}


def test_late_and_missing_estimate(mk):
    ts = dt.datetime(2018, 3, 1)
    t = mk(
        orders=[
            order("o1", "c1", ts=ts, delivered=ts + dt.timedelta(days=5), estimated=ts + dt.timedelta(days=5)),  # on time to the second
            order("o2", "c2", ts=ts, delivered=ts + dt.timedelta(days=8), estimated=None),  # no estimate
        ],
        order_reviews=[{"review_id": "r1", "order_id": "o1", "review_score": 5}, {"review_id": "r2", "order_id": "o2", "review_score": 1}],
    )
    by_score = {r["review_score"]: r for r in plans.delivery_by_score(t).collect()}
    assert set(by_score) == {5}  # the order without an estimate is absent
    assert by_score[5]["pct_delivered_late"] == D("0.0") and by_score[5]["avg_days_vs_estimate"] == D("0.0")
    simple = {r["review_score"]: r for r in plans.delivery_by_score_simple(t).collect()}
    assert simple[1]["pct_delivered_late"] == D("0.0")  # no estimate: not late
    assert simple[1]["avg_delivery_days"] == D("8.0")
    status = {(r["delivery_band"], r["estimate_status"]) for r in plans.negative_rate_speed_x_late(t).collect()}
    assert status == {("Under 7 days", "On time or early"), ("7-13 days", "Late")}  # no estimate falls to Late
    matrix = plans.negative_rate_matrix(t).collect()
    assert [r["delivery_band"] for r in matrix] == ["Under 7 days", "7-13 days", "14-20 days", "21-29 days", "30+ days"]
    assert matrix[2]["late"] is None and matrix[1]["late"] == D("100.0")


def test_fanout_semantics(mk):
    t = mk(
        orders=[order("o1", "c1"), order("o2", "c2")],
        order_items=[item("o1", 1, seller="s1"), item("o1", 2, seller="s1"), item("o2", 1, seller="s1")],
        order_reviews=[
            {"review_id": "r1", "order_id": "o1", "review_score": 1},
            {"review_id": "r2", "order_id": "o1", "review_score": 5},
            {"review_id": "r1", "order_id": "o2", "review_score": 2},  # repeated review id
        ],
        sellers=[{"seller_id": "s1", "seller_state": "SP"}],
    )
    worst = plans.worst_sellers(t, min_reviews=1).collect()
    assert len(worst) == 1
    w = worst[0]
    # rows: o1 has 2 items x 2 reviews = 4 rows (scores 1,1,5,5), o2 1 x 1 (score 2)
    assert (w["total_orders"], w["total_reviews"]) == (2, 2)
    assert w["avg_review_score"] == D("2.80")  # (1+1+5+5+2)/5
    assert w["pct_negative_reviews"] == D("60.0")
    tiers = plans.seller_quality_tiers(t, min_orders=2).collect()
    assert [(r["quality_tier"], r["seller_count"], r["total_orders"]) for r in tiers] == [("5. Very Poor (<3.0)", 1, 2)]
    # revenue counted per review row: o1 (22.00) x 2 reviews + o2 11.00
    assert tiers[0]["total_revenue"] == D("55")
    assert plans.seller_quality_tiers(t, min_orders=3).count() == 0  # HAVING >= is inclusive at the edge only


def test_category_fallbacks(mk):
    t = mk(
        orders=[order(f"o{i}", f"c{i}") for i in range(3)],
        order_items=[item("o0", 1, product="p_tr"), item("o1", 1, product="p_raw"), item("o2", 1, product="p_null")],
        order_reviews=[{"review_id": f"r{i}", "order_id": f"o{i}", "review_score": 1 + i} for i in range(3)],
        products=[
            {"product_id": "p_tr", "product_category_name": "beleza"},
            {"product_id": "p_raw", "product_category_name": "sem_traducao"},
            {"product_id": "p_null", "product_category_name": None},
        ],
        product_category_translation=[{"product_category_name": "beleza", "product_category_name_english": "beauty"}],
    )
    got = {r["category"]: r["orders"] for r in plans.category_satisfaction(t, min_orders=1).collect()}
    assert got == {"beauty": 1, "sem_traducao": 1, "unknown": 1}


def test_shares_and_empty_nulls(mk):
    t = mk(orders=[order("o1", "c1", status="a"), order("o2", "c2", status="b"), order("o3", "c3", status="c")])
    shares = [r["pct_of_total"] for r in plans.status_distribution(t).collect()]
    assert shares == [D("33.33")] * 3
    t1 = mk(orders=[order("o1", "c1")])
    assert plans.status_distribution(t1).first()["pct_of_total"] == D("100.00")
    empty = mk(orders=[])
    row = plans.order_null_counts(empty).first()
    assert row["null_customer_id"] is None and row["null_purchase_time"] is None
    assert plans.duplicate_orders(mk(orders=[order("o1", "c1"), order("o1", "c1")])).first()["dup_count"] == 2


def test_segment_summaries_partition_customers(fixture_tables):
    from mercata.sources.testdata import FIXTURE_ANCHOR

    raw_n = E.rfm_raw(fixture_tables, FIXTURE_ANCHOR).count()
    for summary in (plans.rfm_segment_summary, plans.two_tier_segment_summary):
        rows = summary(fixture_tables, FIXTURE_ANCHOR).collect()
        assert sum(r["customers"] for r in rows) == raw_n
        assert abs(sum(r["pct_customers"] for r in rows) - 100) <= D("0.01") * len(rows)
    revenue = [
        sum(r["total_revenue"] for r in f(fixture_tables, FIXTURE_ANCHOR).collect())
        for f in (plans.rfm_segment_summary, plans.two_tier_segment_summary, plans.two_tier_segment_revenue)
    ]
    assert revenue[0] == revenue[1] == revenue[2]


def test_repartitioning_input_changes_nothing(fixture_tables):
    from mercata.sources.testdata import FIXTURE_ANCHOR

    shuffled = {k: v.repartition(7) for k, v in fixture_tables.items()}
    a = sorted(map(tuple, plans.rfm_segments(fixture_tables, FIXTURE_ANCHOR, k=None).collect()))
    b = sorted(map(tuple, plans.rfm_segments(shuffled, FIXTURE_ANCHOR, k=None, bins=3).collect()))
    assert a == b


def test_run_all_writes_every_report(spark, fixture_tables, tmp_path):
    from mercata.plans.pipeline import report_builders, run_all
    from mercata.sources.testdata import FIXTURE_ANCHOR, FIXTURE_FROM_COHORT, FIXTURE_REVENUE_RANGE, FIXTURE_SAMPLE_COHORT

    out = str(tmp_path / "reports")
    reports = run_all(
        fixture_tables, out, anchor=FIXTURE_ANCHOR, from_cohort=FIXTURE_FROM_COHORT,
        sample_cohort=FIXTURE_SAMPLE_COHORT, revenue_range=FIXTURE_REVENUE_RANGE,
    )
    assert set(reports) == set(report_builders())
    back = spark.read.parquet(str(tmp_path / "reports" / "two_tier_segment_summary"))
    assert back.count() == reports["two_tier_segment_summary"].count()


def test_tier_panel_filter(fixture_tables):
    from mercata.plans.rules import TIER2_LABEL
    from mercata.sources.testdata import FIXTURE_ANCHOR

    rows = plans.two_tier_segment_revenue(fixture_tables, FIXTURE_ANCHOR, tier=TIER2_LABEL).collect()
    assert rows and all(r["tier"] == TIER2_LABEL for r in rows)


def test_retention_forms_agree(fixture_tables):
    from mercata.sources.testdata import FIXTURE_FROM_COHORT

    long = plans.retention_long(fixture_tables, FIXTURE_FROM_COHORT).collect()
    cells = {(r["cohort_month"], r["month_index"]): r["retention_pct"] for r in long}
    assert all(v == D("100.00") for (c, m), v in cells.items() if m == 0)
    matrix = plans.retention_matrix(fixture_tables, FIXTURE_FROM_COHORT).collect()
    assert {r["cohort_month"] for r in matrix} == {c for c, _ in cells}
    for r in matrix:
        for m in range(1, 7):
            assert r[f"month_{m}_pct"] == cells.get((r["cohort_month"], m), D("0.00"))
    heat = {r["cohort"]: r for r in plans.retention_heatmap(fixture_tables, FIXTURE_FROM_COHORT).collect()}
    for r in matrix:
        row = heat[r["cohort_month"].strftime("%Y-%m")]
        for m in range(1, 7):
            assert row[f"month_{m}"] == cells.get((r["cohort_month"], m))


def test_run_all_shared_scoring_equals_direct_reports(fixture_tables, tmp_path):
    from mercata.plans.pipeline import run_all
    from mercata.sources.testdata import FIXTURE_ANCHOR, FIXTURE_FROM_COHORT, FIXTURE_REVENUE_RANGE, FIXTURE_SAMPLE_COHORT

    reports = run_all(
        fixture_tables, str(tmp_path), anchor=FIXTURE_ANCHOR, from_cohort=FIXTURE_FROM_COHORT,
        sample_cohort=FIXTURE_SAMPLE_COHORT, revenue_range=FIXTURE_REVENUE_RANGE,
    )
    for name, direct in (
        ("rfm_segments", lambda: plans.rfm_segments(fixture_tables, FIXTURE_ANCHOR)),
        ("rfm_segment_summary", lambda: plans.rfm_segment_summary(fixture_tables, FIXTURE_ANCHOR)),
        ("two_tier_segment_summary", lambda: plans.two_tier_segment_summary(fixture_tables, FIXTURE_ANCHOR)),
        ("two_tier_segment_revenue", lambda: plans.two_tier_segment_revenue(fixture_tables, FIXTURE_ANCHOR)),
    ):
        assert sorted(map(tuple, reports[name].collect())) == sorted(map(tuple, direct().collect())), name


def test_month_over_month_edges(mk):
    rows = [("o1", dt.datetime(2018, 1, 5), "10.00"), ("o2", dt.datetime(2018, 2, 5), "0.00"),
            ("o3", dt.datetime(2018, 3, 5), "5.00"), ("o4", dt.datetime(2018, 4, 5), "7.50")]
    t = mk(
        orders=[order(o, o, ts=ts) for o, ts, _ in rows],
        order_items=[item(o, 1, price, "0.00") for o, _, price in rows],
    )
    got = [(r["month"].month, r["prev_revenue"], r["revenue_change_pct"])
           for r in plans.monthly_revenue(t, "2018-01-01", "2018-05-01", month_over_month=True).collect()]
    assert got == [
        (1, None, None),                  # no previous month
        (2, D("10.00"), D("-100.00")),
        (3, D("0.00"), None),             # change against zero: NULL, not an error
        (4, D("5.00"), D("50.00")),
    ]
    totals = plans.revenue_totals(t, "2018-01-01", "2018-05-01").first()
    assert (totals["total_revenue"], totals["total_orders"]) == (D("22.50"), 4)


def test_key_and_domain_reports_find_violations(mk):
    t = mk(
        orders=[order("o1", "c1"), order("o1", "c1"), order("o2", "c_missing"), order("o3", None)],
        customers=[{"customer_id": "c1", "customer_unique_id": "p1", "customer_state": "SPX"}],
        order_items=[item("o1", 1), item("o_missing", 1), item("o2", 1, seller="s_missing", product="p_missing")],
        sellers=[{"seller_id": "s1", "seller_state": "SP"}],
        products=[{"product_id": "p1", "product_category_name": "x"}],
        order_reviews=[{"review_id": "r1", "order_id": "o_gone", "review_score": 9}, {"review_id": "r2", "order_id": "o1", "review_score": None}],
    )
    keys = {(r["check"], r["table_name"], r["columns"]): r["violations"] for r in plans.key_report(t).collect()}
    assert keys[("duplicate primary key", "orders", "order_id")] == 1
    assert keys[("orphan of customers", "orders", "customer_id")] == 1  # NULL customer_id is not an orphan
    assert keys[("orphan of orders", "order_items", "order_id")] == 1
    assert keys[("orphan of sellers", "order_items", "seller_id")] == 1
    assert keys[("orphan of products", "order_items", "product_id")] == 1
    assert keys[("orphan of orders", "order_reviews", "order_id")] == 1
    domain = {(r["table_name"], r["rule"]): r["violations"] for r in plans.domain_report(t).collect()}
    assert domain[("customers", "length(customer_state) = 2")] == 1
    assert domain[("sellers", "length(seller_state) = 2")] == 0
    assert domain[("order_reviews", "review_score between 1 and 5")] == 1  # NULL score passes
    cov = plans.order_coverage(t).first()
    assert (cov["total_orders"], cov["unique_customers"]) == (4, 2)


def test_having_edges_null_scores_and_window(mk):
    ts = dt.datetime(2018, 5, 1)
    orders_, reviews = [], []
    for i in range(4):  # four reviews in one speed/accuracy cell, one with a NULL score
        oid = f"o{i}"
        orders_.append(order(oid, oid, ts=ts, delivered=ts + dt.timedelta(days=2), estimated=ts + dt.timedelta(days=10)))
        reviews.append({"review_id": f"r{i}", "order_id": oid, "review_score": None if i == 0 else 5})
    orders_.append(order("o_late", "c", status="shipped", ts=dt.datetime(2019, 1, 1)))
    t = mk(orders=orders_, order_reviews=reviews)
    assert plans.speed_x_accuracy(t, min_orders=4).count() == 1  # exactly at the threshold: kept
    assert plans.speed_x_accuracy(t, min_orders=5).count() == 0
    row = plans.speed_x_accuracy(t, min_orders=4).first()
    assert row["avg_review_score"] == D("5.00")  # NULL score left out of the average
    assert row["pct_negative_reviews"] == D("0.0")  # but counted in the denominator rows
    dist = plans.review_distribution(t).collect()
    assert dist[0]["review_score"] is None  # descending order puts NULL first
    window = plans.analysis_window(t).first()
    assert window["analysis_anchor_date"] == dt.date(2018, 5, 1) and window["total_delivered_orders"] == 4


def test_average_days_round_half_away_from_zero(mk):
    ts = dt.datetime(2018, 6, 1)
    t = mk(
        orders=[order("o1", "c1", ts=ts, delivered=ts + dt.timedelta(hours=6), estimated=ts + dt.timedelta(hours=12))],
        order_reviews=[{"review_id": "r1", "order_id": "o1", "review_score": 4}],
    )
    row = plans.delivery_by_score(t).first()
    assert row["avg_delivery_days"] == D("0.3")  # 0.25 days; banker's rounding would give 0.2
    assert row["avg_days_vs_estimate"] == D("-0.3")  # -0.25 days


def test_cohort_activity_sample_order_and_limit(mk):
    rows = [("a1", "B", dt.datetime(2017, 1, 3)), ("a2", "B", dt.datetime(2017, 3, 3)), ("a3", "B", dt.datetime(2017, 3, 20)),
            ("b1", "A", dt.datetime(2017, 1, 9)), ("c1", "C", dt.datetime(2017, 2, 1))]
    t = mk(
        orders=[order(o, o, ts=ts) for o, _, ts in rows],
        customers=[{"customer_id": o, "customer_unique_id": p} for o, p, _ in rows],
    )
    got = [(r["customer_unique_id"], r["month_index"]) for r in plans.cohort_activity_sample(t, "2017-01-01", k=3).collect()]
    assert got == [("A", 0), ("B", 0), ("B", 2)]  # person, then month index; cohort C (Feb) excluded
