"""Exact rounding, month arithmetic, bands and label rules."""

import datetime as dt
import itertools
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from mercata.functions import band, exact_avg, label_by_rules, month_index, round_ratio, unscaled
from mercata.functions.arith import avg_days, split_micros
from mercata.plans.rules import (
    RFM_DEFAULT,
    RFM_RULES,
    TWO_TIER_DEFAULT,
    TWO_TIER_RULES,
)


def one(spark, expr, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_round_ratio_half_away_from_zero(spark):
    df = spark.createDataFrame(
        [(1, 8, 2, 100), (201, 20000, 2, 100), (-1, 20, 1, 1), (1, 3, 2, 100), (2, 3, 0, 1), (0, 7, 2, 100)],
        "n long, d long, k int, f int",
    )
    got = []
    for r in df.collect():
        got.append(one(spark, round_ratio(F.lit(r["n"]), F.lit(r["d"]), r["k"], r["f"])))
    # 12.5, 1.005 (exact), -0.05, 33.33.., 0.666.., 0
    assert got == [Decimal("12.50"), Decimal("1.01"), Decimal("-0.1"), Decimal("33.33"), Decimal("1"), Decimal("0.00")]


def test_decimal_rounding_cases(spark):
    # 0.125 -> 0.13, 1.005 -> 1.01, -0.05 -> -0.1 (half away from zero)
    cases = [(Decimal("0.125"), 3, 2, Decimal("0.13")), (Decimal("1.005"), 3, 2, Decimal("1.01")), (Decimal("-0.05"), 2, 1, Decimal("-0.1"))]
    for value, scale, k, want in cases:
        got = one(spark, round_ratio(unscaled(F.lit(value), scale), F.lit(10**scale), k))
        assert got == want


def test_exact_avg_money_and_empty(spark):
    df = spark.createDataFrame([(Decimal("10.00"),), (Decimal("10.01"),), (Decimal("10.00"),)], "m decimal(10,2)")
    row = df.agg(F.sum("m").alias("s"), F.count("m").alias("c")).select(exact_avg("s", "c", 2, 2).alias("a")).first()
    assert row["a"] == Decimal("10.00")  # 30.01 / 3 = 10.0033
    empty = spark.createDataFrame([], "m decimal(10,2)")
    row = empty.agg(F.sum("m").alias("s"), F.count("m").alias("c")).select(exact_avg("s", "c", 2, 2).alias("a")).first()
    assert row["a"] is None


def test_avg_days_exact_with_negative_micros(spark):
    us = [-7 * 86_400_000_000 - 1, 3 * 86_400_000_000 + 123, 5]
    df = spark.createDataFrame([(u,) for u in us], "us long")
    sec, rest = split_micros(F.col("us"))
    row = df.agg(F.sum(sec).alias("s"), F.sum(rest).alias("r"), F.count("us").alias("n")).select(
        avg_days("s", "r", "n", 1).alias("d")
    ).first()
    exact = Decimal(sum(us)) / Decimal(3 * 86_400_000_000)
    assert row["d"] == exact.quantize(Decimal("0.1"), rounding="ROUND_HALF_UP")


def test_month_index_calendar_months(spark):
    rows = [
        (dt.datetime(2017, 2, 1, 0, 0), dt.date(2017, 1, 1), 1),  # 31 Jan -> 1 Feb style: calendar months
        (dt.datetime(2018, 1, 1, 3, 0), dt.date(2017, 12, 1), 1),
        (dt.datetime(2017, 1, 31, 23, 0), dt.date(2017, 1, 1), 0),
        (dt.datetime(2019, 3, 5, 0, 0), dt.date(2017, 1, 1), 26),
    ]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, cohort date, want int")
    got = df.select(month_index("ts", "cohort").alias("m"), "want").collect()
    assert all(r["m"] == r["want"] for r in got)


def test_band_edges(spark):
    from mercata.plans.rules import ACCURACY_CUTS_DAYS, ACCURACY_LABELS, SPEED_CUTS_DAYS, SPEED_LABELS

    day = 86_400_000_000
    speed = [(d * day, label) for d, label in [(7, "2. 7-13 days"), (14, "3. 14-20 days"), (21, "4. 21-29 days"), (30, "5. 30+ days")]]
    speed.append((7 * day - 1, "1. Under 7 days"))
    df = spark.createDataFrame(speed, "us long, want string")
    col = band(SPEED_CUTS_DAYS, SPEED_LABELS, lambda c: F.col("us") < F.lit(c * day))
    assert all(r["b"] == r["want"] for r in df.select(col.alias("b"), "want").collect())
    acc = [(-7 * day, "A. Early by 7+ days"), (-3 * day, "B. Early by 3-6 days"), (0, "C. On time or 1-2 early"),
           (3 * day, "D. Late by 1-3 days"), (3 * day + 1, "E. Late by 4+ days"), (1, "D. Late by 1-3 days")]
    df = spark.createDataFrame(acc, "us long, want string")
    col = band(ACCURACY_CUTS_DAYS, ACCURACY_LABELS, lambda c: F.col("us") <= F.lit(c * day))
    assert all(r["b"] == r["want"] for r in df.select(col.alias("b"), "want").collect())


def test_rfm_rules_over_all_score_triples(spark):
    triples = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(triples, "r int, f int, m int")
    labels = [r["s"] for r in df.select(label_by_rules(RFM_RULES, RFM_DEFAULT).alias("s")).collect()]
    counts = Counter(labels)
    order = [label for label, _ in RFM_RULES] + [RFM_DEFAULT]
    assert [counts[label] for label in order] == [8, 10, 20, 27, 8, 22, 12, 4, 14]


def test_two_tier_rules(spark):
    rows = list(itertools.product(range(1, 6), range(1, 6), range(1, 6)))
    df = spark.createDataFrame(rows, "freq int, r int, m int")
    got = {(r["freq"], r["r"], r["m"]): r["s"] for r in df.select("*", label_by_rules(TWO_TIER_RULES, TWO_TIER_DEFAULT).alias("s")).collect()}
    assert got[(4, 1, 1)] == "VIP Repeat (4+ orders)"
    assert got[(5, 5, 5)] == "VIP Repeat (4+ orders)"
    assert got[(3, 1, 1)] == "Loyal Repeat (3 orders)"
    assert got[(2, 3, 1)] == "Active Repeat (2 orders, recent)"
    assert got[(2, 2, 5)] == "Lapsed Repeat (2 orders, dormant)"
    assert got[(1, 4, 4)] == "New High-Value"
    assert got[(1, 5, 3)] == "New Customer"
    assert got[(1, 2, 4)] == "Lost High-Value"
    assert got[(1, 1, 1)] == "Lost / Hibernating"
    assert got[(1, 3, 5)] == "One-Time Mid-Tier"
