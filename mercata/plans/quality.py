"""Load audit and data-quality reports (0.1, 1.1-1.5) plus the key and
domain checks the source schema declares."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.functions.observed import observed
from mercata.operators.shares import share_of_total
from mercata.operators.quality import (
    coverage,
    distribution,
    duplicate_keys,
    key_audit,
    null_counts,
    profile,
    row_counts as _row_counts,
    unmatched,
    unmatched_count,
    violations,
)
from mercata.plans.entities import Tables
from mercata.plans.rules import ROW_COUNT_LABELS
from mercata.schemas import FOREIGN_KEYS, PRIMARY_KEYS, STATE_COLUMNS


def row_counts(t: Tables) -> DataFrame:
    """0.1 ``table_name, row_count`` of every loaded table, largest first."""
    return _row_counts(t, ROW_COUNT_LABELS)


def order_coverage(t: Tables) -> DataFrame:
    """1.1 date window, order count and distinct ``customer_id`` (per-order
    ids, as in the source), all statuses."""
    return coverage(t["orders"], "order_purchase_timestamp", "customer_id")


def status_distribution(t: Tables) -> DataFrame:
    """1.2 orders per status with share of all orders."""
    return distribution(t["orders"], "order_status", "order_count", "pct_of_total").orderBy(
        F.col("order_count").desc(), "order_status"
    )


def order_null_counts(t: Tables) -> DataFrame:
    """1.3 NULLs in the order columns the analysis depends on."""
    return null_counts(t["orders"], ORDER_NULLS)


def duplicate_orders(t: Tables) -> DataFrame:
    """1.4 repeated order ids (expected: none)."""
    return duplicate_keys(t["orders"], ["order_id"])


def orders_without_items(t: Tables) -> DataFrame:
    """1.5 orders (any status) that have no item, via a left anti join."""
    return unmatched_count(t["orders"], t["order_items"], ["order_id"], "orders_without_items")


ORDER_NULLS = {
    "customer_id": "null_customer_id",
    "order_purchase_timestamp": "null_purchase_time",
    "order_delivered_customer_date": "null_delivered_date",
    "order_estimated_delivery_date": "null_estimated_delivery",
}


def order_profile(t: Tables, keep: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """1.1 to 1.4 by report name from one scan of the orders.  ``keep`` writes
    a DataFrame (the counts of all order ids, customers and statuses) and
    returns it read back."""
    ts = F.col("order_purchase_timestamp")
    measures = {"earliest_order": F.min(ts), "latest_order": F.max(ts), "total_orders": F.count(F.lit(1))}
    measures |= {out: F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)) for c, out in ORDER_NULLS.items()}
    counts, seen = profile(t["orders"], ["order_id", "customer_id", "order_status"], measures)
    counts = keep(counts)
    types = {f.name: f.dataType.simpleString() for f in t["orders"].agg(*[c.alias(n) for n, c in measures.items()]).schema.fields}
    values = observed(seen) or {"total_orders": 0}
    measured = counts.sparkSession.createDataFrame([tuple(values.get(n) for n in measures)], ", ".join(f"{n} {types[n]}" for n in measures))
    of = lambda column: counts.where(F.col("column") == column)
    customers = of("customer_id").agg(F.count("customer_id").alias("unique_customers"))
    return {
        "order_coverage": measured.select("earliest_order", "latest_order", "total_orders", customers.scalar().alias("unique_customers")),
        "status_distribution": share_of_total(of("order_status").select("order_status", F.col("n").alias("order_count")), "order_count", "pct_of_total").orderBy(
            F.col("order_count").desc(), "order_status"
        ),
        "order_null_counts": measured.select(*ORDER_NULLS.values()),
        "duplicate_orders": of("order_id").where("n > 1").select("order_id", F.col("n").alias("dup_count")),
    }


def duplicate_primary_keys(t: Tables, table: str) -> DataFrame:
    """Key values of ``table`` that break its declared primary key."""
    return duplicate_keys(t[table], list(PRIMARY_KEYS[table]))


def orphan_rows(t: Tables, child: str, columns: tuple[str, ...], parent: str, parent_columns: tuple[str, ...]) -> DataFrame:
    """Rows of ``child`` whose foreign key has no parent row.  NULL keys are
    not orphans (a NULL foreign key is allowed)."""
    c = t[child]
    for col in columns:
        c = c.filter(F.col(col).isNotNull())
    return unmatched(c, t[parent], dict(zip(columns, parent_columns)))


def key_report(t: Tables) -> DataFrame:
    """Every declared key of the loaded tables: ``check, table_name,
    columns, violations`` (key values that repeat, rows with a NULL in the
    primary key, rows whose foreign key has no parent).  One audit for each
    key, of its table and the tables that refer to it."""
    referred = {(parent, columns) for _, _, parent, columns in FOREIGN_KEYS}
    keys = dict.fromkeys([*PRIMARY_KEYS.items(), *sorted(referred)])
    parts = []
    for table, columns in keys:
        if table not in t:
            continue
        uses = [(child, cols) for child, cols, parent, pcols in FOREIGN_KEYS if (parent, pcols) == (table, columns) and child in t]
        found = key_audit(t[table], columns, [(t[child], cols) for child, cols in uses])
        lines = []
        if PRIMARY_KEYS.get(table) == columns:
            lines += [("duplicate primary key", table, columns, "duplicates"), ("null in primary key", table, columns, "nulls")]
        lines += [(f"orphan of {table}", child, cols, f"orphans_{i}") for i, (child, cols) in enumerate(uses)]
        structs = [
            F.struct(F.lit(check).alias("check"), F.lit(name).alias("table_name"), F.lit(",".join(cols)).alias("columns"), F.col(count).alias("violations"))
            for check, name, cols, count in lines
        ]
        parts.append(found.select(F.inline(F.array(*structs))))
    return reduce(DataFrame.unionByName, parts)


def domain_report(t: Tables) -> DataFrame:
    """Domain rules of the source schema: two-letter state codes and review
    scores of 1-5 stars.  ``table_name, rule, violations``; NULLs pass, as a
    CHAR(2)/INTEGER column accepts them."""
    checks = []
    for table, col in STATE_COLUMNS.items():
        if table in t:
            rule = F.col(col).isNull() | (F.length(col) == 2)
            checks.append((table, f"length({col}) = 2", t[table], rule))
    if "order_reviews" in t:
        score = F.col("review_score")
        checks.append(("order_reviews", "review_score between 1 and 5", t["order_reviews"], score.isNull() | score.between(1, 5)))
    parts = [
        violations(df, rule).agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(table).alias("table_name"), F.lit(name).alias("rule"), "violations"
        )
        for table, name, df, rule in checks
    ]
    return reduce(DataFrame.unionByName, parts)
