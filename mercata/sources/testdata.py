"""Marketplace tables derived from the driver's TPC-H-style test tables.

The test data has orders, line items, customers, suppliers, parts and nations
but no reviews, payments, places, delivery dates or per-order customer ids.
The views below
relabel the real columns and derive the missing ones by arithmetic on keys,
so they are deterministic and identical in every engine (the DuckDB oracle
builds the same views in ``oracle_sql.py``).  Derived values exercise the
operators; they say nothing about any business.

Every view is a lazy projection/join of the Parquet scans, so filters and
column pruning of a report still reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.functions.sql import values_table
from mercata.schemas import SCHEMAS
from mercata.sources.files import child, conform

# Category translations of the fixture (PROMO deliberately
# has no translation, so all three COALESCE arms of the category report fire).
FIXTURE_TRANSLATIONS = [
    ("ECONOMY", "economy"),
    ("SMALL", "small"),
    ("LARGE", "large"),
    ("STANDARD", "standard"),
    ("MEDIUM", "medium"),
]

# Parameters that fit the fixture's calendar (1995-2001).
FIXTURE_ANCHOR = "2001-08-02"
FIXTURE_FROM_COHORT = "1995-02-01"
FIXTURE_SAMPLE_COHORT = "1995-03-01"
FIXTURE_REVENUE_RANGE = ("1996-01-01", "2001-01-01")
# Seller averages of the fixture lie between 2.84 and 3.28, so these cut
# points (with neutral labels) put sellers into all five tiers.
FIXTURE_SELLER_CUTS = ("3.15", "3.08", "3.00", "2.92")
FIXTURE_SELLER_LABELS = ("1. 3.15+", "2. 3.08-3.14", "3. 3.00-3.07", "4. 2.92-2.99", "5. below 2.92")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(child(sf_dir, f"{name}.parquet"))


def _conform(df: DataFrame, table: str) -> DataFrame:
    # Keys keep the test data's bigint type: ids are opaque to every report,
    # and numeric keys hash and compare faster than their decimal strings.
    return conform(df, SCHEMAS[table], cast_present=False)


def marketplace_from_testdata(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine marketplace tables, derived from the test data."""
    orders_raw = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    customer = _read(spark, sf_dir, "customer")
    supplier = _read(spark, sf_dir, "supplier")
    part = _read(spark, sf_dir, "part")
    nation = _read(spark, sf_dir, "nation")

    key = F.col("o_orderkey")
    purchase = F.col("o_orderdate")
    delivered = F.when(
        (F.col("o_orderstatus") == "F") & (key % 97 != 0),
        purchase + F.make_dt_interval(F.lit(0), ((key * 7919) % 1080 + 24).cast("int")),
    )
    estimated = F.when(
        key % 89 != 0,
        purchase + F.make_dt_interval((14 + (key * 31) % 21).cast("int")),
    )
    orders_keyed = orders_raw.select(
        key.alias("order_key"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .otherwise("canceled")
        .alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        delivered.alias("order_delivered_customer_date"),
        estimated.alias("order_estimated_delivery_date"),
    )
    orders = _conform(orders_keyed, "orders")

    customers = _conform(
        orders_raw.join(customer, orders_raw.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("o_orderkey").alias("customer_id"),
            F.col("o_custkey").alias("customer_unique_id"),
            F.col("n_name").alias("customer_state"),
        ),
        "customers",
    )

    order_items = _conform(
        lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
            F.col("l_quantity").cast("decimal(10,2)").alias("freight_value"),
        ),
        "order_items",
    )

    sellers = _conform(
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
            F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state")
        ),
        "sellers",
    )

    products = _conform(
        part.select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_partkey") % 29 != 0, F.col("p_type")).alias("product_category_name"),
        ),
        "products",
    )

    translation = values_table(spark, FIXTURE_TRANSLATIONS, ["product_category_name", "product_category_name_english"])

    # One payment per order; every seventh order is paid in two parts.
    part_no = F.explode(F.when(key % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    payments = _conform(
        orders_raw.select(key.alias("order_id"), part_no.alias("payment_sequential")).withColumn(
            "payment_value", ((F.col("order_id") % 100_000 + F.col("payment_sequential")) / 100).cast("decimal(10,2)")
        ),
        "order_payments",
    )
    # One place per customer.
    geolocation = _conform(
        customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
            F.col("c_custkey").alias("geolocation_zip_code_prefix"),
            (F.col("c_custkey") % 90).cast("decimal(10,7)").alias("geolocation_lat"),
            (-F.col("c_custkey") % 180).cast("decimal(10,7)").alias("geolocation_lng"),
            F.col("n_name").alias("geolocation_state"),
        ),
        "geolocation",
    )

    # One review per order except every tenth order; orders with key % 50 = 1
    # get a second review (fan-out).  Late deliveries score 1-3, others 3-5.
    ok = F.col("order_key")
    late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    first = orders_keyed.filter(ok % 10 != 0).withColumn("k", F.lit(0))
    second = orders_keyed.filter(ok % 50 == 1).withColumn("k", F.lit(1))
    reviews = _conform(
        first.unionByName(second).select(
            (ok * 10 + F.col("k")).alias("review_id"),
            F.col("order_id"),
            F.when(late, 1 + (ok * 13 + F.col("k")) % 3)
            .otherwise(3 + (ok * 13 + F.col("k")) % 3)
            .cast("int")
            .alias("review_score"),
        ),
        "order_reviews",
    )

    return {
        "customers": customers,
        "orders": orders,
        "order_items": order_items,
        "sellers": sellers,
        "products": products,
        "product_category_translation": translation,
        "order_payments": payments,
        "geolocation": geolocation,
        "order_reviews": reviews,
    }
