"""Typed schemas of the nine marketplace tables, with their declared keys.

Spark does not enforce keys; they are kept as data so the quality operators
(:mod:`mercata.operators.quality`) can check them.  Column names keep the
source spelling, including ``product_name_lenght``.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
TS = T.TimestampNTZType()
I = T.IntegerType()
MONEY = T.DecimalType(10, 2)
COORD = T.DecimalType(10, 7)


# Column names, order and types of the source schema.
def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


CUSTOMERS = _struct(
    ("customer_id", S),
    ("customer_unique_id", S),
    ("customer_zip_code_prefix", S),
    ("customer_city", S),
    ("customer_state", S),
)

ORDERS = _struct(
    ("order_id", S),
    ("customer_id", S),
    ("order_status", S),
    ("order_purchase_timestamp", TS),
    ("order_approved_at", TS),
    ("order_delivered_carrier_date", TS),
    ("order_delivered_customer_date", TS),
    ("order_estimated_delivery_date", TS),
)

SELLERS = _struct(
    ("seller_id", S),
    ("seller_zip_code_prefix", S),
    ("seller_city", S),
    ("seller_state", S),
)

PRODUCTS = _struct(
    ("product_id", S),
    ("product_category_name", S),
    ("product_name_lenght", I),
    ("product_description_lenght", I),
    ("product_photos_qty", I),
    ("product_weight_g", I),
    ("product_length_cm", I),
    ("product_height_cm", I),
    ("product_width_cm", I),
)

ORDER_ITEMS = _struct(
    ("order_id", S),
    ("order_item_id", I),
    ("product_id", S),
    ("seller_id", S),
    ("shipping_limit_date", TS),
    ("price", MONEY),
    ("freight_value", MONEY),
)

ORDER_PAYMENTS = _struct(
    ("order_id", S),
    ("payment_sequential", I),
    ("payment_type", S),
    ("payment_installments", I),
    ("payment_value", MONEY),
)

ORDER_REVIEWS = _struct(
    ("review_id", S),
    ("order_id", S),
    ("review_score", I),
    ("review_comment_title", S),
    ("review_comment_message", S),
    ("review_creation_date", TS),
    ("review_answer_timestamp", TS),
)

GEOLOCATION = _struct(
    ("geolocation_zip_code_prefix", S),
    ("geolocation_lat", COORD),
    ("geolocation_lng", COORD),
    ("geolocation_city", S),
    ("geolocation_state", S),
)

CATEGORY_TRANSLATION = _struct(
    ("product_category_name", S),
    ("product_category_name_english", S),
)

SCHEMAS: dict[str, T.StructType] = {
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "sellers": SELLERS,
    "products": PRODUCTS,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
    "geolocation": GEOLOCATION,
    "product_category_translation": CATEGORY_TRANSLATION,
}

# Declared primary keys (order_reviews and geolocation have none).
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "orders": ("order_id",),
    "sellers": ("seller_id",),
    "products": ("product_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "product_category_translation": ("product_category_name",),
}

# Declared foreign keys: (child table, child columns, parent table, parent columns).
FOREIGN_KEYS: tuple[tuple[str, tuple[str, ...], str, tuple[str, ...]], ...] = (
    ("orders", ("customer_id",), "customers", ("customer_id",)),
    ("order_items", ("order_id",), "orders", ("order_id",)),
    ("order_items", ("product_id",), "products", ("product_id",)),
    ("order_items", ("seller_id",), "sellers", ("seller_id",)),
    ("order_payments", ("order_id",), "orders", ("order_id",)),
    ("order_reviews", ("order_id",), "orders", ("order_id",)),
)

# Two-letter state codes (CHAR(2) in the source schema).
STATE_COLUMNS: dict[str, str] = {
    "customers": "customer_state",
    "sellers": "seller_state",
    "geolocation": "geolocation_state",
}

# File names of the public dataset's CSV export.
CSV_FILES: dict[str, str] = {
    "customers": "olist_customers_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "products": "olist_products_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_payments": "olist_order_payments_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
    "product_category_translation": "product_category_name_translation.csv",
}
