"""Orders and items stored by purchase month.

A report over a date range reads only that range's folders, of the orders and
of the items too: an item has no purchase date of its own, so it is stored
under its order's month.  Within a month, orders lie in ranges of their
purchase time and items in ranges of their order, so that a filter on days
skips row groups, and a month of any size is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.functions.dates import MONTH, month_start
from mercata.sources.versions import write_version


def by_month(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, orders and items with ``MONTH`` and clustered by it.  Orders
    without a purchase time, and items without an order, have a NULL month."""
    orders = tables["orders"].withColumn(MONTH, month_start("order_purchase_timestamp"))
    out = {**tables, "orders": _clustered(orders, "order_purchase_timestamp", "order_id")}
    if "order_items" in tables:
        months = orders.select("order_id", MONTH)
        out["order_items"] = _clustered(tables["order_items"].join(months, "order_id", "left"), "order_id", "order_item_id")
    return out


def _clustered(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange(MONTH, *keys).sortWithinPartitions(MONTH, *keys)


def write_dated_tables(tables: dict[str, DataFrame], directory: str) -> str:
    """Stores the tables as a new version under ``directory`` (read back with
    ``load_marketplace_parquet``), orders and items in a folder a month."""
    return write_version(by_month(tables), directory, partition_by={"orders": [MONTH], "order_items": [MONTH]})
