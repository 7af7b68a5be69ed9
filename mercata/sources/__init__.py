"""Sources and sinks: typed CSV ingest, Parquet tables, report export and the
mapping of the driver's TPC-H-style test tables onto the marketplace schema."""

from mercata.sources.dated import by_month, write_dated_tables
from mercata.sources.files import (
    conform,
    load_catalog_tables,
    load_csv,
    load_marketplace_csv,
    load_marketplace_parquet,
    register_views,
    write_bucketed_tables,
    write_report,
    write_tables,
)
from mercata.sources.testdata import marketplace_from_testdata
from mercata.sources.versions import current, manifests, read_version, superseded, write_version

__all__ = [
    "by_month",
    "conform",
    "current",
    "load_catalog_tables",
    "load_csv",
    "load_marketplace_csv",
    "load_marketplace_parquet",
    "manifests",
    "marketplace_from_testdata",
    "read_version",
    "register_views",
    "superseded",
    "write_bucketed_tables",
    "write_dated_tables",
    "write_report",
    "write_tables",
    "write_version",
]
