"""Command line: load the marketplace tables and run every report.

    python -m mercata --csv data/raw --out reports
    python -m mercata --parquet tables --out reports --format csv
    python -m mercata --csv data/raw --load-parquet tables      # CSV -> Parquet once
    python -m mercata --csv data/raw --load-parquet tables --buckets 512 --database mkt
    python -m mercata --catalog mkt --out reports               # bucketed catalog tables
    python -m mercata --csv data/raw --show two_tier_segment_summary

Uses the active Spark session (``spark-submit``) or a local one.
"""

from __future__ import annotations

import argparse

from mercata.plans.pipeline import report_builders, run_all
from mercata.plans.rules import DEFAULT_ANCHOR, DEFAULT_FROM_COHORT, DEFAULT_REVENUE_RANGE, DEFAULT_SAMPLE_COHORT
from mercata.session import get_session
from mercata.sources import (
    load_catalog_tables,
    load_marketplace_csv,
    load_marketplace_parquet,
    write_bucketed_tables,
    write_tables,
)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mercata", description=__doc__.splitlines()[0])
    src = parser.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="folder with the nine source CSV files")
    src.add_argument("--parquet", help="folder with <table>/ Parquet datasets")
    src.add_argument("--catalog", metavar="DATABASE", help="read the tables of this catalog database")
    parser.add_argument("--load-parquet", help="write the loaded tables as Parquet here (overwrite)")
    parser.add_argument("--buckets", type=int, help="with --load-parquet: save catalog tables, order-keyed ones bucketed by order_id")
    parser.add_argument("--database", default="marketplace", help="catalog database for --buckets")
    parser.add_argument("--out", help="write every report under this folder")
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--show", action="append", default=[], help="print this report (repeatable)")
    parser.add_argument("--anchor", default=DEFAULT_ANCHOR, help="recency anchor date; 'latest' = last delivered purchase")
    parser.add_argument("--from-cohort", default=DEFAULT_FROM_COHORT)
    parser.add_argument("--sample-cohort", default=DEFAULT_SAMPLE_COHORT)
    parser.add_argument("--revenue-from", default=DEFAULT_REVENUE_RANGE[0])
    parser.add_argument("--revenue-to", default=DEFAULT_REVENUE_RANGE[1])
    parser.add_argument("--master", default=None, help="Spark master when no session is active")
    args = parser.parse_args(argv)

    spark = get_session(master=args.master)
    if args.csv:
        tables = load_marketplace_csv(spark, args.csv)
    elif args.parquet:
        tables = load_marketplace_parquet(spark, args.parquet)
    else:
        tables = load_catalog_tables(spark, args.catalog)
    if args.load_parquet and args.buckets:
        write_bucketed_tables(spark, tables, args.load_parquet, args.database, args.buckets)
        tables = load_catalog_tables(spark, args.database)
    elif args.load_parquet:
        write_tables(tables, args.load_parquet)
        tables = load_marketplace_parquet(spark, args.load_parquet)
    unknown = [name for name in args.show if name not in report_builders()]
    if unknown:
        parser.error(f"unknown report(s): {', '.join(unknown)}")
    anchor = None if args.anchor == "latest" else args.anchor
    options = {"from_cohort": args.from_cohort, "sample_cohort": args.sample_cohort, "revenue_range": (args.revenue_from, args.revenue_to)}
    if args.out:
        reports = run_all(tables, args.out, args.format, anchor=anchor, **options)
    else:  # only what is printed
        builders = report_builders(anchor, **options)
        reports = {name: builders[name](tables) for name in args.show}
    for name in args.show:
        print(f"== {name}")
        reports[name].show(100, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
