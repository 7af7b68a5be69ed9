"""Run every report in one session, sharing the expensive entities.

``run_all`` writes the derived entities that several reports rebuild (order
revenue, cohort activity, per-order review sums, items per (order, seller))
once to shared storage; the reports find them among the tables.  The
distributed RFM scoring runs once and is handed to the four segment reports.
Every report is written (the aggregated exports), then the shared files go.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from mercata.plans import cohort, quality, revenue, rfm, satisfaction
from mercata.plans import entities as E
from mercata.plans.entities import Anchor, Tables
from mercata.plans.satisfaction import items_per_order
from mercata.plans.rules import DEFAULT_ANCHOR, DEFAULT_FROM_COHORT, DEFAULT_REVENUE_RANGE, DEFAULT_SAMPLE_COHORT
from mercata.session import checkpoint_dir
from mercata.sources.files import child, remove, write_report
from mercata.sources.versions import current, write_version

#: Reports over the loaded tables themselves, without the entities.
AUDIT = frozenset({"row_counts", "key_report", "domain_report"})


def report_builders(
    anchor: Anchor = DEFAULT_ANCHOR,
    from_cohort: str = DEFAULT_FROM_COHORT,
    sample_cohort: str = DEFAULT_SAMPLE_COHORT,
    revenue_range: tuple[str, str] = DEFAULT_REVENUE_RANGE,
    scored: DataFrame | None = None,
) -> dict[str, Callable[[Tables], DataFrame]]:
    """Every report of the analysis, keyed by its export name; ``scored``
    (RFM scores r, f, m per person) is shared by the four segment reports."""
    return {
        "row_counts": quality.row_counts,
        "order_coverage": quality.order_coverage,
        "status_distribution": quality.status_distribution,
        "order_null_counts": quality.order_null_counts,
        "duplicate_orders": quality.duplicate_orders,
        "orders_without_items": quality.orders_without_items,
        "key_report": quality.key_report,
        "domain_report": quality.domain_report,
        "analysis_window": rfm.analysis_window,
        "rfm_top": lambda t: rfm.rfm_top(t, anchor),
        "rfm_segments": lambda t: rfm.rfm_segments(t, anchor, scored=scored),
        "rfm_segment_summary": lambda t: rfm.rfm_segment_summary(t, anchor, scored=scored),
        "purchase_frequency": rfm.purchase_frequency,
        "two_tier_segment_summary": lambda t: rfm.two_tier_segment_summary(t, anchor, scored=scored),
        "two_tier_segment_revenue": lambda t: rfm.two_tier_segment_revenue(t, anchor, scored=scored),
        "new_customers_by_cohort": cohort.new_customers_by_cohort,
        "cohort_activity_sample": lambda t: cohort.cohort_activity_sample(t, sample_cohort),
        "retention_long": lambda t: cohort.retention_long(t, from_cohort),
        "retention_matrix": lambda t: cohort.retention_matrix(t, from_cohort),
        "retention_heatmap": lambda t: cohort.retention_heatmap(t, from_cohort),
        "review_distribution": satisfaction.review_distribution,
        "delivery_by_score": satisfaction.delivery_by_score,
        "speed_x_accuracy": satisfaction.speed_x_accuracy,
        "worst_sellers": satisfaction.worst_sellers,
        "seller_quality_tiers": satisfaction.seller_quality_tiers,
        "category_satisfaction": satisfaction.category_satisfaction,
        "monthly_revenue": lambda t: revenue.monthly_revenue(t, *revenue_range),
        "revenue_totals": lambda t: revenue.revenue_totals(t, *revenue_range),
        "delivery_by_score_simple": satisfaction.delivery_by_score_simple,
        "negative_rate_speed_x_late": satisfaction.negative_rate_speed_x_late,
        "negative_rate_matrix": satisfaction.negative_rate_matrix,
    }


def shared_entities(t: Tables) -> dict[str, DataFrame]:
    """The sub-plans worth computing once per run, by entity name."""
    return {
        "order_revenue": E.order_revenue(t),
        "active_months": E.active_months(t),
        "order_review_stats": E.order_review_stats(t),
        "items_per_seller_id": items_per_order(t, "seller_id"),
    }


@contextmanager
def prepared(t: Tables, anchor: Anchor = DEFAULT_ANCHOR, work_dir: str | None = None) -> Iterator[tuple[Tables, DataFrame]]:
    """The tables together with the shared entities, and the RFM scores, all
    written once as Parquet under ``work_dir`` (default: a new folder in the
    session's checkpoint folder) and read back.  The folder is removed at the
    end, also after an error; nothing is cached on executors."""
    spark = next(iter(t.values())).sparkSession
    root = work_dir or checkpoint_dir(spark, create_if_unset=True)
    if root is None:
        raise ValueError("name a work_dir, or set spark.checkpoint.dir, on storage that all executors share")
    folder = child(root, f"run-{uuid.uuid4().hex}")

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(child(folder, name))
        return spark.read.schema(df.schema).parquet(child(folder, name))

    try:
        entities: dict[str, DataFrame] = {}
        for name in shared_entities(t):  # each sees those before it
            entities[f"{E.ENTITY}{name}"] = kept(name, shared_entities({**t, **entities})[name])
        ready = {**t, **entities}
        for name, report in quality.order_profile(t, lambda df: kept("order_profile", df)).items():
            ready[f"{E.ENTITY}{name}"] = report
        yield ready, kept("rfm_scored", E.rfm_scored(ready, anchor, "rfm"))
    finally:
        remove(spark, folder)


def run_all(
    t: Tables,
    out_dir: str,
    fmt: str = "parquet",
    anchor: Anchor = DEFAULT_ANCHOR,
    from_cohort: str = DEFAULT_FROM_COHORT,
    sample_cohort: str = DEFAULT_SAMPLE_COHORT,
    revenue_range: tuple[str, str] = DEFAULT_REVENUE_RANGE,
    work_dir: str | None = None,
    versioned: bool = False,
) -> dict[str, DataFrame]:
    """Write every report to ``<out_dir>/<report>`` (overwritten) and return
    the written reports.  ``versioned``: write them as a new version instead,
    which all readers of :mod:`mercata.sources.versions` see at once, and only
    when every report is there."""
    spark = next(iter(t.values())).sparkSession
    with prepared(t, anchor, work_dir) as (ready, scored):
        builders = report_builders(anchor, from_cohort, sample_cohort, revenue_range, scored)
        reports = {name: ready.get(f"{E.ENTITY}{name}") or build(ready if name not in AUDIT else t) for name, build in builders.items()}
        if versioned:
            write_version(reports, out_dir, fmt, **({"header": "true"} if fmt == "csv" else {}))
        else:
            for name, report in reports.items():
                write_report(report, child(out_dir, name), fmt)
        schemas = {name: report.schema for name, report in reports.items()}
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    entries = current(spark, out_dir) if versioned else {}
    folders = {name: entries[name]["folder"] if versioned else name for name in schemas}
    return {name: reader.schema(schema).format(fmt).load(child(out_dir, folders[name])) for name, schema in schemas.items()}
