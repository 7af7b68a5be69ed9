"""Month folders are pruned; the profile is one scan."""

import shutil

import pytest
from pyspark.sql import functions as F

from mercata import plans
from mercata.functions.observed import observed
from mercata.operators.quality import profile
from mercata.plans.quality import order_profile
from mercata.sources import current, load_marketplace_parquet, write_dated_tables
from mercata.sources.testdata import FIXTURE_REVENUE_RANGE

from .test_plans import _plan


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def dated(spark, fixture_tables, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("dated"))
    write_dated_tables(fixture_tables, place)
    return place, load_marketplace_parquet(spark, place)


def test_all_reports_of_dated_tables(dated, fixture_tables):
    _, t = dated
    for build in (lambda t: plans.monthly_revenue(t, *FIXTURE_REVENUE_RANGE), plans.row_counts, plans.key_report, plans.rfm_top, plans.review_distribution):
        assert rows(build(t)) == rows(build(fixture_tables))
    assert t["order_items"].where("purchase_month IS NULL").count() == fixture_tables["order_items"].join(fixture_tables["orders"], "order_id", "left_anti").count()


def test_two_months_read_their_files_only(spark, dated, fixture_tables, tmp_path):
    """Files of other months are broken, and the report does not notice."""
    place, _ = dated
    broken = tmp_path / "broken"
    shutil.copytree(place, broken)
    keep = ("purchase_month=1997-03-01", "purchase_month=1997-04-01")
    spoiled = 0
    for table in ("orders", "order_items"):
        for part in (broken / current(spark, place)[table]["folder"]).glob("purchase_month=*/*.parquet"):
            if part.parent.name not in keep:
                part.write_bytes(b"broken")
                (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
                spoiled += 1
    schemas = {name: df.schema for name, df in dated[1].items()}
    entries = current(spark, str(broken))
    t = {name: spark.read.schema(schemas[name]).parquet(f"{broken}/{entries[name]['folder']}") for name in ("orders", "order_items")}
    report = plans.monthly_revenue(t, "1997-03-01", "1997-05-01")
    assert spoiled > 50 and rows(report) == rows(plans.monthly_revenue(fixture_tables, "1997-03-01", "1997-05-01"))
    assert len(report.collect()) == 2
    assert rows(plans.monthly_revenue(t, "1997-03-10", "1997-04-02")) == rows(plans.monthly_revenue(fixture_tables, "1997-03-10", "1997-04-02"))
    plan = _plan(report).split("== Initial Plan")[0]
    assert plan.count("PartitionFilters: [isnotnull(purchase_month") == 2
    with pytest.raises(Exception):
        plans.monthly_revenue(t, "1997-03-01", "1997-06-01").collect()


def test_profile_is_one_scan_with_the_same_rows(spark, fixture_tables, tmp_path):
    stored = tmp_path / "orders"
    fixture_tables["orders"].write.parquet(str(stored))
    t = {**fixture_tables, "orders": spark.read.parquet(str(stored))}
    scans = []

    def keep(df):
        scans.append(_plan(df).count("FileScan"))
        df.write.parquet(str(tmp_path / "profile"))
        return spark.read.schema(df.schema).parquet(str(tmp_path / "profile"))

    found = order_profile(t, keep)
    shutil.rmtree(stored)  # nothing below reads the orders again
    for name, report in found.items():
        want = getattr(plans, name)(fixture_tables)
        assert rows(report) == rows(want) and report.dtypes == want.dtypes, name
    assert scans == [1]


def test_profile_counts_values_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, None), (2, "a")], "x int, y string")
    counts, seen = profile(df, ["x", "y"], {"rows": F.count(F.lit(1)), "nulls": F.count_if(F.col("y").isNull())})
    got = {(r["column"], r.x, r.y): r.n for r in counts.collect()}
    assert got == {("x", 1, None): 2, ("x", 2, None): 1, ("x", None, None): 1, ("y", None, "a"): 2, ("y", None, None): 2}
    assert seen.get == {"rows": 4, "nulls": 2}
    counts, seen = profile(df.limit(0), ["x"], {"rows": F.count(F.lit(1)), "least": F.min("x")})
    assert counts.collect() == [] and observed(seen) in (None, {"rows": 0, "least": None})


def test_profile_of_no_orders(spark, fixture_tables, tmp_path):
    none = {**fixture_tables, "orders": fixture_tables["orders"].limit(0)}

    def keep(df):
        df.write.parquet(str(tmp_path / "profile"))
        return spark.read.schema(df.schema).parquet(str(tmp_path / "profile"))

    for name, report in order_profile(none, keep).items():
        assert rows(report) == rows(getattr(plans, name)(none)), name
