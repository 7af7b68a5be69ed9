"""The distributed NTILE equals Spark's single-partition NTILE."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from mercata.operators.ntile import NtileSpec, SortKey, add_ntiles, asc, desc, global_ntile


def reference(df, n, keys, out):
    order = [k.sort_column() for k in keys]
    return df.withColumn(out, F.ntile(n).over(Window.orderBy(*order)))


def assert_same(got, want, id_col, out):
    g = {r[id_col]: r[out] for r in got.select(id_col, out).collect()}
    w = {r[id_col]: r[out] for r in want.select(id_col, out).collect()}
    assert g == w


@pytest.mark.parametrize("n_rows", [1, 3, 5, 7, 11, 100, 997])
@pytest.mark.parametrize("bins", [1, 3, 8])
def test_matches_window_ntile(spark, n_rows, bins):
    rng = random.Random(n_rows * 31 + bins)
    rows = [(f"id{i:05d}", rng.randint(0, 5), Decimal(rng.randint(0, 500)) / 100) for i in range(n_rows)]
    df = spark.createDataFrame(rows, "id string, freq int, money decimal(10,2)")
    keys = (desc("freq"), desc("money"), asc("id"))
    got = global_ntile(df, 5, keys, "score", bins=bins, materialise="none")
    assert_same(got, reference(df, 5, keys, "score"), "id", "score")


def test_hot_tied_key_splits_evenly(spark):
    # 97 % of the rows share the leading key: the unique tiebreak still spreads them.
    rows = [(i, 1 if i % 100 < 97 else 2 + i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, freq int")
    keys = (desc("freq"), asc("id"))
    got = global_ntile(df, 5, keys, "score", bins=8, materialise="none")
    assert_same(got, reference(df, 5, keys, "score"), "id", "score")
    sizes = [r["count"] for r in got.groupBy("score").count().orderBy("score").collect()]
    assert sizes == [600] * 5


def test_bucket_sizes_with_remainder(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    got = global_ntile(df, 5, [asc("k")], "b", bins=4, materialise="none")
    sizes = [r["count"] for r in got.groupBy("b").count().orderBy("b").collect()]
    assert sizes == [5, 5, 5, 4, 4]


def test_fewer_rows_than_buckets(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    got = global_ntile(df, 5, [desc("k")], "b", materialise="none")
    assert sorted((r["k"], r["b"]) for r in got.collect()) == [(0, 3), (1, 2), (2, 1)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "k long")
    got = global_ntile(df, 5, [asc("k")], "b", materialise="none")
    assert got.count() == 0
    assert "b" in got.columns
    for none in (df, spark.range(5).select(F.col("id").alias("k")).where("k > 9")):
        assert global_ntile(none, 5, [asc("k")], "b").collect() == []


def test_nulls_and_awkward_literals(spark):
    names = ["a'b", "c\\\\d", "plain", None, "é ü", "x\"y", "new\nline", "", "z"]
    rows = []
    for i in range(200):
        name = names[i % len(names)]
        day = None if i % 13 == 0 else dt.date(2020, 1, 1) + dt.timedelta(days=i % 17)
        rows.append((i, name, day, float(i % 7) / 3 if i % 11 else None))
    df = spark.createDataFrame(rows, "id int, name string, day date, x double")
    for keys in [
        (asc("name"), asc("id")),
        (desc("name"), desc("day"), asc("id")),
        (asc("day", nulls_first=True), desc("x", nulls_first=False), asc("id")),
        (desc("x"), asc("name"), asc("id")),
    ]:
        got = global_ntile(df, 4, keys, "q", bins=6, materialise="none")
        assert_same(got, reference(df, 4, keys, "q"), "id", "q")


def test_several_specs_and_persist(spark):
    rng = random.Random(7)
    rows = [(f"p{i}", rng.randint(0, 900), rng.randint(1, 4), Decimal(rng.randint(1, 99999)) / 100) for i in range(1500)]
    df = spark.createDataFrame(rows, "id string, recency int, freq int, money decimal(10,2)")
    specs = [
        NtileSpec(5, (asc("recency"), asc("id")), "r"),
        NtileSpec(5, (desc("freq"), desc("money"), asc("id")), "f"),
        NtileSpec(5, (desc("money"), asc("id")), "m"),
    ]
    got = add_ntiles(df, specs, bins=16)
    for spec in specs:
        assert_same(got, reference(df, spec.n, spec.order_by, spec.out), "id", spec.out)
    assert got.count() == 1500


def test_checkpoint_mode(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    got = global_ntile(df, 3, [desc("k")], "b", bins=3, materialise="checkpoint")
    assert_same(got, reference(df, 3, (desc("k"),), "b"), "k", "b")


def test_plan_has_no_single_partition_window(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = global_ntile(df, 5, [asc("k")], "b", bins=8, materialise="none")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_output_column_is_replaced(spark):
    df = spark.range(20).withColumnRenamed("id", "k").withColumn("b", F.lit(99))
    got = global_ntile(df, 4, [asc("k")], "b", bins=3, materialise="none")
    assert got.columns.count("b") == 1
    assert_same(got, reference(df.drop("b"), 4, (asc("k"),), "b"), "k", "b")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.one_of(st.none(), st.integers(min_value=-3, max_value=3)), min_size=0, max_size=60),
    n=st.integers(min_value=1, max_value=7),
    bins=st.integers(min_value=1, max_value=6),
    ascending=st.booleans(),
    nulls_first=st.sampled_from([None, True, False]),
)
def test_property_matches_window_ntile(spark, values, n, bins, ascending, nulls_first):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int")
    keys = (SortKey("v", ascending, nulls_first), asc("id"))
    got = global_ntile(df, n, keys, "q", bins=bins, materialise="none")
    assert_same(got, reference(df, n, keys, "q"), "id", "q")


def test_nothing_stays_cached_and_the_given_folder_is_used(spark):
    import os

    folder = spark.sparkContext.getCheckpointDir()
    before = sum(len(f) for _, _, f in os.walk(folder.removeprefix("file:")))
    got = global_ntile(spark.range(200).withColumnRenamed("id", "k"), 4, [asc("k")], "b")
    assert got.count() == 200
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    assert sum(len(f) for _, _, f in os.walk(folder.removeprefix("file:"))) > before


def test_plan_moves_no_table_and_stays_small_at_any_sample_size(spark):
    """Three specs at a large bin count: built within a stated time, with a
    small plan and no exchange of the table."""
    import time

    df = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 1000).alias("x"))
    specs = [NtileSpec(5, (asc("x"), asc("k")), "r"), NtileSpec(5, (desc("x"), asc("k")), "f"), NtileSpec(5, (desc("k"),), "m")]
    began = time.time()
    got = add_ntiles(df, specs, bins=4096, materialise="none")
    assert time.time() - began < 90
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and len(plan) < 200_000
    for spec in specs:
        assert_same(got, reference(df, spec.n, spec.order_by, spec.out), "k", spec.out)


@pytest.mark.parametrize("n_rows", [5, 12, 40])
def test_rows_equal_in_all_columns(spark, n_rows):
    """Without a unique key the sizes still follow NTILE's rule, also when
    whole rows repeat across several borders."""
    df = spark.createDataFrame([(1, "x")] * n_rows + [(0, "a"), (2, None)], "v int, s string")
    got = add_ntiles(df, [NtileSpec(5, (asc("v"),), "q"), NtileSpec(3, (desc("s"),), "p")], bins=2, samples_per_bin=2)
    for out, n in (("q", 5), ("p", 3)):
        want = sorted(r["count"] for r in df.withColumn(out, F.ntile(n).over(Window.orderBy("v"))).groupBy(out).count().collect())
        sizes = {r[out]: r["count"] for r in got.groupBy(out).count().collect()}
        assert sorted(sizes.values()) == want and sorted(sizes) == list(range(1, len(sizes) + 1))
        key = "v" if out == "q" else "s"
        if key == "v":
            edges = [(r["v"], r[out]) for r in got.collect()]
            assert all(a[1] <= b[1] for a in edges for b in edges if a[0] < b[0])
    assert got.count() == n_rows + 2
