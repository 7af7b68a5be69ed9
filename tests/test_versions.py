"""Versioned tables: a write that dies leaves the old version readable."""

import multiprocessing
import os
import shutil
import signal
import sys

import pytest
from pyspark.sql import functions as F

from mercata.sources import load_marketplace_parquet, write_tables
from mercata.sources.files import remove
from mercata.sources.versions import current, manifests, read_version, superseded, write_version


def sellers(spark, state, n=3):
    return spark.range(n).select(F.col("id").cast("string").alias("seller_id"), F.lit("1").alias("seller_zip_code_prefix"), F.lit("x").alias("seller_city"), F.lit(state).alias("seller_state"))


def products(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("product_id"))


def states(spark, place):
    return {r.seller_state for r in load_marketplace_parquet(spark, place, ["sellers"])["sellers"].collect()}


def failing(df):
    return df.withColumn("seller_city", F.expr("CASE WHEN seller_id = '1' THEN raise_error('lost') ELSE 'x' END"))


def test_switch_is_all_or_nothing(spark, tmp_path):
    place = f"file://{tmp_path}/t"
    assert manifests(spark, place) == {} and current(spark, place) == {}
    write_tables({"sellers": sellers(spark, "SP"), "products": products(spark, 2)}, place)
    assert states(spark, place) == {"SP"}
    with pytest.raises(Exception, match="lost"):  # products of the new version are written, sellers fail
        write_tables({"products": products(spark, 9), "sellers": failing(sellers(spark, "RJ"))}, place)
    old = load_marketplace_parquet(spark, place, ["sellers", "products"])
    assert states(spark, place) == {"SP"} and old["products"].count() == 2
    write_tables({"sellers": sellers(spark, "RJ")}, place)  # the other table stays
    again = load_marketplace_parquet(spark, place, ["sellers", "products"])
    assert states(spark, place) == {"RJ"} and again["products"].count() == 2
    assert old["sellers"].first().seller_state == "SP"  # a reader of the old version goes on
    with pytest.raises(FileNotFoundError, match="orders"):
        load_marketplace_parquet(spark, place)


def test_a_manifest_under_way_is_not_seen(spark, tmp_path):
    write_tables({"sellers": sellers(spark, "SP")}, str(tmp_path))
    version = write_version({"sellers": sellers(spark, "MG")}, str(tmp_path))
    folder = tmp_path / "manifests" / version
    part = next(p for p in folder.iterdir() if p.name.startswith("part-"))
    staged = folder / "_temporary" / "0" / "task_0"
    staged.mkdir(parents=True)
    shutil.move(part, staged / part.name)  # as before the committer's last step
    (folder / "_SUCCESS").unlink()
    assert states(spark, str(tmp_path)) == {"SP"}


def test_superseded_versions(spark, tmp_path):
    place = str(tmp_path)
    versions = [write_version({"sellers": sellers(spark, s)} | ({"products": products(spark, 4)} if s == "A" else {}), place) for s in "ABCD"]
    gone = superseded(spark, place, keep=2)
    assert sorted(os.path.relpath(p, place) for p in gone) == sorted([f"sellers/{versions[0]}", f"sellers/{versions[1]}", f"manifests/{versions[0]}", f"manifests/{versions[1]}"])
    for path in gone:
        remove(spark, path)
    assert list(manifests(spark, place)) == versions[2:] and states(spark, place) == {"D"}
    assert read_version(spark, place, "products", current(spark, place)).count() == 4  # of version A, still in use
    with pytest.raises(ValueError):
        superseded(spark, place, keep=0)


def _slow_writer(place, ready):
    """A process of its own, so that it can be killed in the middle."""
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from mercata.session import get_session

    spark = get_session(master="local[1]", shuffle_partitions=1)
    wait = F.udf(lambda x: __import__("time").sleep(60) or x)
    write_tables({"products": products(spark, 9)}, f"{place}/probe")
    ready.set()
    write_tables({"products": products(spark, 9), "sellers": sellers(spark, "RJ").withColumn("seller_city", wait("seller_city"))}, place)


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    place = str(tmp_path / "t")
    write_tables({"sellers": sellers(spark, "SP"), "products": products(spark, 2)}, place)
    context = multiprocessing.get_context("spawn")
    ready = context.Event()
    writer = context.Process(target=_slow_writer, args=(place, ready))
    writer.start()
    try:
        assert ready.wait(120)
        for _ in range(600):  # until the new products are there and the sellers are being written
            if len(os.listdir(f"{place}/products")) == 2 and len(os.listdir(f"{place}/sellers")) == 2:
                break
            writer.join(0.1)
    finally:
        os.kill(writer.pid, signal.SIGKILL)
        writer.join()
    assert len(os.listdir(f"{place}/sellers")) == 2
    assert states(spark, place) == {"SP"}
    assert load_marketplace_parquet(spark, place, ["products"])["products"].count() == 2
    write_tables({"sellers": sellers(spark, "RJ")}, place)
    assert states(spark, place) == {"RJ"}


def test_versioned_reports(spark, fixture_tables, tmp_path, monkeypatch):
    from mercata.plans import pipeline

    few = ("row_counts", "status_distribution")
    builders = pipeline.report_builders
    monkeypatch.setattr(pipeline, "report_builders", lambda *a: {k: v for k, v in builders(*a).items() if k in few})
    for fmt in ("parquet", "csv"):
        out = f"{tmp_path}/{fmt}"
        first = pipeline.run_all(fixture_tables, out, fmt=fmt, versioned=True)
        second = pipeline.run_all(fixture_tables, out, fmt=fmt, versioned=True)
        assert len(manifests(spark, out)) == 2
        for name in few:
            assert sorted(map(tuple, first[name].collect())) == sorted(map(tuple, second[name].collect()))
