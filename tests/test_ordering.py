"""order_key's strings sort as ORDER BY does, for every type it takes."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mercata.functions.ordering import order_key
from mercata.operators.ntile import NtileSpec, SortKey, add_ntiles, asc, desc

rng = random.Random(11)
DOUBLES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, math.nan, 0.1, 0.3, 2.0**53, 2.0**53 - 1]
DOUBLES += [math.ldexp(1.0, e) for e in range(-1074, 1024, 97)] + [math.nextafter(math.ldexp(1.0, e), 0) for e in range(-1000, 1024, 101)] + [rng.uniform(-9, 9) * 10.0 ** rng.randint(-300, 300) for _ in range(150)]
CASES = {
    "tinyint": [-128, -1, 0, 1, 127],
    "int": [-(2**31), -5, 0, 7, 2**31 - 1],
    "bigint": [-(2**63), -(2**40), -1, 0, 1, 2**40, 2**63 - 1],
    "boolean": [True, False],
    "date": [dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2020, 2, 29), dt.date(9999, 12, 31)],
    "timestamp": [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 0, 0, 0, 1)],
    "timestamp_ntz": [dt.datetime(1, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2020, 1, 1, 12, 0, 9), dt.datetime(2020, 1, 1, 12, 0, 10, 5), dt.datetime(2020, 1, 2)],
    "decimal(10,2)": [Decimal(x) / 100 for x in (-99999, -101, -100, -1, 0, 1, 99, 100, 101, 12345678)],
    "decimal(38,18)": [Decimal(x) for x in ("-99999999999999999999.999999999999999999", "-1.5", "-1.499999999999999999", "0", "0.000000000000000001", "99999999999999999999.999999999999999999")],
    "decimal(38,0)": [Decimal(x) for x in (-(10**38) + 1, -7, 0, 8, 10**38 - 1)],
    "double": DOUBLES,
    "float": [0.0, 1.5, -1.5, math.nan, math.inf, -math.inf, 3.4e38, 1e-45],
    "string": ["", "a", "aa", "ab", "b", "\u0000", "\u0000a", "é", "z", "日本", "😀", "!", "~", "a!", "A"],
    "binary": [b"", b"\x00", b"\x00\x00", b"\xff", b"\x7f\x80"],
}


@pytest.mark.parametrize("kind", CASES)
@pytest.mark.parametrize("ascending,nulls_first", [(True, False), (False, True), (True, True)])
def test_key_sorts_as_order_by(spark, kind, ascending, nulls_first):
    values = [*CASES[kind], None, CASES[kind][0]]
    rng.shuffle(values)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    keyed = df.withColumn("k", F.expr(order_key([("v", df.schema["v"].dataType, ascending, nulls_first)])))
    by_value = Window.orderBy(SortKey("v", ascending, nulls_first).sort_column())
    rows = keyed.select(F.dense_rank().over(by_value).alias("a"), F.dense_rank().over(Window.orderBy("k")).alias("b"), "k").collect()
    assert all(r.a == r.b for r in rows)
    assert [r.k for r in sorted(rows, key=lambda r: r.k)] == [r.k for r in sorted(rows, key=lambda r: r.a)]  # Python's order too


def test_composite_keys_do_not_run_together(spark):
    rows = [(a, b) for a in ("", "a", "aa", "a!", None) for b in ("", "a", "aa", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    kind = df.schema["a"].dataType
    for up in (True, False):
        keyed = df.withColumn("k", F.expr(order_key([("a", kind, up, True), ("b", kind, not up, False)])))
        order = [SortKey("a", up, True).sort_column(), SortKey("b", not up, False).sort_column()]
        ranks = keyed.select(F.rank().over(Window.orderBy(*order)).alias("x"), F.rank().over(Window.orderBy("k")).alias("y")).collect()
        assert all(r.x == r.y for r in ranks)


def test_types_without_an_order_key(spark):
    with pytest.raises(TypeError):
        order_key([("v", spark.createDataFrame([], "v array<int>").schema["v"].dataType, True, True)])


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_borders_of_all_scores_take_three_queries(spark):
    """A sample, an aggregate and a window, whatever the number of scores
    (an exchange is a job of its own under adaptive execution)."""
    rows = [(i, i * 7919 % 1000, Decimal(i % 313) / 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, x int, money decimal(20,6)").checkpoint()
    specs = [NtileSpec(5, (asc("x"), asc("id")), "r"), NtileSpec(5, (desc("x"), desc("money"), asc("id")), "f"), NtileSpec(7, (desc("money"), asc("id")), "m")]
    counted, count_jobs = jobs_of(spark, "count", df.count)
    for n in (1, 3):
        out, jobs = jobs_of(spark, f"ntile-{n}", lambda n=n: add_ntiles(df, specs[:n], materialise="none"))
        assert jobs - count_jobs <= 5  # 1 for the sample, 2 each for the aggregate and the window
    _, jobs = jobs_of(spark, "checkpoint", lambda: add_ntiles(df, specs))
    assert jobs <= 6  # one more writes and counts the input
    for spec in specs:
        want = df.withColumn("w", F.ntile(spec.n).over(Window.orderBy(*[k.sort_column() for k in spec.order_by])))
        assert out.join(want, "id").where(f"{spec.out} <> w").count() == 0


def test_few_rows_are_ranked(spark, monkeypatch):
    """The ranked slice is a small share of the table; a sample that misses
    every border still gives the exact result."""
    from mercata.operators import ntile

    seen = []
    inner = ntile._slices
    monkeypatch.setattr(ntile, "_slices", lambda ordered, share: seen.append(inner(ordered, share)) or seen[-1])
    df = spark.range(20_000).select(F.col("id").alias("k"))
    out = add_ntiles(df, [NtileSpec(4, (asc("k"),), "q")], materialise="none")
    assert all(2 <= len(s) <= ntile.SLICES + 2 for s in seen)
    want = F.floor(F.col("k") / 5000) + 1
    assert out.where(F.col("q") != want).count() == 0
    for wrong in (lambda ordered, share: ordered[:3], lambda ordered, share: ordered[-2:], lambda ordered, share: []):
        monkeypatch.setattr(ntile, "_slices", wrong)
        out = add_ntiles(df, [NtileSpec(4, (asc("k"),), "q")], materialise="none")
        assert out.where(F.col("q") != want).count() == 0
