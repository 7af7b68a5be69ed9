import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercata.llm.top_k import top_k

from .conftest import SF, file_rows


def brute(rows, k=5, every=50):
    once = {}
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * float(c)) for c in x]
        once[i] = min(v, once.get(i, v))
    out = []
    for q in once:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(once[q], v)), i) for i, v in once.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(df, every=50, **kw):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % every == 0, **kw).collect())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.selectExpr("*", *[f"'?' AS `{c}`" for c in ("v", "norm", "router", "part", "score", "rank", "query_id", "limit", "block", "page")])


@pytest.mark.parametrize("bounds", [{}, {"routers": 4, "sample_rows": 40, "group_rows": 60, "page_rows": 16, "block_rows": 3}])
def test_table_equals_brute_force(spark, bounds):
    rows = file_rows("embeddings", ("vec_id", "embedding"))
    assert run(spark.read.parquet(f"{SF}/embeddings.parquet"), **bounds) == brute(rows)


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(400 + i, [0.25] * 6) for i in range(80)]  # one common vector: ties to the smaller vec_id
    rows += [(600, None), (601, []), (602, [1.0, None, 0.0]), (603, [float("nan")] * 6), (604, [float("inf")] + [0.0] * 5), (None, [9.0] * 6), (50, [0.1] * 6), (100, rows[100][1]), (700, [2.0, -1.0])]
    want = brute([(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows])
    df = frame(spark, rows).repartition(4)
    assert run(df) == want
    assert run(df, routers=5, page_rows=8, group_rows=32, block_rows=2, sample_rows=30) == want


def test_few_and_none(spark):
    assert run(frame(spark, [(0, [1.0])])) == []
    assert run(frame(spark, [(0, [1.0]), (1, [-0.5])])) == [(0, 1, 1, -128 * 256)]
    assert run(frame(spark, [(0, [0.0]), (1, [0.0]), (2, [0.0])])) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert top_k(frame(spark, [(0, [1.0])]).limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("scale", [1e5, 1e6, 3e6])
def test_large_components_are_exact(spark, scale):
    rng = np.random.default_rng(int(scale))
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8) * scale]) for i in range(200)]
    rows += [(300 + i, [float(np.float32(c)) for c in np.array(rows[i][1]) * (1 + 1e-7 * (i % 3))]) for i in range(60)]  # nearly equal scores
    df = frame(spark, rows).repartition(3)
    assert run(df) == brute(rows)
    assert run(df, routers=4, page_rows=8, group_rows=32, block_rows=2, sample_rows=40) == brute(rows)


def test_one_huge_vector_among_small_ones(spark):
    rows = [(i, [float(i % 7), 1.0, -2.0, 0.5]) for i in range(120)] + [(200, [float(2**44), 0.0, 0.0, 0.0])]
    assert run(frame(spark, rows)) == brute(rows)


def test_what_does_not_fit_says_so(spark):
    rows = [(i, [1e12, float(i)]) for i in range(60)]
    with pytest.raises(Exception, match="does not fit a 64-bit integer"):
        run(frame(spark, rows))
    with pytest.raises(ValueError, match="component"):
        run(frame(spark, [(0, [1e30]), (1, [1.0])]))
