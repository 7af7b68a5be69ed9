import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercata.llm import vector_code as module
from mercata.llm.vector_code import Codebook, compress, label_errors, limbs

from .conftest import SF, file_rows


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, x, label) for i, x, label in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    if not kept:
        return [], []
    part = max(1, -(-max(len(x) for _, x, _ in kept) // parts))
    vectors = [[module.exact_floor(c) for c in x] + [0] * (part * parts - len(x)) for _, x, _ in kept]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    cut = lambda v, p: v[p * part : (p + 1) * part]
    books = [[cut(vectors[n], p) for n in order] for p in range(parts)]
    near = lambda y, book: min((sum((a - b) ** 2 for a, b in zip(y, e)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for v in vectors:
                mine[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(mine, books[p])]
    out, errors = [], {}
    for (i, _, label), v in zip(kept, vectors):
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, [n for _, n in best], sum(d for d, _ in best)))
        errors[label] = errors.get(label, 0) + out[-1][3]
    return [(i, codes, error, errors[label]) for i, label, codes, error in out], books


def frame(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.selectExpr("*", *[f"'?' AS `{c}`" for c in ("codes", "error", "label_error", "of", "n", "hot", "part", "entry", "d", "at", "limb")])


def same(df, rows, **kw):
    coded, books = compress(df, **kw)
    got = [(r.vec_id, list(r.codes), r.error, r.label_error) for r in label_errors(coded).collect()]
    want, held = brute(rows, **kw)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert books == held


def test_table_equals_brute_force(spark):
    same(spark.read.parquet(f"{SF}/embeddings.parquet"), file_rows("embeddings", ("vec_id", "embedding", "label")))


@pytest.mark.parametrize("hot", [512, 2])
def test_edges(spark, monkeypatch, hot):
    monkeypatch.setattr(module, "HOT_SHARE", hot)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32).tolist(), None if i % 3 == 0 else i % 11) for i in range(150)]
    rows += [(i, [0.5] * 32, 1) for i in range(90)]  # repeated ids, one common vector
    rows += [(None, [0.25] * 32, None), (None, [0.25] * 32, 2), (500, None, 1), (501, [1.0, None], 1), (502, [math.nan] * 32, 1), (503, [math.inf] + [0.0] * 31, None), (504, [], 3), (505, [1.5, -2.0], 3)]
    same(frame(spark, rows).repartition(4), rows)
    same(frame(spark, rows).repartition(4), rows, parts=5, entries=7, rounds=1)  # 32 components are filled up to 35


def test_few_and_none(spark):
    same(frame(spark, [(3, [1.0] * 16, 0), (1, [2.0] * 16, 0)]), [(3, [1.0] * 16, 0), (1, [2.0] * 16, 0)])
    same(frame(spark, [(1, [], None)]), [(1, [], None)])
    for rows in ([(1, None, 0)], []):
        coded, books = compress(frame(spark, rows))
        assert label_errors(coded).collect() == [] and books == []
    with pytest.raises(ValueError):
        compress(frame(spark, []), entries=65)


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * 10.0 ** (i % 7)).tolist(), i % 2) for i in range(100)]  # beyond 64-bit squares of the fast way
    same(frame(spark, rows), rows)
    huge = [(i, [1e30 * (1 + i % 2)] * 16, 0) for i in range(8)]  # exact distances of 0
    same(frame(spark, huge), huge)
    with pytest.raises(Exception, match="does not fit"):
        compress(frame(spark, [(i, [float(i) * 1e12] * 16, 0) for i in range(70)]))


def test_masks_hold_the_nearest_entry_exactly():
    rng = np.random.default_rng(6)
    for kind in (np.int64, object):
        book = Codebook(rng.integers(-40, 40, (64, 3)).astype(kind))
        x = rng.integers(-60, 60, (500, 3)).astype(kind)
        away = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2).astype(np.int64)
        code, least = book.assign(x)
        assert (code == away.argmin(axis=1)).all() and (least == away.min(axis=1)).all()
        mask, reach = book.candidates(x), book.radius(x)
        inside = (np.abs(x[:, None] - book.entries[None]) <= reach[:, None, None]).all(axis=2)
        assert (mask == (inside.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1)).all()
        assert inside.sum() < 0.5 * inside.size  # most distances are never worked out


def test_limbs():
    for n in (0, 5, -5, 1 << 31, -(1 << 31), -(1 << 31) - 1, 1 << 64, -(1 << 1000) + 7):
        assert sum(x << (32 * i) for i, x in enumerate(limbs(n))) == n and all(abs(x) < 1 << 32 for x in limbs(n))


def test_floats_count_as_doubles(spark):
    rows = file_rows("embeddings", ("vec_id", "embedding", "label"))[:40]
    same(spark.read.parquet(f"{SF}/embeddings.parquet").where(F.col("vec_id").isin([r[0] for r in rows])), rows)
