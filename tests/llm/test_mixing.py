from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mercata.llm.mixing import SEED, keyed, mix

from .conftest import EDGE_TEXTS, SF, file_rows


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Resharing until no source is above its cap, as the contract puts it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > cap * sizes[s]]
        if not above:
            return share | capped
        capped |= {s: float(cap * sizes[s]) for s in above}


def words(text):
    return len((text or "").encode().split())


def check(df, rows, **kw):
    got = mix(df, **kw).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    want = targets(dict(sizes)) if sizes else {}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert {s: round(want[s]) for s in sizes} == {s: taken[s] for s in sizes}
    return sorted((r.doc_id or -1, r["size"], r.taken) for r in got)


def test_targets_and_exact_budgets_on_the_table(spark):
    rows = file_rows("documents", ("doc_id", "text", "source"))
    df = spark.read.parquet(f"{SF}/documents.parquet")
    first = check(df, rows)
    assert first == check(df.repartition(7), rows)
    check(df, rows, bucket_rows=3)


def test_capped_sources_and_null_source(make_docs):
    rows = [(i, "w " * (i % 5 + 1), "b") for i in range(200)] + [(1000, "x y", "a"), (1001, "z", "a"), (1002, "q " * 30, None), (1003, None, "empty")]
    check(make_docs([(i, t, "en", s) for i, t, s in rows]), rows, bucket_rows=16)


def test_edges(edge_docs):
    check(edge_docs, [(i, t, "s") for i, t in EDGE_TEXTS], bucket_rows=2)


def test_no_words_and_empty_table(make_docs, no_docs):
    assert mix(no_docs).collect() == []
    got = mix(make_docs([(1, None, None, "a"), (2, "", None, "b")])).collect()
    assert {(r["size"], r.target, r.taken) for r in got} == {(0, 0.0, 0)}


def test_which_documents_are_taken(spark):
    """In key order each source gives whole documents up to its budget, and part of the one at the cut."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    key = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), F.xxhash64("text"), F.lit(0).cast("long")).alias("key")
    sizes, order = defaultdict(int), defaultdict(list)
    for r in df.select("doc_id", "text", "source", key).collect():
        sizes[r.source] += words(r.text)
        order[r.source].append((r.key, r.doc_id, words(r.text)))
    want = {}
    for source, budget in targets(dict(sizes)).items():
        epochs, rest = divmod(round(budget), sizes[source])
        for _, doc_id, size in sorted(order[source]):
            last = min(size, rest)
            want[doc_id], rest = epochs * size + last, rest - last
    assert {r.doc_id: r.taken for r in mix(df, bucket_rows=8).collect()} == want


def test_rows_without_id_and_copies_spread_over_the_keys(spark):
    """A third of the rows without doc_id, a third equal rows."""
    df = spark.range(0, 30000, numPartitions=6).selectExpr(
        "CASE WHEN id % 3 = 2 THEN id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same few words' ELSE concat('w ', id) END AS text", "'s' AS source"
    )
    place = F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * 100)
    buckets = [r["count"] for r in keyed(df, copies=64).groupBy(place).count().collect()]
    assert sum(buckets) == 30000 and len(buckets) == 100 and max(buckets) < 400
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    once = check(df, rows)
    assert once == check(df.repartition(3), rows)
