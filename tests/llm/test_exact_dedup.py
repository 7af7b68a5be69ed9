import hashlib
from collections import Counter

from mercata.llm.exact_dedup import exact_dedup, misra_gries

from .conftest import EDGE_TEXTS


def brute(rows):
    """Multiset of (doc_id, keep_id, group_size, kept)."""
    groups = {}
    for i, text in rows:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(key, []).append(i)
    out = Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        one = True
        for i in ids:
            out[(i, keep, len(ids), i == keep and one)] += 1
            one = one and i != keep
    return out


def run(df, **kw):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df, **kw).collect())


def test_edges(edge_docs):
    assert run(edge_docs) == brute(EDGE_TEXTS)


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).collect() == []


def test_heavy_and_light_paths_agree(make_docs):
    rows = [(i, f"Text {i % 7 if i % 3 else 0}") for i in range(400)] + [(1000 + i, f"alone {i}") for i in range(100)]
    want = brute(rows)
    df = make_docs(rows).repartition(3)
    for counters, least in ((1, 2), (4, 2), (64, 1), (8, 10_000)):
        assert run(df, counters=counters, least_rows=least) == want


def test_misra_gries_holds_every_frequent_digest(spark):
    keys = [b"hot"] * 300 + [str(i).encode() for i in range(600)]
    df = spark.createDataFrame([(k,) for k in keys], "digest binary").repartition(4)
    found = {bytes(r.digest): r.least for r in misra_gries(df, 10).groupBy("digest").sum("least").withColumnRenamed("sum(least)", "least").collect()}
    assert b"hot" in found and found[b"hot"] <= 300


def test_digest_is_sha256_of_normalised_text(make_docs):
    row = exact_dedup(make_docs([(1, "ÀBc É")])).first()
    assert bytes(row.digest) == hashlib.sha256("Àbc É".encode()).digest()


def test_summaries_keep_what_is_just_frequent(spark):
    df = spark.createDataFrame([(bytes(c, "ascii"),) for c in "abca"], "digest binary").coalesce(1)
    assert b"a" in {bytes(r.digest) for r in misra_gries(df, 2).collect()}  # 2 of 4 rows, 2 counters
