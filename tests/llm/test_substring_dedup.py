import hashlib

import numpy as np
import pytest
from mercata.llm.substring_dedup import locate, substring_dedup

from .conftest import EDGE_TEXTS, SF, file_rows


def brute(rows, width=13):
    """Sorted (doc_id, n_words, n_removed, kept_sha256)."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - width + 1):
            if i is not None:
                g = tuple(w[k : k + width])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df, **kw):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, keep_text=False, **kw).collect())


@pytest.mark.parametrize("bounds", [{}, {"holders": 2, "shard_phrases": 50, "frequent": 2}])
def test_table_equals_brute_force(spark, bounds):
    assert run(spark.read.parquet(f"{SF}/documents.parquet"), **bounds) == brute(file_rows("documents", ("doc_id", "text")))


def test_edges(edge_docs):
    assert run(edge_docs) == brute(EDGE_TEXTS)


def test_empty_table(no_docs):
    assert substring_dedup(no_docs).collect() == []


def test_passages_common_lines_and_repeats(make_docs):
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(60))
    line = " ".join(f"l{i}" for i in range(13))
    rows = []
    for i in range(60):
        own = [f"d{i}_{j}" for j in range(int(rng.integers(0, 40)))]
        at = int(rng.integers(0, len(own) + 1))
        middle = passage if i % 3 == 0 else line if i % 3 == 1 else " ".join(["same"] * 20)
        rows.append((i, " ".join(own[:at]) + "\n" + middle + "  " + " ".join(own[at:])))
    rows += [(100, passage + " " + passage), (101, " ".join(passage.split()[:12])), (102, " ".join(passage.split()[5:18])), (7, rows[7][1])]
    order = rng.permutation(len(rows))
    df = make_docs([rows[i] for i in order]).repartition(3)
    for bounds in ({}, {"holders": 3, "shard_phrases": 7, "frequent": 1}):
        assert run(df, **bounds) == brute(rows)


def test_kept_text(make_docs):
    shared = " ".join(f"s{i}" for i in range(13))
    out = {r.doc_id: r.kept_text for r in substring_dedup(make_docs([(1, shared), (2, f"a {shared}\nb")])).collect()}
    assert out == {1: shared, 2: "a b"}


def test_locate_is_exact_by_words():
    one, two = b"a b c d", b"x a b c"
    assert locate([one, two], np.array([5, 9]), np.array([5, 9]), 3).to_pylist() == [[5, None], [None, 5]]
    assert locate([one], np.array([5]), np.array([6]), 3).to_pylist() == [[5, 5]]
