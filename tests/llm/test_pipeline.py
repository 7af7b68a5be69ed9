import inspect
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from mercata.llm.common import cut

from .conftest import EDGE_TEXTS
from .test_mixing import targets, words
from .test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """Documents before the first stage and after each."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in cp.STAGES:
        out.append(cut(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_shape(steps):
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in cp.STAGES)
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_language_keeps_clean_documents(steps):
    before, after = dict(rows(steps[0])), dict(rows(steps[1]))
    assert after.items() <= before.items()
    assert {i for i, t in before.items() if any(c.isalpha() for c in t or "")} == set(after)


def test_exact_keeps_the_largest_id(steps):
    groups = defaultdict(list)
    for i, t in rows(steps[1]):
        groups[t.encode().lower()].append(i)
    assert sorted(i for i, _ in rows(steps[2])) == sorted(map(max, groups.values()))


def test_near_keeps_one_of_each_component(steps):
    want = near_brute(rows(steps[2]))
    assert sorted(i for i, _ in rows(steps[3])) == sorted(i for i, (_, c) in want.items() if i == c)


def test_mixture_comes_near_the_targets(steps):
    sizes, taken, largest = defaultdict(int), defaultdict(int), 0
    for r in steps[3].collect():
        sizes[r.source] += words(r.text)
        largest = max(largest, words(r.text))
    for r in steps[4].collect():
        taken[r.source] += words(r.text)
    want = targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    assert max(Counter(i for i, _ in rows(steps[4])).values()) <= 3


def test_encoding_equals_the_library(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(rows(steps[4]))
    got = steps[5].collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows(steps[4]))
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_is_the_stages_in_order(spark, steps):
    got = Counter((r.doc_id, r.ids_sha256) for r in cp.run(spark, SF).collect())
    assert got == Counter((r.doc_id, r.ids_sha256) for r in steps[5].collect())


def test_edges(spark, make_docs, edge_docs, no_docs):
    assert [stage(spark, no_docs, SF).count() for _, stage in cp.STAGES] == [0] * 5
    docs = edge_docs
    for k, (_, stage) in enumerate(cp.STAGES):
        columns = docs.columns
        docs = cut(stage(spark, docs, SF))
        assert k == 4 or docs.columns == columns
        if k == 0:
            known = [i for i, t in EDGE_TEXTS if any(c.isalpha() for c in t or "")]
            assert Counter(r.doc_id for r in docs.collect()) == Counter(known)
        if k == 1:
            assert Counter(r.doc_id for r in docs.collect()) == Counter([5, 6, 12, None, 9, 10, 11])


def test_exact_decides_on_rows(spark, make_docs):
    docs = make_docs([(None, "one text here"), (7, "One text here"), (None, "another text"), (5, "One"), (5, "one"), (5, "two"), (9, "two")])
    got = Counter((i, t.lower()) for i, t in rows(cp.exact(spark, docs, SF)))
    assert got == Counter([(7, "one text here"), (None, "another text"), (5, "one"), (9, "two")])


def test_mixture_decides_on_rows(spark, make_docs):
    docs = make_docs([(None if i % 3 else 4, f"w{i} " * (10 + i % 7), None, "abc"[i % 2 + (i % 10 == 0)]) for i in range(300)])
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    out = cp.mixture(spark, docs, SF)
    assert out.columns == docs.columns
    for r in out.collect():
        taken[r.source] += words(r.text)
    want = targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 16 for s in sizes)


def test_near_decides_on_ids_and_keeps_rows_without_one(spark, make_docs):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = make_docs([(None, text), (None, text), (3, text), (4, text), (4, "quite another text of its own, with more words")])
    assert Counter(i for i, _ in rows(cp.near(spark, docs, SF))) == Counter([None, None, 3])
