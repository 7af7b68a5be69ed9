import math
import re
from collections import Counter

import numpy as np
import pytest

from mercata.llm import lexical_search as module
from mercata.llm.lexical_search import Best, lexical_search, term_pieces, tile_scores

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(folded)


def brute(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc, score))
        found.sort(key=lambda r: r[:2] + (r[2] or 0,))
        out += [(item, rank, doc, score) for rank, (_, _, doc, score) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark, make_docs):
    rng = np.random.default_rng(3)
    words = ["ab", "Ab", "Éa", "日本", "x1", "2", "the", "of", "and", "zz-top", "a.b", "under_score"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(120)]
    docs += [(200 + i, "same text of the copies") for i in range(60)]  # ties to the smaller doc_id
    docs += [(None, "same text of the copies"), (None, None), (300, None), (301, ""), (302, " .,-"), (7, docs[7][1]), (303, "the " * 3000)]
    items = [(i, " ".join(rng.choice(words, 8))) for i in range(9)] + [(None, "copies text text"), (3, "copies"), (20, None), (21, "..."), (22, "nowhere"), (23, "THE the of OF")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'?' AS row", "'?' AS terms", "'?' AS rank", "'?' AS score")
    return make_docs(docs).repartition(5), asked.repartition(3), docs, items


@pytest.mark.parametrize("bounds", [{}, {"block_items": 4, "block_terms": 10, "tile_docs": 7, "tile_terms": 2, "k": 3}])
def test_equals_brute_force(tables, bounds):
    docs, asked, d, i = tables
    assert rows(lexical_search(docs, asked, **bounds)) == brute(d, i, bounds.get("k", 20))


def test_no_rows(tables, no_docs):
    docs, asked, d, i = tables
    assert rows(lexical_search(no_docs, asked)) == []
    assert rows(lexical_search(docs, asked.limit(0))) == []
    assert rows(lexical_search(docs.where("doc_id IN (300, 301, 302)"), asked)) == []


def test_terms_of_long_texts(monkeypatch):
    text = ("Wörd 12a-b\t" * 500 + "x" * 300).encode()
    whole = [t for piece in term_pieces(text) for t in piece]
    assert [w.decode() for w in whole] == terms(text.decode())
    monkeypatch.setattr(module, "PIECE", 50)
    assert [t for piece in term_pieces(text) for t in piece] == whole


def test_partial_sums_stay_exact():
    rng = np.random.default_rng(5)
    for top in (1 << 12, 1 << 33, 1 << 42):  # one tile; many tiles; limbs
        weights = rng.integers(0, top, (3, 17))
        impacts = rng.integers(0, module.IMPACT, (17, 5))
        for columns, _, part in module.tiles(weights, 8):
            assert (part.sum(axis=1) * module.IMPACT < module.EXACT).all() or part.shape[1] == 1
        want = [[sum(int(a) * int(b) for a, b in zip(w, impacts[:, j])) for j in range(5)] for w in weights]
        if max(map(max, want)) < 1 << 63:
            assert tile_scores(weights, impacts.astype(float), 8).tolist() == want
    with pytest.raises(ArithmeticError):
        module._weights(np.array([[1 << 50]]), np.array([1]), 10)


def test_best_keeps_ties_by_id():
    best = Best(1, 3)
    none = np.zeros(4, bool)
    best.add(np.array([[5, 5, 5, 5]]), np.array([40, 30, 20, 10]), none)
    best.add(np.array([[5, 0, 5, 6]]), np.array([15, 1, 50, 99]), none)
    assert list(zip(best.score, best.doc)) == [(6, 99), (5, 10), (5, 15)]
