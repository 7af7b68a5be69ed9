import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercata.llm.components import components
from mercata.llm.near_dedup import near_dedup

from .conftest import EDGE_TEXTS, SF, file_rows


def brute(rows, width=5, percent=75):
    """{doc_id: (size of the set, component)} for distinct doc_ids."""
    sets, holders = {}, defaultdict(list)
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        for g in sets[i]:
            holders[g].append(i)
    both = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def run(df, **kw):
    out = near_dedup(df, **kw).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def test_table_equals_brute_force(spark):
    rows = file_rows("documents", ("doc_id", "text"))
    assert run(spark.read.parquet(f"{SF}/documents.parquet")) == brute(rows)


def test_edges(edge_docs):
    want = brute([r for r in EDGE_TEXTS if r[0] is not None])
    got = run(edge_docs)
    none = got.pop(None)
    assert none == (1, None)
    assert got == want
    assert sorted(r.doc_id for r in near_dedup(edge_docs).collect() if r.doc_id is not None) == sorted(i for i, _ in EDGE_TEXTS if i is not None)


def test_empty_table(no_docs):
    assert near_dedup(no_docs).collect() == []


def variants(rng, base, edits, n):
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.choice(len(w), edits, replace=False):
            w[at] = f"n{rng.integers(1 << 40)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("edits", [2, 4, 6])
def test_large_group_of_near_copies(make_docs, edits):
    """Many copies of one text, some linked only through others, and a text
    chain: exactly the brute-force components."""
    rng = np.random.default_rng(edits)
    base = [f"w{i}" for i in range(150)]
    rows = list(enumerate(variants(rng, base, edits, 120)))
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):  # neighbours share most, far ends share little
        rows.append((500 + k, " ".join(chain[k * 8 : k * 8 + 100])))
    line = "this very common line of words is in many texts"
    rows += [(900 + k, line + " " + " ".join(f"u{k}_{j}" for j in range(60))) for k in range(40)]
    order = rng.permutation(len(rows))
    assert run(make_docs([rows[i] for i in order])) == brute(rows)


def test_a_group_in_several_components_is_merged_in_linear_rounds(make_docs, monkeypatch):
    """The smallest members of a large group are linked with few of it: rounds
    with other members merge the rest before any list is joined with itself."""
    from mercata.llm import near_dedup as module

    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    rows = list(enumerate(variants(rng, base, 7, 60) + variants(rng, base, 2, 300)))
    seen = {"pairs": 0, "rounds": 0}
    join, pairs = module.open_links, module.round_pairs

    def most_components(labelled):
        return labelled.groupBy("token").agg(F.count_distinct("component").alias("k")).agg(F.max("k")).first()[0]

    def last(labelled, sets, percent):
        seen["left"] = most_components(labelled)
        return join(labelled, sets, percent)

    def one_round(labelled, percent, matches):
        out = pairs(labelled, percent, matches)
        seen["rounds"] += 1
        seen.setdefault("first", most_components(labelled))
        seen["pairs"] += out.count()
        seen["postings"] = labelled.count()
        return out

    monkeypatch.setattr(module, "open_links", last)
    monkeypatch.setattr(module, "round_pairs", one_round)
    assert run(make_docs(rows)) == brute(rows)
    assert seen["rounds"] > 1 and seen["pairs"] <= 2 * seen["rounds"] * seen["postings"]
    assert seen["left"] <= 61 < seen["first"]  # the group is one component, beside a few texts that are linked with none of it


def test_open_lists_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies of one set, most pairs below the threshold, linked here and there."""
    import mercata.llm.near_dedup as module

    rng, free = random.Random(5), iter(range(1000, 10**6))
    sets = []
    for i in range(240):
        values = list(range(150))
        for place in rng.sample(range(150), rng.randint(9, 16)):
            values[place] = next(free)
        sets.append((i, bytes([i]), bytearray(np.sort(np.array(values, np.uint64)).tobytes())))
    table = spark.createDataFrame(sets, "doc_id long, set_key binary, shingles binary")
    labelled = spark.createDataFrame([(1, i, 150, 0, i) for i in range(240)], "token long, rep long, n_shingles long, rest long, component long")
    compared, similar = [], module._similar

    def seen(pairs, percent):
        compared.append(pairs.count())
        return similar(pairs, percent)

    monkeypatch.setattr(module, "_similar", seen)
    got = [(r.a, r.b) for r in module.open_links(labelled, table, 75).collect()]
    values = [set(np.frombuffer(bytes(s), np.uint64).tolist()) for _, _, s in sets]
    linked = [(a, b) for a in range(240) for b in range(a) if 100 * len(values[a] & values[b]) >= 75 * len(values[a] | values[b])]
    assert all((max(p), min(p)) in linked for p in got)

    def groups(edges):
        root = list(range(240))
        for a, b in edges:
            a, b = root[a], root[b]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    assert groups(got) == groups(linked)
    assert 0 < len(linked) < 240 * 239 / 2 / 4  # most pairs are not linked
    assert sum(compared) < 240 * 239 / 2 * 2 / 3


def test_pairs_that_sketches_rule_out_are_not_made(spark, monkeypatch):
    """A large group whose rounds leave texts that are linked with few of it or
    none: few pairs that are not linked are looked up among the full sets."""
    import mercata.llm.near_dedup as module

    rng, free = random.Random(7), iter(range(1000, 10**6))
    sets = []
    for i in range(240):
        values = list(range(146))
        for place in rng.sample(range(146), 5 if i % 4 else 17):
            values[place] = next(free)
        sets.append((i, bytes([i]), bytearray(np.sort(np.array(values, np.uint64)).tobytes())))
    values = [set(np.frombuffer(bytes(s), np.uint64).tolist()) for _, _, s in sets]
    linked = {(a, b) for b in range(240) for a in range(b) if 100 * len(values[a] & values[b]) >= 75 * len(values[a] | values[b])}
    asked, similar = [], module._similar

    def seen(pairs, percent):
        asked.append({(r.a, r.b) for r in pairs.select("a", "b").collect()})
        return similar(pairs, percent)

    # Without rounds: all that they would leave in a larger group.
    monkeypatch.setattr(module, "_similar", seen)
    monkeypatch.setattr(module, "turn_pairs", lambda able, percent, turn: able.select(*(F.col(c).alias(x) for c, x in (("doc_id", "a"), ("doc_id", "b"), ("component", "of_a"), ("component", "of_b")))).limit(0))
    table = spark.createDataFrame(sets, "doc_id long, set_key binary, shingles binary")
    labelled = spark.createDataFrame([(1, i, 146, 0, i) for i in range(240)], "token long, rep long, n_shingles long, rest long, component long")
    assert {(r.a, r.b) for r in module.open_links(labelled, table, 75).collect()} == linked
    others = 240 * 239 // 2 - len(linked)
    assert len(asked[-1] - linked) < others / 5


def test_turns_test_ends_before_they_are_rows(spark):
    """A list whose members are one component but for one text."""
    import mercata.llm.near_dedup as module

    able = spark.createDataFrame([(1, i, 0 if i < 50 else 50, 150, 150) for i in range(51)], "shingle long, doc_id long, component long, n long, left long")
    found = module.turn_pairs(able, 75, 0)
    rows = found.collect()
    assert rows and all(r.b == 50 and r.of_a == 0 and r.of_b == 50 for r in rows) and len(rows) == len(set(rows))
    assert "Generate explode(filter(" in found._jdf.queryExecution().executedPlan().toString()


def test_sketches_never_differ_more_than_sets(spark):
    import mercata.llm.near_dedup as module

    rng = np.random.default_rng(1)
    for size, changed in ((1, 1), (9, 0), (150, 12), (150, 40), (5000, 300)):
        x = rng.integers(0, 2**63, size).astype(np.uint64)
        y = np.concatenate([x[changed:], rng.integers(0, 2**63, 2 * changed).astype(np.uint64)])
        a, b = (np.unpackbits(module.sketch(v).view(np.uint8)) for v in (x, y))
        assert (a != b).sum() <= len(np.setxor1d(x, y))
        assert changed or not (a != b).any()


def test_short_texts_at_the_threshold(make_docs):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "a b c d e f"), (4, "x a b c d e f g"), (5, "p q"), (6, "P  Q"), (7, "p q r")]
    assert run(make_docs(rows)) == brute(rows)


def test_rows_of_one_doc_id_hang_together(make_docs):
    rows = [(1, "a b c d e f"), (2, "k l m n o p"), (3, "a b c d e f"), (3, "k l m n o p")]
    got = near_dedup(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 1), (3, 1)]


def test_components_of_paths_stars_and_rings(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    edges += [(int(a), int(b)) for a, b in rng.integers(300, 400, (60, 2))]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in list(root) if find(v) != v}


def test_components_of_linked_stars_and_paths_take_few_shuffles(spark, monkeypatch):
    """Each shuffle is a stage of many small tasks, whatever it moves: few for
    stars that hang together by members, and for a path in order few rounds."""
    from mercata.llm import components as module

    planned, write = [], module.cut

    def counted(df):
        planned.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df)

    monkeypatch.setattr(module, "cut", counted)
    stars = [(1000 * k + i, 1000 * k) for k in range(1, 9) for i in range(1, 20)]
    links = [(1000 * k + 1000 + 5, 1000 * k + 7) for k in range(1, 8)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(stars + links, "a long, b long")).collect()}
    assert got == {v: 1000 for e in stars + links for v in e if v != 1000}
    assert sum(planned) <= 12
    planned.clear()
    got = {r.vertex: r.component for r in components(spark.createDataFrame([(i, i + 1) for i in range(700)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 701)}
    assert sum(planned) <= 12
