import zlib

import numpy as np
import pytest
from mercata.llm.language_id import code_lengths, compile_trees, count_ngrams, identify, keep_known, learn

from .conftest import EDGE_TEXTS, SF, file_rows


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in identify(docs).collect()}
    rows = file_rows("documents", ("doc_id", "lang"), "/root/testdata/sf0.01")
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    apart = [(i, lang) for i, lang in rows if got[i].held_out and lang]
    assert len(apart) > 100
    assert np.mean([got[i].lang_pred == lang for i, lang in apart]) > 0.99
    assert all(0 <= r.score <= 1 for r in got.values())


def test_lang_source_and_doc_id_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(docs)
    from mercata.llm.language_id import predict

    one = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs, model).collect()}
    two = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs.selectExpr("doc_id", "text", "'?' AS lang", "'?' AS source").repartition(5), model).collect()}
    assert one == two


def test_edges(edge_docs):
    out = identify(edge_docs).collect()
    assert len(out) == len(EDGE_TEXTS)
    by_id = {r.doc_id: r for r in out}
    for i in (1, 2, 3, 13):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert {by_id[i].lang_pred for i in (4, 6, 9, 10, 11)} == {"en"}


def test_nothing_to_learn_and_empty_table(make_docs, no_docs):
    assert identify(no_docs).collect() == []
    out = identify(make_docs([(1, "some text", None), (2, "more", None)])).collect()
    assert {(r.lang_pred, r.score) for r in out} == {("und", 0.0)}


def test_keep_known_keeps_rows_and_columns(make_docs):
    docs = make_docs([(i, "the cat sat on the mat " * 5, "en") for i in range(1, 40)] + [(90, "123 456", "en"), (91, None, "en")])
    kept = keep_known(docs, learn(docs))
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == set(range(1, 40))


class Tree:
    """PPM, method C with exclusion, straight from counts."""

    def __init__(self, counts, order):
        self.follow, self.order = {}, order
        for code, n in counts.items():
            raw = code.to_bytes((code.bit_length() + 7) // 8, "big")[1:]
            self.follow.setdefault(raw[:-1], {})[raw[-1]] = n

    def bits(self, text, contexts):
        total = 0.0
        for i, byte in enumerate(text):
            context = next(text[j:i] for j in range(max(0, i - self.order), i + 1) if text[j:i] in contexts or j == i)
            seen = set()
            while True:
                table = {b: n for b, n in self.follow.get(context, {}).items() if b not in seen}
                n, kinds = sum(table.values()), len(table)
                if byte in table:
                    total += np.log2((n + kinds) / table[byte])
                    break
                if kinds:
                    total += np.log2((n + kinds) / kinds)
                seen |= set(table)
                if not context:
                    total += np.log2(max(1, 256 - len(seen)))
                    break
                context = context[1:]
        return total


@pytest.mark.parametrize("run_bytes", [3, 7, 512])
def test_code_lengths_equal_plain_ppm(spark, run_bytes):
    rows = [("xx", "abracadabra abra kadabra"), ("yy", "mississippi missing sips"), ("xx", "abba baobab"), ("yy", "ship shape")]
    counts = count_ngrams(spark.createDataFrame(rows, "lang string, text string"), 3).toPandas()
    model = compile_trees(counts, 3, 10_000)
    contexts = {c.to_bytes((c.bit_length() + 7) // 8, "big")[1:] for c in counts["code"] if c < 1 << 25}
    texts = [b"abracadabra", b"mississippi abba", b"zebra ship", b"", b"q" * 40, b"missing kadabra ships and sips " * 8]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    got = code_lengths(model, data, offsets, run_bytes)
    for k, lang in enumerate(model["langs"]):
        tree = Tree(dict(zip(counts[counts.lang == lang].code.tolist(), counts[counts.lang == lang].n.tolist())), 3)
        for i, text in enumerate(texts):
            assert got[i, k] == pytest.approx(tree.bits(text, contexts), abs=0.001 * len(text) + 1e-9)


@pytest.mark.parametrize("bounds", [{}, {"ngrams": 400, "states": 60}])
def test_a_language_is_learned_alike_beside_others(make_docs, bounds):
    rare = [(i, f"ziz zuzu zaz {'zyz' * (i % 5)} zezo{i}", "zz") for i in range(1, 9)]
    often = [(i, f"the quick brown fox {i} jumps over lazy dogs, number {i * i}", "en") for i in range(100, 500)]
    texts = [b"zuzu zaz zezo7 zyzzyz", b"the quick zebra", b"123 jumps"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    alone, beside = learn(make_docs(rare), **bounds), learn(make_docs(rare + often), **bounds)
    assert beside["langs"] == ["en", "zz"]
    assert code_lengths(beside, data, offsets)[:, 1].tolist() == code_lengths(alone, data, offsets)[:, 0].tolist()


def test_strings_seen_once_count(make_docs):
    docs = make_docs([(i, t, "xx") for i, t in enumerate(["abracadabra abra", "kadabra baobab", "xylo"], 1)])
    model, counts = learn(docs), count_ngrams(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").select("lang", "text"), 4).toPandas()
    assert (counts.n == 1).any()
    contexts = {c.to_bytes((c.bit_length() + 7) // 8, "big")[1:] for c in counts["code"] if c < 1 << 33}
    text = b"abracadabra xylo kad"
    got = code_lengths(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0, 0]
    assert got == pytest.approx(Tree(dict(zip(counts.code.tolist(), counts.n.tolist())), 4).bits(text, contexts), abs=0.001 * len(text))
