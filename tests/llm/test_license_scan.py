import re

import pytest

from mercata.llm.license_scan import BASE, NOTICES, TEMPLATES, Template, license_scan, license_spans

from .conftest import EDGE_TEXTS, SF, file_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = words(text)
    places = [(i, t.label) for t in BASE for i in range(len(w)) if w[i : i + len(t.words.split())] == t.words.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def check(df, rows):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.collect()), key=repr)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=repr)


def one(spark, text, **kw):
    return license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), **kw).first()


def test_base_places_of_the_table(spark):
    check(license_scan(spark.read.parquet(f"{SF}/documents.parquet")), file_rows("documents", ("doc_id", "text")))


def test_edges(edge_docs, make_docs, no_docs):
    check(license_scan(edge_docs), [(r[0], r[1]) for r in EDGE_TEXTS])
    assert license_scan(no_docs).collect() == []
    rows = [
        (1, "MIT License"), (2, "mit"), (3, "MIT-License, (mit license)MIT\nLICENSE"), (4, "mit licenses"), (5, "xmit license"), (6, "émit license"),
        (7, "gnu general public licence; GNU general public license CC BY"), (7, "cc by cc by"), (None, "apache license"), (None, "apache license"),
        (8, "the mit license " * 20000), (9, "MIT LİCENSE mit licenKe"), (10, "cc " * 70 + "by"),
    ]
    check(license_scan(make_docs(rows).repartition(3)), rows)


def test_method_labels(spark):
    text = next(t.words for t in NOTICES if t.label == "bsd" and len(t.words) > 50)
    assert one(spark, text).labels == "bsd" and one(spark, text).score == 1.0
    w = text.split()
    changed = " ".join(w[:6] + ["also", "here"] + w[6:12] + w[13:])  # words put in, one left out: three diagonals
    row = one(spark, changed)
    assert row.labels == "bsd" and 0.75 <= row.score < 1.0 and row.base_labels == "" and row.n_base == 0
    assert one(spark, changed, gap=0).labels == ""  # no single diagonal holds enough
    assert one(spark, " ".join(w[:6])).labels == ""
    assert one(spark, " ".join(reversed(w))).labels == ""
    assert one(spark, "Released under the MIT License.").asDict() == {
        "doc_id": 1, "n_words": 5, "n_base": 1, "first_word": 3, "last_word": 3, "base_labels": "mit", "labels": "mit", "score": 1.0,
    }
    lesser = one(spark, "under the GNU Lesser General Public License, or CC-BY-SA 4.0")
    assert lesser.labels == "cc-by,cc-by-sa,lgpl" and lesser.base_labels == "cc-by"


@pytest.mark.parametrize("template", TEMPLATES, ids=lambda t: t.words[:20])
def test_templates_are_words(template):
    assert words(template.words) == template.words.split() and 1 <= len(template.grams) <= 63


def test_spans_and_own_templates(spark):
    docs = spark.createDataFrame([(5, "a b a b c"), (6, "nothing")], "doc_id long, text string")
    spans = license_spans(docs, [Template("a b", "one", True), Template("b c", "two")])
    got = sorted(((r.doc_id, r.label, r.start, r.found) for r in spans.where("template IS NOT NULL").collect()))
    assert got == [(5, "one", 0, 1), (5, "one", 2, 1), (5, "two", 3, 1)]
    assert spans.where("template IS NULL").count() == 2
    with pytest.raises(ValueError):
        license_spans(docs, [Template("single", "x")])


def test_no_python_in_the_plan(spark, capsys):
    license_scan(spark.read.parquet(f"{SF}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
