import pytest

SF = "/root/testdata/sf0.001"

#: Names that operators use inside; as extra columns they must not matter.
CLASHING = (
    "digest keep_id group_size kept copies copy least size key target taken bucket start end words rest epochs source_size of "
    "signature set_key rep token holders component vertex n_shingles a b anchor phrase starts row_key few many first last shard "
    "h chance label x ids decoded n_tokens lang_pred score held_out spans mix_id text_hash kept_id lo hi n"
).split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text[, lang[, source]]), with columns of
    clashing names beside them."""

    def build(rows):
        rows = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        return df.selectExpr("*", *[f"'?' AS `{c}`" for c in CLASHING])

    return build


EDGE_TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One"), (5, "One"), (6, "a b c d"), (7, "a b c d e"), (8, "A B C D E"), (None, "no id at all here"),
    (None, "no id at all here"), (9, "word " * 5000), (10, "é ü ß 日本語 😀"), (11, "x" * 20000), (12, "a b c d e"), (13, "12345 !!! ###"),
]


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    return make_docs([(i, t, "en" if (i or 0) % 2 else None, "s") for i, t in EDGE_TEXTS])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([(1, "x")]).limit(0)


def file_rows(table, columns, sf=SF):
    import pyarrow.parquet as pq

    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{sf}/{table}.parquet", columns=list(columns)).to_pylist()]
