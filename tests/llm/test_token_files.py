import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mercata.llm.token_files import TokenFile, pack, read_token_files, scratch_dir, unpack, write_token_files

from .conftest import EDGE_TEXTS, SF, file_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> a<|startoftext|>b", "é é café Ça ŒUVRE", "ΑΣ ΣΑΣ", "日本語 テスト１２３", "a\x1cb \x85 x\xa0y z", "don't I'LL x's 12a3 ²³ ½ ªº", "ﬁ ﬀ İ ı ǅ", "Á ́b", "ß ẞ ſ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(spark, df, rows, library, **kw):
    index = write_token_files(df, PATH, scratch_dir(spark), **kw)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(index).collect()), key=lambda r: r[0])
    ids = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in rows]
    assert [r[1] for r in got] == sorted((i for i, _ in ids), key=lambda i: -1 if i is None else i)
    assert sorted((r[1] or -1, r[2], r[3]) for r in got) == sorted((i or -1, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    assert [r[0] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    return index


def test_table(spark, library):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"), file_rows("documents", ("doc_id", "text")), library)


def test_edges_and_odd_texts(spark, make_docs, edge_docs, library):
    check(spark, edge_docs, EDGE_TEXTS, library, block_ids=64)
    rows = list(enumerate(ODD))
    check(spark, make_docs(rows), rows, library, block_ids=8)


def test_empty_table(spark, no_docs):
    assert read_token_files(write_token_files(no_docs, PATH, scratch_dir(spark))).collect() == []


@pytest.mark.parametrize("bits", [1, 3, 7, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n)
        data = pack(ids, bits)
        assert len(data) == 8 * -(-n * bits // 64)
        assert unpack(data, bits, n).tolist() == ids.tolist()


def test_random_access(spark, library):
    rows = sorted(file_rows("documents", ("doc_id", "text")))
    index = check(spark, spark.read.parquet(f"{SF}/documents.parquet"), rows, library, block_ids=100)
    rng = np.random.default_rng(0)
    for entry in index.collect():
        if entry.n_ids:
            file = TokenFile(entry.path)
            whole = file.read(0, file.ids)
            assert file.bits == 16 and len(whole) == entry.n_ids
            for _ in range(20):
                a, b = sorted(rng.integers(0, file.ids + 1, 2).tolist())
                assert file.read(a, b).tolist() == whole[a:b].tolist()


def test_rows_without_doc_id_are_spread(spark, library):
    rows = [(None if i % 3 == 0 else i, f"row {i} of many") for i in range(6000)]
    rows += [(None, "the same row")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = check(spark, df, rows, library)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    documents = [r.documents for r in index.collect()]
    assert sum(documents) == len(rows) and max(documents) < 2 * len(rows) / len(documents)


def test_files_of_lost_attempts_do_not_count(spark, library):
    from mercata.llm.token_files import filesystem

    rows = [(i, f"text {i}") for i in range(50)]
    df, out = spark.createDataFrame(rows, "doc_id long, text string"), scratch_dir(spark)
    fs, folder = filesystem(out)
    fs.create_dir(folder, recursive=True)
    for name in ("part-000000.tok", "part-000000-0.tok"):
        with fs.open_output_stream(f"{folder}/{name}") as f:
            f.write(b"half a file")
    assert sorted(r.doc_id for r in read_token_files(write_token_files(df, PATH, out)).collect()) == list(range(50))
    # The same folder again: a new index over new files.
    assert sorted(r.doc_id for r in read_token_files(write_token_files(df.limit(7), PATH, out)).collect()) == sorted(r.doc_id for r in df.limit(7).collect())
