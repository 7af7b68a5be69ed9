"""Registered queries: all there, contract columns, equal to their SQL."""

import duckdb
import pytest

from .conftest import SF

COLUMNS = {
    "op1": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op2": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op4": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op8": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9": {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in ("email", "ip", "card", "phone")}, "base_sha256": "string", "spans": "string"},
    "op10": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op11": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12": {"doc_id": "bigint", **{c: "bigint" for c in ("n_words", "n_base", "first_word", "last_word")}, "base_labels": "string", "labels": "string", "score": "double"},
    "op13": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
}


def registered():
    from __spark_entry__ import oracle_sql, queries

    return queries(), oracle_sql()


def test_all_are_registered():
    found, _ = registered()
    assert {n.split("_")[0] for n in found if n.split("_")[0] in COLUMNS} == set(COLUMNS)
    assert "pipeline" in found


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_top_k", "op6_minhash_dedup", "op7_substring_dedup", "op11_lexical_search", "op12_license_scan", "op13_vector_code"])
def test_query_equals_sql(spark, name):
    found, sql = registered()
    df = found[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    result = con.execute(sql[name])
    columns = [c[0] for c in result.description]
    assert dict(df.dtypes) == COLUMNS[name.split("_")[0]]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, result.fetchall()))


@pytest.mark.parametrize("number", ["op2", "op3", "op5", "op8", "op9", "op10"])
def test_contract_columns_and_rows(spark, number):
    found, _ = registered()
    name = next(n for n in found if n.startswith(f"{number}_"))
    df = found[name](spark, SF)
    assert dict(df.dtypes) == COLUMNS[number]
    table = "pages" if number == "op2" else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
