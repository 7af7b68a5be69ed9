"""Every registered query equals its DuckDB oracle on the sf0.001 tables."""

import hashlib
import math

import duckdb
import pytest

from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


#: Spark's type names as DuckDB's.
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keys = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keys).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _names():
    """Queries with SQL of this part; those of the corpus operators are tested in tests/llm."""
    from __spark_entry__ import _REPORTS

    return list(_REPORTS)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = oracle_sql()[name]
    res = duck.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == {d[0]: str(d[1]) for d in res.description}
    assert len(rows) == len(orows)
    assert _digest(rows, df.columns) == _digest(orows, ocols)


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["segment", "customers", "pct_customers"]
    again = entry(spark)
    assert again.schema == df.schema
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
