import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mercata.session import get_session

    session = get_session(app="mercata-tests", master="local[4]", shuffle_partitions=4)
    yield session


@pytest.fixture(scope="session")
def fixture_tables(spark):
    from mercata.sources import marketplace_from_testdata

    return marketplace_from_testdata(spark, SF_SMALL)


def make_table(spark, name, rows):
    """A marketplace table from dicts; absent columns are NULL."""
    from mercata.schemas import SCHEMAS

    schema = SCHEMAS[name]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


@pytest.fixture
def mk(spark):
    def build(**tables):
        return {name: make_table(spark, name, rows) for name, rows in tables.items()}

    return build
