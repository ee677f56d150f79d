"""Every registered query against its SQL twin at the smallest scale (skipped where the data is absent)."""

import os

import pytest

from tools.check_queries import compare, connect
from vacantia.plans import registered

FOLDER = os.environ.get("VACANTIA_TEST_DATA", "/root/testdata/sf0.001")
CATALOG = registered()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CATALOG.QUERIES))
def test_query(spark, con, name):
    df = CATALOG.QUERIES[name](spark, FOLDER)
    if name in CATALOG.ORACLES:
        assert compare(df, CATALOG.ORACLES[name], con) == ""
    else:
        assert df.count() > 0
