"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# The queries of the data subpackage have their own tests.
@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, con, name):
    frame = entry.QUERIES[name](spark, SF)
    assert difference(frame, con, entry.ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
