"""Every registered query against its SQL on the smallest tables."""

import pytest

from noticegrid.plans.registry import load_all
from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, QUERIES[name], SF)
    assert result["ok"] in (True, None), result["detail"]
