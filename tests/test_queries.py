"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from attest.plans.catalogue import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    line = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert not line.startswith("FAIL"), line
