"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences
from workload import oracle
from workload.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) == set(oracle.oracle_sql())
    assert set(all_queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, db, name):
    assert differences(spark, db, SF_DIR, name)[:3] == []


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == [
        "date", "sst_celsius", "is_interpolated", "climatology_celsius", "anomaly_celsius",
    ]
    assert frame.count() > 0
