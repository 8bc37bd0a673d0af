"""Every registered query against its SQL, whole results, on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from costweave.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf_dir, connection):
    assert compare(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) == ""


def test_only_ordination_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"pcoa_axes", "ordination_costs"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["time", "kind", "cost"]
    assert df.count() == 14
