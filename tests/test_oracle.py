"""Every registered query against its SQL in DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle_compare as oc
from hostlake.checks.base import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oc.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    sql = entry.oracle_sql().get(name)
    assert sql is not None
    assert oc.compare(spark, con, SF, entry.queries()[name], sql) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
