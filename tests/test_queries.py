"""Every registered query with SQL against it, on the smallest tables."""

from pathlib import Path

import pytest
from compare import compare, connect

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(e.queries()) & set(e.oracle_sql())))
def test_query(spark, con, name):
    said = compare(spark, con, name, e.queries()[name], e.oracle_sql()[name], SF)
    assert said.startswith("ok") and "types" not in said


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["key", "lsn"] and df.count() > 0
