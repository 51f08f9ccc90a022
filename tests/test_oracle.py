"""Every SQL-checkable query equals its DuckDB statement (row count, columns, values)."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

from conftest import SF_SMALL

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF_SMALL, name, entry.queries()[name], ORACLE[name], con)
    assert res["ok"], res


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["tenure_bin", "churn_rate", "count", "tenure_bin_index"]
