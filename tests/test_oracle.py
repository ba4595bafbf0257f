"""Every registered query against its DuckDB oracle (exact values)."""

import pytest

import __spark_entry__ as se
from nimbus.plans import catalog, oracle
from tests.oracle_util import compare

ORACLE = oracle.oracle_sql()
QUERIES = catalog.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(se.queries()) and set(ORACLE) <= set(se.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, sf_dir, name):
    diff = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
    assert diff is None, f"{name}: {diff}"


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["YEAR", "MONTH"]
