"""Every registered query with oracle SQL matches DuckDB exactly (names,
types, row count, order-insensitive values) on the smallest tables."""

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_harness import compare, duck_connect
from tidemark.plans.catalog import CATALOG

ORACLE = sorted(n for n, s in CATALOG.items() if s.sql)


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", ORACLE)
def test_matches_oracle(spark, con, name):
    spec = CATALOG[name]
    r = compare(spark, con, name, spec.build, spec.sql, SF_SMALL)
    assert r.get("ok"), r


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "monthly_sales" in e.oracle_sql()
