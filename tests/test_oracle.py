"""Every registered query against its DuckDB oracle on the smallest tables."""
import pytest

import __spark_entry__ as E
from fleetlens import registry
from fleetlens.checks.compare import compare, duck
from conftest import SF_SMALL

# the training-data queries have tests of their own in tests/llm
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL, con)
    assert r["cols"], (r["spark_cols"], r["duck_cols"])
    assert r["rows"][0] == r["rows"][1]
    assert r["values"], r["detail"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "avg_executors_per_job" in df.columns
