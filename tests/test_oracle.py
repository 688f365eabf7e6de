"""Every registered query equals its DuckDB twin on the smallest fixture."""

import pytest

from opsight.plans.registry import oracle_sql, registry
from tests.conftest import SF_SMALL
from tools.check_oracle import compare, duck

NAMES = sorted(registry())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert len(NAMES) >= 127
    assert all(oracle_sql(n) is not None for n in NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = registry()[name].build(spark, SF_SMALL)
    sql = oracle_sql(name).replace("/root/testdata/sf0.01/", SF_SMALL + "/")
    assert compare(name, df, con, sql, verbose=True)
