"""Every registered query with an oracle agrees with DuckDB on sf0.001."""

import pytest

from tests.oracle_check import compare, duck
from tests.conftest import SF001

from quillrank.plans import load_all

REG = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(REG.ORACLE))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, REG.QUERIES[name], REG.ORACLE[name], SF001)
    assert r["ok"], r
