"""Every registered query against its SQL counterpart on the smallest tables."""

from pathlib import Path

import pytest

from workloads import check, registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert check.compare(df, duck, sql) == ""
