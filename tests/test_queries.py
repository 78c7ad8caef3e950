"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck

from vecloom import plans

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, con, name):
    if name not in plans.SQL:
        plans.QUERIES[name](spark, SF_DIR).count()
        return
    result = compare(spark, con, plans.QUERIES[name], plans.SQL[name], SF_DIR)
    assert result in (None, "no rows")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
