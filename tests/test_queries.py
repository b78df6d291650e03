"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


def _names():
    from catalog import QUERIES

    return sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    from catalog import ORACLES, QUERIES

    if name in ORACLES:
        assert compare(spark, duck, QUERIES[name], ORACLES[name], SF_DIR) is None
    else:
        assert len(QUERIES[name](spark, SF_DIR).collect()) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_need_no_session_to_register():
    from catalog import ORACLES, QUERIES

    assert len(QUERIES) > 100
    assert set(QUERIES) == set(ORACLES)
