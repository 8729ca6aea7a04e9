"""Every query with SQL text gives the same rows as the SQL on the smallest tables; the others run and give rows."""

from __future__ import annotations

import pytest
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SLOW: set[str] = set()


def names():
    from tidemark.plans import QUERIES, load

    load()
    return sorted(set(QUERIES) - SLOW)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from tidemark.plans import ORACLES, QUERIES

    result = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert result.startswith(("ok", "rows-only")), result


def test_oracles_belong_to_queries():
    from tidemark.plans import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
