"""Every registered query beside its DuckDB text on the smallest tables."""

from __future__ import annotations

import pytest
from check import compare, connect
from conftest import SMALL

from figtrail.plans import catalog

QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    status, note, _ = compare(spark, duck, name, QUERIES[name], ORACLES[name], SMALL)
    assert status == "ok", note


def test_contract():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.FLAGSHIP in entry.queries()
