"""Layer 1: every catalogue query with oracle SQL equals DuckDB on the small tables."""

from __future__ import annotations

import pytest

from conftest import SF_MID, SF_SMALL
from oracle_harness import compare, duck

from sparkwright.plans.catalog import REGISTRY

ORACLE = sorted(n for n, (_f, sql) in REGISTRY.items() if sql)


# Held-out bounds need more than the 22 labelled test rows of the smallest tables.
MIDDLE = {"r_review_text"}


@pytest.fixture(scope="module")
def con():
    return {d: duck(d) for d in (SF_SMALL, SF_MID)}


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_duckdb(spark, con, name):
    fn, sql = REGISTRY[name]
    d = SF_MID if name in MIDDLE else SF_SMALL
    r = compare(spark, con[d], name, fn, sql, d)
    assert r["status"] == "ok", r


def test_every_query_has_a_docstring():
    for name, (fn, _sql) in REGISTRY.items():
        assert fn.__doc__, name
