"""Plan rules over every oracle-checked catalogue query (explain only, small tables)."""

from __future__ import annotations

import contextlib
import io

import pytest

from conftest import SF_SMALL

from sparkwright.plans.catalog import REGISTRY

ORACLE = sorted(n for n, (_f, sql) in REGISTRY.items() if sql)
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ORACLE)
def test_no_cross_join_and_no_python_udf(spark, name):
    fn, _sql = REGISTRY[name]
    text = plan_text(fn(spark, SF_SMALL))
    assert not [f for f in FORBIDDEN if f in text], name


def test_filter_reaches_the_scan(spark):
    text = plan_text(REGISTRY["q_isin_merge"][0](spark, SF_SMALL))
    assert "PushedFilters: [In(r_name, [ASIA,EUROPE])" in text
