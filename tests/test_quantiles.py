from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.operators import quantiles as Q

PROBS = [0.0, 0.005, 0.25, 0.5, 0.9, 1.0]


def by_definition(values, p, mode):
    v = sorted(x for x in values if x is not None)
    if not v:
        return None
    if mode == "rank":
        k = math.ceil(Fraction(str(p)) * len(v)) - 1
        return v[k] if k >= 0 else None
    h = (len(v) - 1) * p
    k = math.floor(h)
    return float(v[k]) if h == k else v[k] + (h - k) * (float(v[k + 1]) - v[k])


def check(spark, rows, schema, mode, bins):
    df = spark.createDataFrame(rows, schema).repartition(4)
    probs = PROBS[mode == "rank":]
    got = Q.quantile_long(df, ["a", "b"], probs, ["k"], mode, bins).collect()
    groups = defaultdict(lambda: ([], []))
    for k, a, b in rows:
        groups[k][0].append(a)
        groups[k][1].append(b)
    assert len(got) == len(groups) * 2 * len(probs)
    for r in got:
        values = groups[r.k][r._ci]
        want = by_definition(values, probs[r._pi], mode)
        assert r.n == sum(x is not None for x in values)
        assert r.value == (pytest.approx(want, rel=1e-15) if mode == "cont" and want is not None else want)


@pytest.mark.parametrize("mode", ["cont", "rank"])
@pytest.mark.parametrize("bins", [2, 64, None])
def test_doubles(spark, mode, bins):
    """Every range is narrowed to single values, also with two parts a round."""
    r = np.random.default_rng(4)
    wide = np.exp(r.normal(size=500) * 60) * r.choice([-1, 1], 500)
    near = 1 + r.integers(0, 40, 500) * 2.0**-52           # neighbouring doubles
    rows = [("x", float(a), float(b)) for a, b in zip(wide, near)]
    rows += [("y", float(a), None) for a in r.integers(-3, 3, 300)] + [(None, 5e-324 * i, -0.0) for i in range(40)]
    rows += [("z", None, None), ("one", 1e308, -1e308), ("inf", math.inf, -math.inf), ("inf", 1.0, 2.0), ("inf", -math.inf, math.inf)]
    check(spark, [x for x in rows if mode == "rank" or x[0] != "inf"], "k string, a double, b double", mode, bins)


@pytest.mark.parametrize("mode", ["cont", "rank"])
def test_integers_beyond_doubles(spark, mode):
    r = np.random.default_rng(5)
    rows = [("x", int(2**62 + i), int(i) - 30) for i in r.integers(0, 60, 300)] + [("x", -2**63, 2**63 - 1)]
    if mode == "rank":
        check(spark, rows, "k string, a long, b long", mode, 4)
    else:
        check(spark, [(k, a % 1000, b % 1000) for k, a, b in rows], "k string, a long, b long", mode, 4)


def test_no_group_and_empty_table(spark):
    df = spark.range(1001).withColumn("v", F.col("id") * 1.5)
    assert Q.quantiles_wide(df, ["v"], [0.5, 0.9]).first() == (750.0, 1350.0)
    assert Q.quantiles_wide(df.limit(0), ["v"], [0.5]).first() == (None,)
    with pytest.raises(ValueError):
        Q.quantile_long(df, ["v"], [0.0], mode="rank")
    assert Q.quantiles_wide(df.limit(0).withColumn("k", F.lit(1)), ["v"], [0.5], ["k"]).collect() == []


def test_bins_increase_with_the_value(spark):
    r = np.random.default_rng(6)
    v = sorted({*map(float, np.exp(r.normal(size=3000) * 200)), 0.0, 5e-324, 1.7e308, *(2.0**k for k in range(-1074, 1024, 7)),
                *(math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 7))})
    v = [x for x in v if math.isfinite(x)]
    got = [x._bin for x in spark.createDataFrame([(i, x) for i, x in enumerate([-x for x in reversed(v)] + v)], "i int, x double")
           .orderBy("i").select(Q._log_bin(F.col("x")).alias("_bin")).collect()]
    assert got == sorted(got)


def test_hot_group_is_ordered_by_bins_only(spark):
    """The ordered tables of a round hold at most bins + 1 rows a group."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), F.rand(3).alias("v"))
    seen = []
    original = Q._before
    try:
        Q._before = lambda keys, order: seen.append(keys) or original(keys, order)
        got = Q.quantile_long(df, ["v"], [0.5], ["k"], bins=100).collect()
    finally:
        Q._before = original
    assert len(seen) >= 3 and got[0].value == pytest.approx(df.selectExpr("percentile(v, 0.5)").first()[0], rel=1e-14)
