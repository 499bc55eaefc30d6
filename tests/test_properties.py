"""Layer 3: properties and brute-force checks on small generated inputs."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwright.operators import metrics as E
from sparkwright.operators import split as S
from sparkwright.operators.quantiles import quantile_long, quantiles_wide


def _linear_quantile(v, p):
    v = np.sort(np.asarray(v, dtype=float))
    h = (len(v) - 1) * p
    k = int(np.floor(h))
    return v[k] if k + 1 >= len(v) else v[k] + (h - k) * (v[k + 1] - v[k])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=60),
       st.sampled_from([0.0, 0.005, 0.25, 0.5, 0.9, 1.0]))
def test_quantile_matches_linear_interpolation_with_ties(spark, vals, p):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = quantiles_wide(df, ["x"], [p], names=["q"]).first()["x_q"]
    assert got == pytest.approx(_linear_quantile(vals, p))


def test_quantile_large_group_few_bins(spark, monkeypatch):
    # far fewer bins than values: the ranges are narrowed over several rounds
    monkeypatch.setattr("sparkwright.operators.quantiles.BINS", 10)
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=5000), 3)
    df = spark.createDataFrame([("g", float(v)) for v in vals] + [("h", 1.0)], "k string, x double")
    out = {r.k: r for r in quantiles_wide(df, ["x"], [0.01, 0.5, 0.99], ["k"]).collect()}
    for p, name in [(0.01, "x_q01"), (0.5, "x_q5"), (0.99, "x_q99")]:
        assert out["g"][name] == pytest.approx(_linear_quantile(vals, p))
        assert out["h"][name] == 1.0


def test_rank_mode_position(spark):
    vals = [5, 1, 4, 2, 3, 9, 8, 7, 6, 10, 11]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = quantile_long(df, ["x"], [0.1], mode="rank").first()
    assert (r.value, r.value_prev) == (2.0, 1.0)       # ceil(1.1) = 2nd smallest
    ten = spark.createDataFrame([(float(v),) for v in range(1, 11)] + [(None,)], "x double")
    r = quantile_long(ten, ["x"], [0.1], mode="rank").first()
    assert (r.n, r.value, r.value_prev) == (10, 1.0, None)   # ceil(0.1 * 10) = 1 exactly


def test_running_sum_matches_cumsum(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 5, size=300)
    df = spark.createDataFrame([(float(i), int(x)) for i, x in enumerate(v)], "k double, c long")
    out = E.running_sum(df, "k", ["c"], descending=False, partitions=7).orderBy("k").collect()
    assert [r.c_cum for r in out] == list(np.cumsum(v))


def test_auc_equals_pairwise_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, size=200)
    s = np.round(rng.random(200) + 0.3 * y, 1)          # rounded: many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    got = E.auc(df, "y", "s").first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert got == pytest.approx(brute)


def test_confusion_and_scores_brute_force(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, size=150)
    s = rng.random(150)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    r = E.classification_scores(df, "y", "s", 0.4).first()
    p = (s > 0.4).astype(int)
    tp, fp = int(((y == 1) & (p == 1)).sum()), int(((y == 0) & (p == 1)).sum())
    fn, tn = int(((y == 1) & (p == 0)).sum()), int(((y == 0) & (p == 0)).sum())
    assert r.accuracy == pytest.approx((tp + tn) / 150)
    assert r.precision == pytest.approx(tp / (tp + fp)) and r.recall == pytest.approx(tp / (tp + fn))
    cells = {(c.label, c.pred): c.n for c in E.confusion(df, "y", "s", 0.4).collect()}
    assert cells == {(1, 1): tp, (0, 1): fp, (0, 0): tn, (1, 0): fn}


def test_regression_scores_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=100)
    p = y + rng.normal(scale=0.3, size=100)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    r = E.regression_scores(df, "y", "p").first()
    sse = float(((y - p) ** 2).sum())
    assert r.r2 == pytest.approx(1 - sse / float(((y - y.mean()) ** 2).sum()))
    assert r.rmse == pytest.approx((sse / 100) ** 0.5) and r.mae == pytest.approx(float(np.abs(y - p).mean()))


def test_split_is_a_partition_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    parts = S.split_random(df, "k", [0.7, 0.3], seed=1)
    a, b = [set(r.k for r in p.collect()) for p in parts]
    assert not (a & b) and len(a | b) == 1000 and 600 < len(a) < 800
    again = S.split_random(df.repartition(7), "k", [0.7, 0.3], seed=1)[0]
    assert set(r.k for r in again.collect()) == a


def test_stratified_folds_balance(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(500)], "k long, y int")
    f = S.stratified_folds(df, "k", "y", 5)
    counts = {(r.fold, r.y): r.n for r in f.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(counts[(i, 1)] == 10 for i in range(5)) and all(counts[(i, 0)] == 90 for i in range(5))


def test_variance_selector_matches_declarative_rule(spark):
    from sparkwright.operators.features import assemble, variance_select
    df = spark.createDataFrame([(float(i), float(i % 2) * 0.01, 3.0) for i in range(50)], "a double, b double, c double")
    v = assemble(["a", "b", "c"], "v").transform(df)
    m = variance_select("v", "s", 0.001).fit(v)
    var = df.agg(*[F.var_samp(c).alias(c) for c in "abc"]).first()
    assert list(m.selectedFeatures) == [i for i, c in enumerate("abc") if var[c] > 0.001]
