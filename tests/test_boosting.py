from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkwright.operators import boosting, tune
from sparkwright.operators import features as X

SPACE = {"stepSize": ("logfloat", 0.001, 0.5), "maxDepth": ("int", 1, 5, 1), "minInstancesPerNode": ("int", 1, 30, 3)}


def _rows(spark, n):
    """A feature with ties, a constant one, one of many values and one with zeros."""
    r = np.random.default_rng(1)
    a, b, c = np.round(r.normal(size=n), 1), r.normal(size=n), r.integers(0, 3, n)
    y = a + 0.5 * b + (c == 2) + r.normal(size=n) > 0.4
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), float(y[i]), i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label double, fold int").withColumn("k", F.lit(2.0))
    return X.assemble(["a", "k", "b", "c"]).transform(df).cache()


@pytest.fixture(scope="module")
def points(spark):
    return _rows(spark, 600)


def _build(p):
    return GBTClassifier(seed=7, **p)


def _search(data, n_trials=6):
    return tune.halving_search(_build, SPACE, data, "fold", n_trials=n_trials, least=2, most=6, seed=4)


def test_boosted_draws_equal_a_fit_each(points, monkeypatch):
    """The same scores and winner as a fit per draw and fold, without those fits."""
    with monkeypatch.context() as m:
        m.setattr(boosting, "settings", lambda *_: None)
        each = _search(points)
    monkeypatch.setattr(GBTClassifier, "fit", None)
    got = _search(points)
    assert got[0] == each[0]
    assert [r[:4] + r[5:] for r in got[2]] == [r[:4] + r[5:] for r in each[2]]
    assert [r[4] for r in got[2]] == pytest.approx([r[4] for r in each[2]], abs=1e-9)


def test_margins_equal_those_of_the_estimator(points, monkeypatch):
    """Also over several partitions, batches of models and checkpoints."""
    monkeypatch.setattr(boosting, "ROWS", 100)
    monkeypatch.setattr(boosting, "CELLS", 900)
    monkeypatch.setattr(boosting, "LINEAGE", 2)
    fits = [(GBTClassifier(seed=7, maxIter=n, stepSize=0.3, maxDepth=d, minInstancesPerNode=k), f) for n, d, k, f in ((5, 3, 10, 0), (2, 5, 1, 1), (1, 0, 1, 2))]
    t = boosting.together(points, "features", "label", "fold", 32, 7)
    models = [(boosting.settings(e, "label"), f) for e, f in fits]
    assert t.data.rdd.getNumPartitions() > 1 and len(list(t._batches(models))) > 1
    got = t.scored(models, [0, 1, 2])
    for i, (e, f) in enumerate(fits):
        want = e.fit(points.where(F.col("fold") != f)).transform(points.where(F.col("fold") == f))
        want = sorted(r.z for r in want.select(vector_to_array("rawPrediction")[1].alias("z")).collect())
        assert sorted(r[f"z{i}"] for r in got.where(F.col("fold") == f).collect()) == pytest.approx(want, abs=1e-9)
        assert got.where((F.col("fold") != f) & F.col(f"z{i}").isNotNull()).count() == 0


def test_jobs_do_not_grow_with_draws(points, spark):
    t = boosting.together(points, "features", "label", "fold", 32, 7)
    sc = spark.sparkContext

    def jobs(many):
        sc.setJobGroup(f"boost-{many}", "")
        try:
            trees = t.fit([(boosting.Settings(3, 0.1, 2, 5 + i, 0.0, 32, 7), 0) for i in range(many)])
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert [len(x) for x in trees] == [3] * many
        return len(sc.statusTracker().getJobIdsForGroup(f"boost-{many}"))

    jobs(1)     # takes the thresholds
    assert jobs(20) == jobs(2) <= 3 * 2


def test_many_rows_take_thresholds_from_a_sample(spark, monkeypatch):
    """More rows than the estimator takes thresholds from: another sample, about the same score."""
    data = _rows(spark, 3000)
    monkeypatch.setattr(boosting, "SAMPLE", 500)
    e = GBTClassifier(seed=7, maxIter=5, maxDepth=3)
    t = boosting.together(data, "features", "label", "fold", 16, 7)
    z = t.scored([(boosting.settings(e, "label"), 0)], [0]).where("fold = 0")
    assert all(0 < len(c) <= 15 for c in (t.cuts[0][0], t.cuts[0][2])) and len(t.cuts[0][1]) == 0
    got = tune.BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="z0").evaluate(z)
    want = tune.BinaryClassificationEvaluator().evaluate(e.fit(data.where("fold != 0")).transform(data.where("fold = 0")))
    assert got == pytest.approx(want, abs=0.02)


def test_rows_and_estimators_that_are_not_fitted_together(points):
    ok = lambda df, f="features": boosting.together(df, f, "label", "fold", 32, 7) is not None
    assert ok(points)
    assert not ok(points.withColumn("label", F.when(F.col("id") != 3, F.col("label"))))
    assert not ok(points.withColumn("label", F.col("label") + F.col("fold")))
    assert not ok(points.withColumn("fold", F.lit(1)))
    assert not ok(points.withColumn("fold", F.when(F.col("id") != 3, F.col("fold"))))
    assert not ok(points.withColumn("fold", F.col("fold") / 2))
    assert not ok(points.limit(0))
    nan = points.drop("features").withColumn("a", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("a")))
    assert not ok(X.assemble(["a", "b"]).setHandleInvalid("keep").transform(nan))
    assert boosting.settings(GBTClassifier(subsamplingRate=0.5), "label") is None
    assert boosting.settings(GBTClassifier(featureSubsetStrategy="sqrt"), "label") is None
    assert boosting.settings(GBTClassifier(maxDepth=11), "label") is None
    assert boosting.settings(GBTClassifier(maxIter=3, stepSize=0.2), "label").rounds == 3
