from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from sparkwright.operators import folds, models, paths, split, tune
from sparkwright.operators import features as X


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 4)) * [1, 2, 0.5, 1] + [0, 3, 0, -1]
    y = (x @ [1.5, -1.0, 0.0, 0.7] + 2.5 + r.logistic(size=400) > 0).astype(float)
    rows = [(i, *map(float, a), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, label double, fold int").repartition(3).cache()


@pytest.mark.parametrize("elastic", [0.0, 0.5, 1.0])
def test_path_equals_separate_fits(points, elastic):
    names, cs = ["a", "b", "c", "d"], [1e-3, 0.05, 1.0, 100.0]
    path = paths.logit_path(points, names, "label", cs, elastic, "fold")
    assert path.coefficients.shape == (4, 4, 5) and path.passes < 40
    data = X.assemble(names).transform(points)
    for f, keep in ((0, F.col("fold") != 0), (3, F.lit(True))):
        part = data.where(keep).cache()
        n = part.count()
        for i, c in enumerate(cs):
            m = LogisticRegression(regParam=models.reg_param_for_c(c, n), elasticNetParam=elastic, standardization=False,
                                   maxIter=1000, tol=1e-12).fit(part)
            assert path.coefficients[f, i] == pytest.approx([*m.coefficients.toArray(), m.intercept], abs=2e-4)
            if f == 0:
                out = m.transform(data.where("fold = 0"))
                share = out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
                assert path.accuracy[0, i] == pytest.approx(share, abs=0.01)


def test_path_is_a_minimum(points):
    """No coefficient can be moved without raising the penalised loss."""
    names = ["a", "b", "c", "d"]
    path = paths.logit_path(points, names, "label", [0.02], 1.0)
    rows = points.collect()
    x = np.array([[r[n] for n in names] + [1.0] for r in rows])
    y = np.array([r.label for r in rows])
    b = path.coefficients[-1, 0]
    cost = lambda v: np.logaddexp(0, x @ v).sum() - y @ (x @ v) + np.abs(v[:-1]).sum() / 0.02
    for j in range(5):
        for e in (1e-4, -1e-4):
            assert cost(b + e * np.eye(5)[j]) >= cost(b) - 1e-9
    assert (b == 0).any()


@pytest.mark.parametrize(("elastic", "standardise"), [(0.0, True), (1.0, True), (0.0, False)])
def test_a_grid_of_strengths_is_fitted_together(points, monkeypatch, elastic, standardise):
    """The same scores and best model as a fit per strength and fold, without those fits."""
    data = X.assemble(["a", "b", "c", "d"]).transform(points)
    lr = LogisticRegression(labelCol="label", elasticNetParam=elastic, standardization=standardise)
    regs = [0.2, 0.05, 0.001]
    ev = BinaryClassificationEvaluator(labelCol="label")
    each = CrossValidator(estimator=lr, evaluator=ev, numFolds=3, foldCol="fold",
                          estimatorParamMaps=[{lr.regParam: r} for r in regs]).fit(data)
    monkeypatch.setattr(tune, "CrossValidator", None)
    got = tune.grid_cv(lr, {lr.regParam: regs}, data, "fold", parallelism=3)
    assert got.avgMetrics == pytest.approx(each.avgMetrics, abs=1e-3)
    assert got.stdMetrics == pytest.approx(each.stdMetrics, abs=1e-3)
    assert got.bestModel.getRegParam() == regs[int(np.argmax(got.avgMetrics))] == each.bestModel.getRegParam()
    assert got.bestModel.coefficients.toArray() == pytest.approx(each.bestModel.coefficients.toArray(), abs=1e-3)


def test_margins_equal_those_of_a_fit_per_fold(points):
    data = X.assemble(["a", "b", "c", "d"]).transform(points)
    for elastic, standardise in ((0.0, True), (0.0, False)):
        rows = paths.held_out_margins(data, "features", "label", [0.05, 0.002], elastic, "fold", 3, standardise).where("fold = 1").collect()
        assert len(rows) == data.where("fold = 1").count()
        for i, reg in enumerate([0.05, 0.002]):
            m = LogisticRegression(regParam=reg, elasticNetParam=elastic, standardization=standardise).fit(data.where("fold != 1"))
            want = sorted(r.m for r in m.transform(data.where("fold = 1")).select(vector_to_array("rawPrediction")[1].alias("m")).collect())
            assert sorted(r[f"z{i}"] for r in rows) == pytest.approx(want, abs=1e-2)


def test_margins_are_refused_where_a_fit_does_more(points):
    data = X.assemble(["a", "b"]).transform(points)
    margins = lambda df, f="features", regs=(0.1,): paths.held_out_margins(df, f, "label", regs, 0.0, "fold", 3)
    assert margins(data) is not None
    assert margins(data.withColumn("label", F.col("label") + F.col("id") % 2)) is None                       # three classes
    assert margins(data.withColumn("label", F.when(F.col("id") != 3, F.col("label")))) is None               # a null label
    assert margins(data.withColumn("label", F.when(F.col("fold") == 0, F.col("label")).otherwise(0.0))) is None   # one class without fold 0
    assert margins(data.withColumn("fold", F.col("fold") * 2)) is None                                       # a fold of no rows, one out of range
    assert margins(data, regs=(0.1, 0.0)) is None                                                            # no penalty: no minimum where classes part
    assert margins(X.assemble(["a", "k"]).transform(points.withColumn("k", F.lit(1.0)))) is None             # a constant feature
    assert margins(data.limit(0)) is None


def test_jobs_do_not_grow_with_strengths(points):
    names = ["a", "b"]
    few = paths.logit_path(points, names, "label", [0.1, 1.0], 0.0, "fold").passes
    many = paths.logit_path(points, names, "label", list(np.geomspace(0.1, 1.0, 30)), 0.0, "fold").passes
    assert many <= few + 2


def test_path_refuses_nulls_and_no_rows(points, spark):
    with pytest.raises(ValueError):
        paths.logit_path(points.withColumn("a", F.when(F.col("id") != 3, F.col("a"))), ["a"], "label", [1.0])
    with pytest.raises(ValueError):
        paths.logit_path(points.limit(0), ["a"], "label", [1.0])


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(900):
        day = datetime.datetime(2010, 1, 1) + datetime.timedelta(days=int(r.integers(0, 6 * 365)))
        a = float(r.normal())
        rows.append((i, day.year, day, a, float(r.normal()), float(a + r.normal() * 0.5 > 0)))
    rows.append((900, 2012, datetime.datetime(2012, 3, 1), 0.0, 0.0, None))
    return folds.written_by_year(spark.createDataFrame(rows, "id int, yr int, day timestamp_ntz, a double, b double, label double"), "yr")


def _fit(train):
    return PipelineModel([X.assemble(["a", "b"]), GBTClassifier(maxIter=3, maxDepth=2, seed=7).fit(X.assemble(["a", "b"]).transform(train))])


@pytest.mark.parametrize("mode, months, embargo", [("expanding", 12, 6), ("rolling", 6, 0)])
def test_folds_equal_fits_done_by_hand(panel, mode, months, embargo):
    plan = split.walk_forward_plan(range(2010, 2016), mode, n_folds=3)
    got = folds.walk_forward_fits(panel, "yr", "day", plan, _fit, "label", mode, embargo, months, width=3).orderBy("fold").collect()
    assert [(r.valid_year, r.first_train_year, r.last_train_year) for r in got] == [(v, min(t), max(t)) for v, t in plan]
    rows = panel.where("label is not null").collect()
    for r in got:
        start = datetime.datetime(r.valid_year - (embargo > 0), 12 - embargo + 1 if embargo else 1, 1)
        mine = [x for x in rows if r.first_train_year <= x.yr <= r.last_train_year and (not embargo or x.day < start)]
        held = [x for x in rows if x.yr == r.valid_year and x.day.month <= months]
        assert (r.n_train, r.n_valid, r.tp + r.fp + r.fn + r.tn) == (len(mine), len(held), len(held))
    v, t = plan[0]
    train = folds.train_part(panel.where("label is not null"), folds.Fold(0, v, tuple(t)), "yr", "day", embargo)
    scored = _fit(train).transform(folds.valid_part(panel.where("label is not null"), folds.Fold(0, v, tuple(t)), "yr", "day", months)).collect()
    pairs = [(a.probability[1], b.probability[1]) for a in scored if a.label == 1 for b in scored if b.label == 0]
    assert got[0].auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    assert got[0].tp == sum(x.label == 1 and x.prediction == 1 for x in scored)
    assert got[0].auc > 0.7


def test_fold_reads_its_years_only(panel):
    plan = folds.train_part(panel, folds.Fold(0, 2014, (2012, 2013)), "yr", "day")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yr" in plan or "PartitionFilters: [yr" in plan


def test_fold_with_one_class(panel):
    got = folds.walk_forward_fits(panel.where("label = 1"), "yr", "day", [(2013, [2011, 2012])], _fit, "label").collect()
    assert got[0].auc is None and got[0].tp is None and got[0].n_valid > 0


def test_studies_share_fits_of_the_same_rows(panel):
    plans = {mode: split.walk_forward_plan(range(2010, 2016), mode, n_folds=3) for mode in ("expanding", "rolling")}
    studies = [("half", plans["expanding"], 6), ("expanding", plans["expanding"], 12), ("rolling", plans["rolling"], 12)]
    fits = []
    got = folds.walk_forward_studies(panel, "yr", "day", studies, lambda t: fits.append(1) or _fit(t), "label").collect()
    alone = [folds.walk_forward_fits(panel, "yr", "day", plan, _fit, "label", mode, valid_months=months).collect() for mode, plan, months in studies]
    assert got == [r for rows in alone for r in rows]
    assert len(fits) == len({(v, tuple(t)) for plan in plans.values() for v, t in plan}) < sum(len(p) for _, p, _ in studies)
