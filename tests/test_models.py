"""Value checks of fits: score equations, closed forms, held-out bounds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import classification as MC
from pyspark.sql import functions as F

from sparkwright.operators import features as X
from sparkwright.operators import metrics as E
from sparkwright.operators import models as M
from sparkwright.operators import stats as ST
from sparkwright.operators import tune as TU

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    z = 1.5 * x[:, 0] - x[:, 1] + 0.3
    y = (rng.random(600) < 1 / (1 + np.exp(-z))).astype(float)
    r = 2 * x[:, 0] - 3 * x[:, 1] + 0.5 + rng.normal(size=600)
    return x, y, r


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y, r = data
    rows = [(i, *map(float, v), float(t), float(q), i % 4) for i, (v, t, q) in enumerate(zip(x, y, r))]
    return spark.createDataFrame(rows, "doc_id long, a double, b double, c double, label double, r double, fold int").cache()


def probabilities(p):
    return np.array([v.p1 for v in M.positive_prob_col(p, out="p1").orderBy("doc_id").select("p1").collect()])


def test_logit_score_equations(frame, data):
    x, y, _ = data
    _m, p = M.logit(frame, COLS, "label")
    gap = y - probabilities(p)
    assert abs(gap.mean()) < 1e-4 and np.abs(x.T @ gap / len(y)).max() < 1e-4
    _m, p = M.logit(frame, COLS, "label", intercept=False)
    assert np.abs(x.T @ (y - probabilities(p)) / len(y)).max() < 1e-4


def test_penalties_shrink(frame):
    size = lambda m: float(np.abs(m.coefficients.toArray()).sum())
    free = size(M.logit(frame, COLS, "label")[0])
    assert size(M.logit(frame, COLS, "label", reg=0.1)[0]) < free
    assert np.count_nonzero(M.logit(frame, COLS, "label", reg=0.12, elastic=1.0)[0].coefficients.toArray()) < 3
    assert TU.c_path(10)[0] == pytest.approx(1e-4) and TU.c_path(10)[-1] == pytest.approx(1e4)


def test_ols_equals_the_normal_equations(frame, data):
    x, _, r = data
    a = np.column_stack([x, np.ones(len(x))])
    coef = np.linalg.solve(a.T @ a, a.T @ r)
    left = r - a @ coef
    err = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (left @ left) / (len(r) - 4))
    rows = {t.feature: t for t in ST.ols(frame, COLS, "r").collect()}
    for k, name in enumerate([*COLS, "intercept"]):
        assert rows[name].coef == pytest.approx(coef[k], abs=1e-8)
        assert rows[name].std_err == pytest.approx(err[k], abs=1e-8)


def test_gaussian_glm_equals_ols_and_binomial_equals_logit(spark, frame):
    ols = {t.feature: t.coef for t in ST.ols(frame, COLS, "r").collect()}
    glm = ST.glm(frame, COLS, "r", "gaussian")
    assert glm.coefficients.toArray() == pytest.approx([ols[c] for c in COLS], abs=1e-6)
    logit = M.logit(frame, COLS, "label")[0].coefficients.toArray()
    assert ST.glm(frame, COLS, "label", "binomial").coefficients.toArray() == pytest.approx(logit, abs=1e-3)


def test_odds_are_exponentials(spark, frame):
    m, _ = M.logit(frame, COLS, "label")
    for r in ST.odds_table(m, COLS, spark).collect():
        assert r.odds_ratio == pytest.approx(np.exp(r.coef)) and r.pct_change == pytest.approx(100 * (np.exp(r.coef) - 1))


def test_backward_elimination_drops_noise(frame):
    assert set(ST.backward_eliminate(frame, COLS, "label")) >= {"a", "b"}
    assert "a" in ST.backward_eliminate(frame.withColumn("c", F.rand(1)), COLS, "label")


def test_vif_of_collinear_columns_is_infinite(frame):
    got = {r.feature: r.vif for r in ST.vif(frame.withColumns({"d": F.col("a") + F.col("b"), "k": F.lit(1.0)}), [*COLS, "d", "k"]).collect()}
    assert got["a"] == got["b"] == got["d"] == got["k"] == float("inf") and 1 <= got["c"] < 1.1


LEARNERS = {
    "forest": lambda t: M.random_forest(t, COLS, "label", trees=30)[0],
    "tree": lambda t: M.decision_tree(t, COLS, "label")[0],
    "boosting": lambda t: M.gbt(t, COLS, "label", rounds=20)[0],
    "logit": lambda t: M.logit(t, COLS, "label")[0],
    "mlp": lambda t: M.mlp(t, COLS, "label", hidden=(4,))[0],
}


@pytest.mark.parametrize("name", LEARNERS)
def test_held_out_auc(frame, name):
    m = LEARNERS[name](frame.where("fold > 0"))
    p = M.positive_prob_col(m.transform(X.assemble(COLS).transform(frame.where("fold = 0"))), out="p1")
    assert E.auc(p, "label", "p1").first().auc > 0.72


def test_svm_and_adaboost_beat_the_majority(frame):
    for p in (M.linear_svm(frame, COLS, "label")[1], M.adaboost(frame, COLS, "label", rounds=5)[1]):
        assert p.where("prediction = label").count() > 0.68 * frame.count()


def test_adaboost_discards_a_learner_no_better_than_chance(spark):
    xor = spark.createDataFrame([(float(a), float(b), float(a ^ b)) for a in (0, 1) for b in (0, 1)] * 5, "a double, b double, label double")
    learners, p = M.adaboost(xor, ["a", "b"], "label", rounds=4)
    assert learners == [] and {r.ada_score for r in p.collect()} == {0.0}
    easy = spark.createDataFrame([(float(i), float(i > 4)) for i in range(10)], "a double, label double")
    learners, p = M.adaboost(easy, ["a"], "label", rounds=4)
    assert len(learners) == 1 and p.where("prediction = label").count() == 10


def test_stack_scores_new_rows(frame):
    base = [("lr", lambda t: MC.LogisticRegression(featuresCol="features", labelCol="label").fit(t)),
            ("dt", lambda t: MC.DecisionTreeClassifier(featuresCol="features", labelCol="label", maxDepth=3).fit(t))]
    train, test = frame.where("fold > 0"), frame.where("fold = 0")
    model, oof = M.stack(train, COLS, "label", "fold", base)
    assert sorted(r.doc_id for r in oof.collect()) == sorted(r.doc_id for r in train.collect())
    fresh = M.positive_prob_col(model.transform(test.drop("label", "fold")), out="p1").select("doc_id", "p1").join(test, "doc_id")
    assert fresh.count() == test.count() and E.auc(fresh, "label", "p1").first().auc > 0.72


def test_grid_and_random_search_take_the_best(frame):
    x = X.assemble(COLS).transform(frame)
    rf = MC.RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=10, seed=1)
    cv = TU.grid_cv(rf, {rf.maxDepth: [1, 4]}, x, "fold")
    assert len(cv.avgMetrics) == 2 and min(cv.avgMetrics) > 0.6
    best, score, trials = TU.random_search(
        lambda p: MC.LogisticRegression(featuresCol="features", labelCol="label", **p),
        {"regParam": ("logfloat", 1e-4, 10.0)}, x, "fold", n_trials=3)
    assert score == max(t[1] for t in trials) and best in [t[0] for t in trials]


def test_importances_and_summary(frame):
    m, _ = M.random_forest(frame, COLS, "label", trees=20)
    top = M.importances(m, COLS, k=3)
    assert {top[0][0], top[1][0]} == {"a", "b"} and sum(v for _, v in top) == pytest.approx(1)
    s = M.training_summary(M.logit(frame, COLS, "label")[0])
    assert 0.65 < s["accuracy"] < 1 and s["objective_history"] == sorted(s["objective_history"], reverse=True) and s["auc"] > 0.72


def test_first_half_year_validation(spark):
    from sparkwright.operators import split as S
    df = spark.sql("SELECT id, make_timestamp_ntz(2000 + CAST(id DIV 12 AS INT), CAST(id % 12 + 1 AS INT), 3, 0, 0, 0) AS t FROM range(36)") \
        .withColumn("y", F.year("t"))
    plan = S.walk_forward_plan([2000, 2001, 2002], "expanding", 6)
    got = S.walk_forward(df, "y", "t", plan, embargo_months=6, valid_months=6)
    assert sorted((r.fold, r.role, r.id) for r in got.collect()) == [(0, "train", i) for i in range(6)] + [(0, "valid", i) for i in range(12, 18)]


def test_stack_fits_run_side_by_side(frame):
    """Fits that wait for each other end only if two of them run at a time."""
    import threading
    both = threading.Barrier(2, timeout=60)

    def fit(tr):
        both.wait()
        return MC.LogisticRegression(featuresCol="features", labelCol="label").fit(tr)

    train = frame.withColumn("fold", F.col("doc_id") % 2)
    model, oof = M.stack(train, COLS, "label", "fold", [("p", fit), ("q", fit)], width=2)
    assert oof.count() == train.count() and [n for n, _ in model.base] == ["p", "q"]


def test_grid_points_run_side_by_side(spark, monkeypatch):
    from sparkwright.plans import q_models as Q
    from types import SimpleNamespace
    widths = []
    monkeypatch.setattr(TU, "grid_cv", lambda *a, **k: widths.append(k.get("parallelism", 1)) or SimpleNamespace(avgMetrics=[0.5] * 4))
    assert Q.q_cv(spark, "/root/testdata/sf0.001").count() == 4 and widths == [4]
