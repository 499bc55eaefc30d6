"""Learners, ensembles and scoring.

Every fit is a Spark ML estimator, so the data stays distributed; only
model parameters (p-sized) reach the driver. Iterative drivers
(boosting) cut lineage with a reliable checkpoint each round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .folds import concurrently


def _features(df: DataFrame, cols: Sequence[str] | str, out: str = "features") -> DataFrame:
    if isinstance(cols, str):
        return df if cols == out else df.withColumn(out, F.col(cols))
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def linear(df: DataFrame, features: Sequence[str] | str, label: str, reg: float = 0.0, elastic: float = 0.0):
    """Linear regression (normal equations); returns (model, predictions)."""
    x = _features(df, features)
    m = MR.LinearRegression(featuresCol="features", labelCol=label, solver="normal",
                            regParam=reg, elasticNetParam=elastic).fit(x)
    return m, m.transform(x)


def logit(df: DataFrame, features: Sequence[str] | str, label: str, reg: float = 0.0, elastic: float = 0.0,
          intercept: bool = True, weight: str | None = None, max_iter: int = 100, threshold: float = 0.5):
    """Logistic regression (no penalty, ridge, lasso or elastic net)."""
    x = _features(df, features)
    lr = MC.LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=elastic,
                               fitIntercept=intercept, maxIter=max_iter, threshold=threshold)
    if weight:
        lr = lr.setWeightCol(weight)
    m = lr.fit(x)
    return m, m.transform(x)


def reg_param_for_c(c: float, n: int) -> float:
    """sklearn's inverse strength C to Spark's regParam (1 / (C * n))."""
    return 1.0 / (c * n)


def random_forest(df, features, label, trees: int = 100, depth: int = 4, bins: int = 32, seed: int = 7,
                  weight: str | None = None):
    """Random forest classifier."""
    x = _features(df, features)
    rf = MC.RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth,
                                   maxBins=bins, seed=seed)
    if weight:
        rf = rf.setWeightCol(weight)
    m = rf.fit(x)
    return m, m.transform(x)


def decision_tree(df, features, label, depth: int = 5, weight: str | None = None, min_leaf: int = 1, seed: int = 7):
    """Decision tree with optional class weights (``weightCol``)."""
    x = _features(df, features)
    dt = MC.DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=depth,
                                   minInstancesPerNode=min_leaf, seed=seed)
    if weight:
        dt = dt.setWeightCol(weight)
    m = dt.fit(x)
    return m, m.transform(x)


def mlp(df, features, label, hidden: Sequence[int] = (8,), max_iter: int = 100, seed: int = 7, n_classes=None):
    """Multilayer perceptron; input and output layer sizes come from the data."""
    x = _features(df, features)
    n_in = len(x.select("features").first()["features"])
    if n_classes is None:
        n_classes = int(x.agg(F.max(label)).first()[0]) + 1
    m = MC.MultilayerPerceptronClassifier(featuresCol="features", labelCol=label,
                                          layers=[n_in, *hidden, n_classes], maxIter=max_iter, seed=seed).fit(x)
    return m, m.transform(x)


def gbt(df, features, label, rate: float = 0.1, depth: int = 3, rounds: int = 50, min_leaf: int = 1,
        seed: int = 7, weight: str | None = None):
    """Gradient-boosted trees (re-aim of the four boosting libraries)."""
    x = _features(df, features)
    g = MC.GBTClassifier(featuresCol="features", labelCol=label, stepSize=rate, maxDepth=depth, maxIter=rounds,
                         minInstancesPerNode=min_leaf, seed=seed)
    if weight:
        g = g.setWeightCol(weight)
    m = g.fit(x)
    return m, m.transform(x)


def linear_svm(df, features, label, c: float = 1.0, max_iter: int = 100):
    """Linear support-vector classifier (regParam from C as in M11)."""
    x = _features(df, features)
    n = x.count()
    m = MC.LinearSVC(featuresCol="features", labelCol=label, regParam=reg_param_for_c(c, n),
                     maxIter=max_iter).fit(x)
    return m, m.transform(x)


def adaboost(df: DataFrame, features, label: str, rounds: int = 10, rate: float = 1.0, depth: int = 1,
             seed: int = 7):
    """Discrete AdaBoost (SAMME, two classes) with depth-1 trees.

    Each round fits a weighted tree (distributed), computes the weighted
    error in one aggregate, and updates the weights, which stay normalised;
    only features, label and weight are carried, and the lineage is cut with
    a reliable checkpoint so the plan does not grow with rounds. A tree no
    better than chance (error 0.5 or more) is discarded and ends the rounds,
    a perfect one ends them too.
    Returns (list of (alpha, tree model), scored frame with ``ada_score``).
    """
    x = _features(df, features).select("features", label)
    n = x.count()
    x = x.withColumn("_w", F.lit(1.0 / max(n, 1)))
    learners = []
    for r in range(rounds):
        tree = MC.DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=depth,
                                         weightCol="_w", seed=seed + r).fit(x)
        p = tree.transform(x).select("features", label, "_w", F.col("prediction").alias("_p"))
        miss = (F.col("_p") != F.col(label)).cast("double")
        err = p.agg((F.sum(F.col("_w") * miss) / F.sum("_w")).alias("e")).first()["e"]
        if err >= 0.5:
            break
        alpha = rate * math.log((1 - err) / max(err, 1e-10))
        learners.append((alpha, tree))
        if err <= 1e-10:
            break
        grown = math.exp(alpha)
        x = cut_lineage(p.withColumn("_w", F.col("_w") * F.when(miss == 1, grown).otherwise(1.0)
                                     / (1 - err + err * grown)).drop("_p"))
    scored = df if "features" in df.columns else _features(df, features)
    score = F.lit(0.0)
    for i, (alpha, tree) in enumerate(learners):
        scored = tree.transform(scored).withColumnRenamed("prediction", f"_p{i}") \
            .drop("rawPrediction", "probability")
        score = score + F.lit(alpha) * (F.col(f"_p{i}") * 2 - 1)
    scored = scored.withColumn("ada_score", score) \
        .withColumn("prediction", (F.col("ada_score") > 0).cast("double")) \
        .drop(*[f"_p{i}" for i in range(len(learners))])
    return learners, scored


def positive_prob_col(df: DataFrame, col: str = "probability", out: str = "p1") -> DataFrame:
    """Probability of class 1 from an ML probability vector."""
    return df.withColumn(out, vector_to_array(col)[1])


class StackedModel:
    """Base models fitted on all training rows and the meta model over their probabilities."""

    def __init__(self, base, meta, features):
        self.base, self.meta, self.features = base, meta, features

    def transform(self, df: DataFrame) -> DataFrame:
        """Score any rows: a column per base model, then the meta model's prediction and probability."""
        x = _features(df, self.features)
        for name, m in self.base:
            x = positive_prob_col(m.transform(x), out=name).drop("rawPrediction", "probability", "prediction")
        return self.meta.transform(_meta_features(x, [n for n, _ in self.base]))


def _meta_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="meta_features").transform(df)


def stack(df: DataFrame, features, label: str, fold: str, base: Sequence, meta=None, key: str = "doc_id", width: int = 4):
    """Stacking with out-of-fold base predictions.

    ``base`` is a list of (name, fit_fn) where ``fit_fn(train_df)`` returns a
    fitted model with ``transform``. For every fold the base models are fit
    on the other folds and score the held-out fold; the meta model is fit on
    these out-of-fold probabilities, and the base models once more on all
    rows. The fits are independent jobs, ``width`` at a time. ``key`` identifies
    a row. Returns (``StackedModel``, training frame with out-of-fold meta
    features and the meta prediction).
    """
    x = _features(df, features)
    folds = sorted(r[0] for r in x.select(fold).distinct().collect())   # k values
    names = [n for n, _ in base]
    jobs = [lambda t=x.filter(F.col(fold) != f), fit_fn=fit_fn: fit_fn(t) for f in folds for _, fit_fn in base]
    fits = concurrently(df.sparkSession, [*jobs, *[lambda fit_fn=fit_fn: fit_fn(x) for _, fit_fn in base]], width, "stack")
    oof = None
    for i, f in enumerate(folds):
        te = x.filter(F.col(fold) == f)
        for name, m in zip(names, fits[i * len(base):]):
            te = positive_prob_col(m.transform(te), out=name).drop("rawPrediction", "probability", "prediction")
        part = te.select(key, *names)
        oof = part if oof is None else oof.unionByName(part)
    mx = cut_lineage(_meta_features(x.join(oof, key), names))
    meta = meta or MC.LogisticRegression(featuresCol="meta_features", labelCol=label)
    mm = meta.fit(mx)
    return StackedModel(list(zip(names, fits[len(jobs):])), mm, features), mm.transform(mx)


def importances(model, names: Sequence[str], exclude: Sequence[str] = (), k: int | None = 5):
    """M27 + O5: feature importances with names, excluded names removed, top k (p-sized)."""
    imp = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, imp) if n not in set(exclude)]
    rows.sort(key=lambda r: (-r[1], r[0]))
    return rows[:k] if k else rows


def coefficients(model, names: Sequence[str]):
    """(name, coefficient) pairs, intercept last."""
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients.toArray())]
    if hasattr(model, "intercept"):
        rows.append(("intercept", float(model.intercept)))
    return rows


def training_summary(model) -> dict:
    """Accuracy, per-label precision/recall/F, AUC and objective history."""
    s = model.summary
    out = {"accuracy": s.accuracy, "precision_by_label": list(s.precisionByLabel),
           "recall_by_label": list(s.recallByLabel), "f_by_label": list(s.fMeasureByLabel()),
           "objective_history": list(s.objectiveHistory)}
    if hasattr(s, "areaUnderROC"):
        out["auc"] = s.areaUnderROC
    return out


def score_and_rank(model, df: DataFrame, key: str, n: int = 15, features: str = "features") -> DataFrame:
    """Score a hold-out period, sum positive votes per key, top n (ties by key)."""
    p = model.transform(df)
    g = p.groupBy(key).agg(F.sum("prediction").alias("votes"), F.count(F.lit(1)).alias("n_rows"))
    return g.orderBy(F.desc("votes"), F.asc(key)).limit(n)


def submission(pred: DataFrame, id_col: str, out_col: str = "label", path: str | None = None) -> DataFrame:
    """Id + probability of class 1; written as CSV when ``path`` is given."""
    out = pred.select(F.col(id_col), vector_to_array("probability")[1].alias(out_col))
    if path:
        out.write.mode("overwrite").option("header", True).csv(path)
    return out
