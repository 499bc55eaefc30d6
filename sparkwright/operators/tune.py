"""Model selection.

Cross-validation uses an explicit fold column (repeatable, stratified via
``split.stratified_folds``) and runs every fit as a distributed Spark ML
job. The parameter search replaces the reference's sequential Bayesian
sampler with a seeded random sampler over the same kinds of ranges.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save_intermediate
from . import boosting
from .folds import concurrently, written_by_year
from .paths import held_out_margins


def grid_cv(estimator, grid: Mapping, train: DataFrame, fold_col: str, label: str = "label",
            metric: str = "areaUnderROC", parallelism: int = 1, num_folds: int | None = None):
    """M7: grid search with k-fold CV on an explicit fold column (values 0..k-1);
    returns the CV model.

    Strengths of a binary logistic regression advance together, all folds in one pass
    over the data per step (``paths``); only the best is fitted by itself. Any other
    grid is a fit per point and fold.
    """
    if num_folds is None:
        num_folds = int(train.agg(F.max(fold_col)).first()[0]) + 1
    b = ParamGridBuilder()
    for param, values in grid.items():
        b = b.addGrid(param, list(values))
    ev = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    if _only_strengths(estimator, grid, label):
        model = _strengths_cv(estimator, b.build(), train, fold_col, label, metric, parallelism, num_folds)
        if model is not None:
            return model
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=b.build(), evaluator=ev, foldCol=fold_col,
                        numFolds=num_folds, parallelism=parallelism)
    return cv.fit(train)


def _only_strengths(estimator, grid: Mapping, label: str) -> bool:
    """Whether ``grid`` varies nothing but the penalty of a plain logistic regression."""
    if type(estimator) is not LogisticRegression or [p.name for p in grid] != ["regParam"] or estimator.getLabelCol() != label:
        return False
    free = {"featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol", "regParam", "elasticNetParam",
            "standardization", "threshold", "aggregationDepth", "maxBlockSizeInMB"}
    return {p.name for p in estimator.params if estimator.isSet(p)} <= free and estimator.getRawPredictionCol() == "rawPrediction"


def _strengths_cv(estimator, maps: Sequence, train: DataFrame, fold_col: str, label: str, metric: str, parallelism: int, num_folds: int):
    """The CV model of a grid of strengths, or None where the folds cannot be fitted together."""
    margins = held_out_margins(train, estimator.getFeaturesCol(), label, [float(m[estimator.regParam]) for m in maps],
                               estimator.getElasticNetParam(), fold_col, num_folds, estimator.getStandardization())
    if margins is None:
        return None
    scored = written_by_year(margins, "fold")

    def score(i: int, fold: int) -> float:
        ev = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol=f"z{i}", metricName=metric)
        return ev.evaluate(scored.where(F.col("fold") == fold).select("y", f"z{i}"))

    jobs = [lambda i=i, f=f: score(i, f) for f in range(num_folds) for i in range(len(maps))]
    got = np.array(concurrently(train.sparkSession, jobs, parallelism, "grid")).reshape(num_folds, len(maps))
    means = got.mean(0)
    best = estimator.fit(train, maps[int(np.argmax(means))])
    return CrossValidatorModel(best, avgMetrics=means.tolist(), stdMetrics=got.std(0).tolist())


# A search space entry: ("float", lo, hi) | ("logfloat", lo, hi) | ("int", lo, hi, step) | ("cat", [values])
Space = Mapping[str, tuple]


def sample_params(space: Space, rng: random.Random) -> dict:
    """Draw one parameter set from ``space``."""
    out = {}
    for name, spec in space.items():
        kind = spec[0]
        if kind == "float":
            out[name] = rng.uniform(spec[1], spec[2])
        elif kind == "logfloat":
            out[name] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
        elif kind == "int":
            step = spec[3] if len(spec) > 3 else 1
            out[name] = rng.randrange(spec[1], spec[2] + 1, step)
        elif kind == "cat":
            out[name] = rng.choice(list(spec[1]))
        else:
            raise ValueError(kind)
    return out


def random_search(build: Callable[[dict], object], space: Space, train: DataFrame, fold_col: str,
                  n_trials: int = 20, seed: int = 0, label: str = "label", metric: str = "areaUnderROC",
                  folds: Sequence[int] | None = None):
    """M8: seeded random search; each trial is a k-fold CV of ``build(params)``.

    Returns (best params, best mean score, trials as [(params, mean, per-fold)]).
    The training frame is persisted once for all trials.
    """
    rng = random.Random(seed)
    ev = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    data = train.persist()
    if folds is None:
        folds = sorted(r[0] for r in data.select(fold_col).distinct().collect())
    trials = []
    try:
        for _ in range(n_trials):
            params = sample_params(space, rng)
            est = build(params)
            scores = []
            for f in folds:
                m = est.fit(data.filter(data[fold_col] != f))
                scores.append(ev.evaluate(m.transform(data.filter(data[fold_col] == f))))
            trials.append((params, sum(scores) / len(scores), scores))
    finally:
        data.unpersist()
    best = max(trials, key=lambda t: t[1])
    return best[0], best[1], trials


def halving_search(build: Callable[[dict], object], space: Space, train: DataFrame, fold_col: str, n_trials: int = 200,
                   eta: int = 3, resource: str = "maxIter", least: int = 2, most: int = 54, last_folds: int | None = None,
                   seed: int = 0, label: str = "label", metric: str = "areaUnderROC", width: int = 8):
    """M8: successive halving over concurrent fits.

    All ``n_trials`` draws run with ``least`` of the resource (boosting rounds) on one
    fold; the best ``1 / eta`` of a rung go on with ``eta`` times as much, on
    another fold, until ``eta`` or fewer are left or ``most`` is reached. The
    last rung is scored on ``last_folds`` folds (default: all). Ties go to the earlier draw.

    Plain boosted trees of a rung advance together, one pass over the data per round and tree level
    (``boosting``). Fits of any other learner are independent jobs, ``width`` at a time.

    Returns (best params, best mean score, rows), a row per draw and rung:
    (trial, rung, resource, folds, mean score, params).
    """
    rng = random.Random(seed)
    draws = [sample_params(space, rng) for _ in range(n_trials)]
    ev = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    data = save_intermediate(train, "search")
    folds = sorted(r[0] for r in data.select(fold_col).distinct().collect())
    trees = _boosted_together([build({**d, resource: least}) for d in draws], data, fold_col, label)
    # A fit is many short jobs: no more tasks than the rows are worth.
    n_rows = data.count()
    data = data.coalesce(max(1, n_rows // 20_000))

    def score(trial: int, amount: int, fold: int) -> float:
        model = build({**draws[trial], resource: amount}).fit(data.where(F.col(fold_col) != fold))
        return ev.evaluate(model.transform(data.where(F.col(fold_col) == fold)))

    def scores(jobs: Sequence[tuple[int, int]], amount: int) -> list[float]:
        models = [boosting.settings(build({**draws[t], resource: amount}), label) for t, _ in jobs] if trees else [None]
        if any(m is None or (m.bins, m.seed) != (trees.bins, trees.seed) for m in models):
            return concurrently(train.sparkSession, [lambda t=t, f=f: score(t, amount, f) for t, f in jobs], width, "search")
        at = {t: i for i, t in enumerate(dict.fromkeys(t for t, _ in jobs))}
        scored = trees.scored([(m, f) for m, (_, f) in zip(models, jobs, strict=True)], [at[t] for t, _ in jobs])

        def one(trial: int, fold: int) -> float:
            z = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol=f"z{at[trial]}", metricName=metric)
            return z.evaluate(scored.where(F.col("fold") == fold).select("y", f"z{at[trial]}").coalesce(max(1, n_rows // 20_000)))

        return concurrently(train.sparkSession, [lambda t=t, f=f: one(t, f) for t, f in jobs], width, "search")

    alive, amount, rung, rows = list(range(n_trials)), least, 0, []
    while True:
        last = len(alive) <= eta or amount >= most
        use = folds[:last_folds] if last else [folds[rung % len(folds)]]
        jobs = [(t, f) for t in alive for f in use]
        got = scores(jobs, min(amount, most))
        means = {t: sum(s for (x, _), s in zip(jobs, got) if x == t) / len(use) for t in alive}
        rows += [(t, rung, min(amount, most), len(use), means[t], draws[t]) for t in alive]
        ranked = sorted(alive, key=lambda t: (-means[t], t))
        if last:
            return draws[ranked[0]], means[ranked[0]], rows
        alive = ranked[:max(1, -(-len(alive) // eta))]
        amount, rung = amount * eta, rung + 1


def _boosted_together(estimators: Sequence, data: DataFrame, fold_col: str, label: str) -> boosting.Together | None:
    """The rows to fit ``estimators`` on together, or None where they are not all plain boosted trees."""
    found = [boosting.settings(e, label) for e in estimators]
    if None in found or len({(s.bins, s.seed) for s in found}) > 1 or len({e.getFeaturesCol() for e in estimators}) > 1:
        return None
    return boosting.together(data, estimators[0].getFeaturesCol(), label, fold_col, found[0].bins, found[0].seed)


def c_path(n_values: int = 10, lo: float = 1e-4, hi: float = 1e4) -> list[float]:
    """Log-spaced inverse-strength values (the ``Cs=10`` path)."""
    return [math.exp(math.log(lo) + i * (math.log(hi) - math.log(lo)) / (n_values - 1)) for i in range(n_values)]
