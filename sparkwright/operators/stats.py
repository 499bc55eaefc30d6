"""Statistical inference.

Fits are distributed (normal equations / IRLS inside Spark ML); the p x p
algebra (VIF inverse, elimination control, odds) runs on the driver on
p-sized results only.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _assembled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip").transform(df)


def ols(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """OLS coefficients with standard errors, t and p-values.

    Output rows: one per feature then the intercept (Spark lists the
    intercept last in ``pValues``)."""
    m = LinearRegression(featuresCol="features", labelCol=label, solver="normal").fit(_assembled(df, cols))
    s = m.summary
    names = [*cols, "intercept"]
    coefs = [*m.coefficients.toArray().tolist(), float(m.intercept)]
    rows = list(zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues))
    spark = df.sparkSession
    return spark.createDataFrame([(n, float(c), float(se), float(t), float(p)) for n, c, se, t, p in rows],
                                 "feature string, coef double, std_err double, t double, p_value double")


def refit_significant(df: DataFrame, cols: Sequence[str], label: str, p_max: float = 0.1):
    """Keep features with p <= p_max (T24: the code's rule) and refit; the returned table is the refit."""
    table = ols(df, cols, label).filter(F.col("feature") != "intercept")
    keep = [r["feature"] for r in table.filter(F.col("p_value") <= p_max).select("feature").collect()]
    if keep:
        return keep, ols(df, keep, label)
    return keep, table.filter(F.lit(False))      # nothing significant: empty table, same schema


def glm(df: DataFrame, cols: Sequence[str], label: str, family: str = "binomial", link: str | None = None,
        reg: float = 0.0):
    """Generalised linear model; ``family="gaussian"`` reproduces T26."""
    g = GeneralizedLinearRegression(featuresCol="features", labelCol=label, family=family, regParam=reg)
    if link:
        g = g.setLink(link)
    return g.fit(_assembled(df, cols))


def glm_table(model, cols: Sequence[str], spark: SparkSession) -> DataFrame:
    """Coefficient table of a GLM fit: coef, std_err, z/t, p (intercept last)."""
    s = model.summary
    names = [*cols, "intercept"]
    coefs = [*model.coefficients.toArray().tolist(), float(model.intercept)]
    rows = [(n, float(c), float(se), float(t), float(p)) for n, c, se, t, p in
            zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return spark.createDataFrame(rows, "feature string, coef double, std_err double, t double, p_value double")


def _moments(df: DataFrame, cols: Sequence[str], label: str, weigh=None) -> tuple[np.ndarray, int]:
    """Gram matrix of (cols, 1, response) over complete rows, in one pass, and
    their number. ``weigh(linear features, y)`` gives weights and a working response."""
    from ..session import ship_library
    from .paths import _sums
    ship_library(df.sparkSession)
    p = len(cols) + 2
    data = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(label).cast("double").alias("y")).na.drop()
    data = data.select(F.array(*[f"x{i}" for i in range(len(cols))]).alias("x"), "y", F.lit(0).cast("long").alias("fold"))

    def work(x, y, _fold):
        w, z = (np.ones(len(y)), y) if weigh is None else weigh(x, y)
        m = np.c_[x, np.ones(len(y)), z]
        return np.r_[((m * w[:, None]).T @ m).ravel(), len(y)]

    total = _sums(data, p * p + 1, work)
    return total[:-1].reshape(p, p), int(total[-1])


def sweep(a: np.ndarray, k: int) -> np.ndarray:
    """Sweep operator on place ``k``: a variable enters the regression, or, swept again with ``unsweep``, leaves it."""
    d = a[k, k]
    out = a - np.outer(a[:, k], a[k]) / d
    out[k], out[:, k], out[k, k] = a[k] / d, a[:, k] / d, -1 / d
    return out


def unsweep(a: np.ndarray, k: int) -> np.ndarray:
    """The inverse of ``sweep``."""
    d = a[k, k]
    out = a - np.outer(a[:, k], a[k]) / d
    out[k], out[:, k], out[k, k] = -a[k] / d, -a[:, k] / d, -1 / d
    return out


def backward_eliminate(df: DataFrame, cols: Sequence[str], label: str, p_max: float = 0.05,
                       family: str = "binomial") -> list[str]:
    """Drop the feature with the largest p-value above ``p_max`` and refit, until none is left.

    Two fits and one pass in all, whatever the number of features: the first
    fit's normal (binomial: IRLS) matrix is gathered once, features leave it
    by the sweep operator, and the fit on what is kept confirms it; where that fit
    still has a p-value above ``p_max`` (binomial weights move a little), it is the
    next start. Rows with a null take no part. Features that the others
    determine are dropped first (their pivot vanishes).
    """
    base = df.select(*cols, label).na.drop().persist()
    keep = list(cols)
    try:
        while keep:
            model = glm(base, keep, label, family)
            p = np.array(model.summary.pValues[:len(keep)])
            if not (p > p_max).any():
                break
            beta = np.r_[model.coefficients.toArray(), model.intercept]

            def irls(x, y, beta=beta):
                eta = np.clip(np.c_[x, np.ones(len(x))] @ beta, -30, 30)
                mu = 1 / (1 + np.exp(-eta))
                w = np.maximum(mu * (1 - mu), 1e-12)
                return w, eta + (y - mu) / w

            gram, n = _moments(base, keep, label, irls if family == "binomial" else None)
            keep = _without_noise(gram, n, keep, p, p_max, family)
    finally:
        base.unpersist()
    return keep


def _without_noise(gram: np.ndarray, n: int, cols: list[str], p_first: np.ndarray, p_max: float, family: str) -> list[str]:
    """Features left when the least significant one is removed again and again
    from the swept matrix. The first removal follows the fit's own p-values."""
    a, last = gram.copy(), len(cols) + 1
    size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    inside = []
    for k in [len(cols), *range(len(cols))]:      # the intercept first
        if a[k, k] > 1e-12 * size[k] ** 2:
            a = sweep(a, k)
            inside.append(k)
    if any(k not in inside for k in range(len(cols))):
        return [c for i, c in enumerate(cols) if i in inside]
    limit = _critical(p_max, n, len(inside), family)
    first = True
    while len(inside) > 1:
        scale = a[last, last] / max(1, n - len(inside)) if family != "binomial" else 1.0
        z = {k: abs(a[k, last]) / np.sqrt(max(1e-300, -a[k, k] * scale)) for k in inside if k < len(cols)}
        worst = int(np.argmax(p_first)) if first else min(z, key=z.get)
        if not first and z[worst] >= limit:
            break
        a, first = unsweep(a, worst), False
        inside.remove(worst)
    return [c for i, c in enumerate(cols) if i in inside]


def _critical(p: float, n: int, k: int, family: str) -> float:
    """|z| whose two-sided p-value is ``p``: normal for the binomial family,
    for the Gaussian one its t form by the expansion in 1 / degrees of freedom."""
    z = NormalDist().inv_cdf(1 - p / 2)
    if family == "binomial":
        return z
    v = max(1, n - k)
    return z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2)


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation factors from the correlation matrix; infinite for collinear columns.

    The correlation matrix is one distributed pass (complete rows); the
    p x p inverse runs on the driver."""
    x = _assembled(df, cols)
    r = Correlation.corr(x, "features", "pearson").first()[0].toArray()
    spark = df.sparkSession
    # The factor is 1 / (1 - R2) of the regression on the others; an exactly
    # collinear column (also one without variance) has an infinite one.
    flat = {i for i in range(len(cols)) if not np.isfinite(np.delete(r[i], i)).any()} if len(cols) > 1 else set()
    rows = []
    for i, c in enumerate(cols):
        rest = [j for j in range(len(cols)) if j != i and j not in flat]
        if i in flat:
            rows.append((c, float("inf")))
            continue
        r2 = float(r[i, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)], hermitian=True) @ r[rest, i]) if rest else 0.0
        rows.append((c, float("inf") if not np.isfinite(r2) or 1 - r2 < 1e-12 else 1 / (1 - r2)))
    return spark.createDataFrame(rows, "feature string, vif double")


def odds_table(model, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """M26 + N24: odds ratio ``exp(coef)`` and percent change of the odds."""
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients.toArray())]
    df = spark.createDataFrame(rows, "feature string, coef double")
    return df.withColumn("odds_ratio", F.exp("coef")).withColumn("pct_change", (F.exp("coef") - 1) * 100)
