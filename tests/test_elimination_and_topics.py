from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.operators import stats as ST
from sparkwright.operators import text as T


def one_by_one(df, cols, label, p_max, family):
    """Elimination with a fit per removed feature."""
    keep = list(cols)
    while keep:
        p = list(ST.glm(df, keep, label, family).summary.pValues)[:len(keep)]
        if max(p) <= p_max:
            break
        keep.pop(int(np.argmax(p)))
    return keep


@pytest.mark.parametrize("family", ["gaussian", "binomial"])
def test_elimination_equals_a_fit_per_feature(spark, family, monkeypatch):
    r = np.random.default_rng(8)
    x = r.normal(size=(500, 7))
    x[:, 4] += x[:, 0]
    eta = x @ [1.0, -0.7, 0.0, 0.25, 0.0, 0.0, 0.1] + 0.3
    y = eta + r.normal(size=500) if family == "gaussian" else (eta + r.logistic(size=500) > 0).astype(float)
    cols = list("abcdefg")
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], ", ".join(f"{c} double" for c in cols) + ", label double").cache()
    want = one_by_one(df, cols, "label", 0.05, family)
    fits = []
    original = ST.glm
    monkeypatch.setattr(ST, "glm", lambda *a: fits.append(1) or original(*a))
    assert ST.backward_eliminate(df, cols, "label", 0.05, family) == want
    assert len(want) < 7 and len(fits) <= 3


def test_sweep_is_regression_and_has_an_inverse():
    r = np.random.default_rng(9)
    x, y = r.normal(size=(50, 3)), r.normal(size=50)
    m = np.c_[x, y]
    a = m.T @ m
    s = ST.sweep(ST.sweep(ST.sweep(a, 0), 1), 2)
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    assert s[:3, 3] == pytest.approx(beta) and s[3, 3] == pytest.approx(rss[0])
    assert -s[:3, :3] == pytest.approx(np.linalg.inv(x.T @ x))
    assert ST.unsweep(s, 1) == pytest.approx(ST.sweep(ST.sweep(a, 0), 2))


def test_topic_tables(spark):
    docs = [(i, ["cat", "dog", "pet"] * 4 if i % 2 else ["car", "road", "wheel"] * 4) for i in range(30)] + [(99, [])]
    df = spark.createDataFrame(docs, "id int, toks array<string>")
    cm, cv = T.count_vectors(df, "toks")
    lm, out = T.topics(cv, "tf", k=2, max_iter=30)
    terms = T.topic_terms(lm, cm.vocabulary, spark, None).collect()
    for t in (0, 1):
        rows = sorted((r for r in terms if r.topic == t), key=lambda r: r["rank"])
        assert len(rows) == 6 and sum(r.weight for r in rows) == pytest.approx(1)
        assert [r.weight for r in rows] == sorted((r.weight for r in rows), reverse=True)
    top = T.top_topics(out, "id", "topics", 2).collect()
    assert {r.id for r in top} == set(range(30))
    # the tables give back the corpus's term totals: sum over documents of length * topic weight * term weight
    phi = {(r.topic, r.term): r.weight for r in terms}
    totals = {w: sum(12 * r.weight * phi[r.topic, w] for r in top) for w in cm.vocabulary}
    assert all(v == pytest.approx(60, rel=0.1) for v in totals.values())
    assert df.where(F.size("toks") == 0).count() == 1
