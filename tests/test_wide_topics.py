from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.operators import lda
from sparkwright.operators import text as T
from sparkwright.plans import catalog


def corpus(n=200, seed=3):
    r = np.random.default_rng(seed)
    sets = [[f"{c}{i}" for i in range(15)] for c in "abc"]
    docs = [(i, [str(w) for w in r.choice(sets[i % 3], 5 + i % 20)] + [f"own{i}"] * (i % 4 == 0)) for i in range(n)]
    return [*docs, (n, [])]


def dense(docs, names, k, n_iter, seed):
    """Spark's online steps over whole matrices in double precision; docs: {row: {position: count}}."""
    lam = lda.quantiles()[lda.draws(names, k, seed)].astype(float).T
    start = lda.quantiles()[lda.draws(np.array([seed], np.uint64), k, seed + 1)[0]].astype(float)
    alpha = np.full(k, 1 / k)

    def fit(counts, beta):
        ids, c = list(counts), np.array(list(counts.values()), float)
        g = start
        while True:
            t = np.exp(lda.digamma(g) - lda.digamma(g.sum()))
            norm = t @ beta[:, ids]
            new = alpha + t * (beta[:, ids] @ (c / norm))
            done, g = np.abs(new - g).mean() <= 1e-3, new
            if done:
                t = np.exp(lda.digamma(g) - lda.digamma(g.sum()))
                return g, ids, np.outer(t, c / (t @ beta[:, ids]))

    for i in range(n_iter):
        beta = np.exp(lda.digamma(lam) - lda.digamma(lam.sum(1, keepdims=True)))
        times = dict(zip(docs, lda.drawn(np.array(list(docs)).view(np.uint64), seed + 2 + i)))
        stat, logs, n = np.zeros_like(lam), np.zeros(k), 0
        for row, m in times.items():
            if m and docs[row]:
                g, ids, add = fit(docs[row], beta)
                stat[:, ids] += m * add
                logs += m * (lda.digamma(g) - lda.digamma(g.sum()))
                n += m
        if not n:
            continue
        rho = (1024 + i + 1) ** -0.51
        lam = (1 - rho) * lam + rho * (stat * beta * len(docs) / math.ceil(0.05 * len(docs)) + 1 / k)
        grad = n * (lda.digamma(alpha.sum()) - lda.digamma(alpha) + logs / n)
        c, q = n * lda.trigamma(alpha.sum()), -n * lda.trigamma(alpha)
        alpha = alpha - rho * (grad - (grad / q).sum() / (1 / c + (1 / q).sum())) / q
        assert (alpha > 0).all()
    beta = np.exp(lda.digamma(lam) - lda.digamma(lam.sum(1, keepdims=True)))
    return lam, alpha, {row: (lambda g: g / g.sum())(fit(c, beta)[0]) if c else np.zeros(k) for row, c in docs.items()}


def test_digamma():
    assert lda.digamma(np.array([1.0, 0.01])) == pytest.approx([-0.5772156649015329, -100.56088545786867])
    assert lda.trigamma(np.array([1.0])) == pytest.approx([math.pi**2 / 6])


def test_draws():
    names = np.arange(4000, dtype=np.uint64)
    x = lda.quantiles()[lda.draws(names, 10, 7)]
    assert x.shape == (4000, 10) and x.mean() == pytest.approx(1, abs=0.002) and x.std() == pytest.approx(0.1, abs=0.002)
    times = lda.drawn(np.arange(100_000, dtype=np.uint64), 5)
    assert times.mean() == pytest.approx(0.05, abs=0.004) and times.var() == pytest.approx(0.05, abs=0.004)


def test_wide_counts(spark):
    docs = [(1, ["x", "y", "x"]), (2, []), (3, ["z"])]
    m, out = T.count_vectors(spark.createDataFrame(docs, "id int, toks array<string>"), "toks", wide=True)
    name = {r["at"]: r["term"] for r in m.table.collect()}
    got = {r["id"]: {name[i]: n for i, n in zip(r["tf"]["indices"], r["tf"]["values"])} for r in out.collect()}
    assert got == {i: Counter(t) for i, t in docs}
    assert m.vocabulary == ["x", "y", "z"]
    with pytest.raises(ValueError):
        T.count_vectors(out, "toks", min_df=2.0, wide=True)


@pytest.mark.parametrize("files", [1, 5])
def test_steps_equal_whole_matrices(spark, files, monkeypatch):
    monkeypatch.setattr(lda, "SLICE", 16)
    k, n_iter, seed = 6, 8, 11
    df = spark.createDataFrame(corpus(), "id int, toks array<string>").repartition(files, "id")
    _m, cv = T.count_vectors(df, "toks", wide=True)
    model, out = T.topics(cv, "tf", k=k, max_iter=n_iter, seed=seed)
    saved = {r["_row"]: r for r in model.docs.collect()}
    names = np.array(sorted({i for r in saved.values() for i in r["tf"]["indices"]}), np.int64).view(np.uint64)
    names = np.sort(names)
    at = {int(x): i for i, x in enumerate(names.view(np.int64))}
    lam, alpha, mixed = dense({row: {at[i]: n for i, n in zip(*r["tf"])} for row, r in saved.items()}, names, k, n_iter, seed)
    assert model.alpha == pytest.approx(alpha, rel=1e-3) and model.sums == pytest.approx(lam.sum(1), rel=1e-5)
    weights = {(r["topic"], at[r["at"]]): r["weight"] for r in model.strongest(None).collect()}
    assert len(weights) == k * len(names)
    share = lam / lam.sum(1, keepdims=True)
    assert max(abs(w / share[x] - 1) for x, w in weights.items()) < 2e-3
    found = {r["id"]: r["topics"].toArray() for r in out.collect()}
    assert len(found) == 201 and not found[200].any()
    for row, want in mixed.items():
        assert found[saved[row]["id"]] == pytest.approx(want, abs=5e-3)


def test_strongest_terms_of_wide_topics(spark):
    df = spark.createDataFrame([(i, ["cat", "dog", "pet"] * 4 if i % 2 else ["car", "road", "wheel"] * 4) for i in range(200)] + [(999, [])], "id int, toks array<string>")
    cm, cv = T.count_vectors(df, "toks", wide=True)
    lm, out = T.topics(cv, "tf", k=2, max_iter=30)
    terms = T.topic_terms(lm, cm, spark, None).collect()
    for t in (0, 1):
        rows = sorted((r for r in terms if r.topic == t), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5, 6] and sum(r.weight for r in rows) == pytest.approx(1)
        assert [r.weight for r in rows] == sorted((r.weight for r in rows), reverse=True)
    best = T.topic_terms(lm, cm, spark, 3).collect()
    assert {(r.topic, r["rank"], r.term) for r in best} == {(r.topic, r["rank"], r.term) for r in terms if r["rank"] <= 3}
    top = T.top_topics(out, "id", "topics", 2).collect()
    assert {r.id for r in top} == set(range(200))
    phi = {(r.topic, r.term): r.weight for r in terms}
    totals = {w: sum(12 * r.weight * phi[r.topic, w] for r in top) for w in cm.vocabulary}
    assert all(v == pytest.approx(400, rel=0.1) for v in totals.values())


def test_topic_queries_count_terms_of_one_document(spark, tmp_path):
    texts = ["the cat sat near the dog"] * 5 + ["zyzzyva quokka numbat", "", None]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    q = catalog.queries()
    top = q["q_lda_top"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in top} == set(range(6))
    assert {r.doc_id: r.mixture_sum for r in q["q_lda"](spark, str(tmp_path)).collect()} == dict.fromkeys(range(8), 1.0)
    terms = q["q_lda_terms"](spark, str(tmp_path))
    assert terms.count() == 700 and terms.where(F.col("term") == "numbat").count() == 100


def test_stop_words_of_odd_tokens(spark):
    df = spark.createDataFrame([(["The", None, "cat", "a"],)], "toks array<string>")
    take = lambda **k: df.select(T.remove_stopwords("toks", **k)).first()[0]
    assert take() == ["cat"] and take(case_sensitive=True) == ["The", "cat"] and take(words=[]) == ["The", "cat", "a"]
