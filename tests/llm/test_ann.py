from __future__ import annotations

from llm_support import docs, no_docs, sf  # noqa: F401

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import ann, catalog

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, ask, k):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero([ask(x) for x in ids]):
        s = np.einsum("ij,j->i", v, v[i])
        near = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in near]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def recall(got, want):
    hits = [len({x[1] for x in got.get(q, [])} & {y[0] for y in w}) / max(1, len(w)) for q, w in want.items()]
    return sum(hits) / len(hits)


def test_query_reaches_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = answers(catalog.op3_ann(spark, sf)), brute(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    exact = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        assert [n[0] for n in near] == list(range(1, 21))
        assert near == sorted(near, key=lambda n: (-n[2], n[1]))
        assert all(abs(n[2] - exact[q] @ exact[n[1]]) < 1e-12 for n in near)


@pytest.mark.parametrize("spread", ["norms", "clusters", "one block each"])
def test_recall_on_other_data(spark, spread):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((1500, 16))
    if spread == "norms":
        v *= rng.lognormal(0, 0.7, (1500, 1))
    elif spread == "clusters":
        v = 5 * rng.standard_normal((10, 16))[rng.integers(0, 10, 1500)] + 0.3 * v
    rows = [(i, x.astype("float32").astype(float).tolist(), 0) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, VECTORS)
    got = answers(ann.search(df, F.col("vec_id") % 50 == 0, 10, block_rows=100 if spread == "one block each" else 65536, query_block=7))
    want = brute(rows, lambda i: i % 50 == 0, 10)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9


def test_copies_and_odd_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [-1.0, 0.5, 0.0]
    rows = [(0, a, 0), *((k, a, 0) for k in range(1, 8)), (20, b, 0), (9, [0.0, 0.0, 0.0], 0), (40, None, 0), (11, [1.0, None, 2.0], 0),
            (60, [float("nan"), 1.0, 1.0], 0), (13, [float("inf"), 1.0, 1.0], 0), (14, [1.0], 0), (None, a, 0), (80, [], None)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"query_id": F.lit(1), "rank": F.lit(2), "score": F.lit("x"), "v": F.lit(0)})
    got = answers(ann.search(df, F.col("vec_id") % 20 == 0, 5))
    assert {q: [n[1] for n in v] for q, v in got.items()} == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4]}
    assert len({n[2] for n in got[0]}) == 1
    assert len(answers(ann.search(df, F.col("vec_id") % 20 == 0, 50))[0]) == 8
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
