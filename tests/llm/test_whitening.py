from __future__ import annotations

import math

import numpy as np
import pytest
from llm_support import clash, sf  # noqa: F401

from sparkwright.llm import catalog, whitening

EMB = "vec_id long, embedding array<float>, label int"


def brute(rows, k=32):
    """Per row (deviation, whitened with free signs), eigenvalue shares, by integer sums and a dense eigen-decomposition."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    off = [[n * a - b for a, b in zip(r, s)] for r in x]
    y = np.array(off, dtype=float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:k]
    order = order[e[order] > 1e-12 * e.max()]
    return [i for i, _ in kept], n, [sum(a * a for a in r) for r in off], y @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def compare(got, rows, k=32):
    ids, n, deviations, white, shares = brute(rows, k)
    assert len(got) == len(ids) * len(shares)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append((r.vec_id, r.deviation, r.whitened))
        assert r.n == n and r.identity_error <= 1e-4 and abs(r.explained / shares[r.component - 1] - 1) <= 1e-8
    key = lambda t: (t[0] is None, t[0] or 0, t[1], t[2])
    for c, held in by.items():
        for sign in (1, -1):
            want = sorted(zip(ids, deviations, sign * white[:, c - 1]), key=key)
            have = sorted(held, key=key)
            if all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-7 for a, b in zip(want, have)):
                break
        else:
            raise AssertionError(f"component {c}")
    assert sorted(by) == list(range(1, len(shares) + 1))


def test_query_against_dense_decomposition(spark, sf):
    got = catalog.op11_whitening(spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(got, rows)


def odd_rows():
    r = np.random.default_rng(3)
    rows = [(i, [float(a) for a in r.standard_normal(5)], 0) for i in range(40)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0], None), (7, rows[7][1], 1), (7, rows[8][1], 1), (50, None, None),
             (51, [1.0, None, 0.0, 0.0, 0.0], 1), (52, [float("nan")] * 5, 1), (53, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1),
             (54, [0.0] * 5, 1), (55, [-1e4, 1e4, 0.0, 0.0, 0.0], 1)]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, EMB)
    got = whitening.whiten(clash(df, "index", "part", "place", "x", "n", "vector", "at")).collect()
    compare(got, [(i, v and [float(np.float32(c)) if c is not None else None for c in v]) for i, v, _ in rows])


def test_few_components_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LEAST_BLOCK_ROWS", 1)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 5 * 3)     # three rows a block
    rows = odd_rows()
    got = whitening.whiten(spark.createDataFrame(rows, EMB).repartition(5), components=2).collect()
    compare(got, [(i, v and [float(np.float32(c)) if c is not None else None for c in v]) for i, v, _ in rows], 2)


def test_tables_without_a_direction(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 4, [(1, None, 0)], [(1, [], 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, EMB)).collect() == []


def test_direction_that_does_not_vary_is_left_out(spark):
    rows = [(i, [float(i), 1.0, float(i % 3)], 0) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, EMB)).collect()
    compare(got, [(i, v) for i, v, _ in rows])
    assert {r.component for r in got} == {1, 2}


def test_wide_deviations_and_mixed_lengths(spark):
    doubles = "vec_id long, embedding array<double>, label int"
    rows = [(i, [2.6e6 * i, float(i % 2)], 0) for i in range(6)]     # the bound is over 63 bits, the sums are not
    compare(whitening.whiten(spark.createDataFrame(rows, doubles)).collect(), [(i, v) for i, v, _ in rows])
    with pytest.raises(Exception, match="OVERFLOW"):                 # a sum that no long holds
        whitening.whiten(spark.createDataFrame([(i, [1e9 * i, 0.0], 0) for i in range(6)], doubles)).collect()
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], EMB))
