from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.operators import knn

VEC = "id long, vector array<double>, label int"


def brute(queries, points, k):
    out = {}
    for qid, q, _ in queries:
        if qid is None or q is None:
            continue
        near = sorted((float(np.sqrt(np.square(np.array(v) - np.array(q)).sum())), i, c) for i, v, c in points if i is not None and v is not None)
        out[qid] = near[:k]
    return out


def same(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id, r.label))
    assert set(by) == {q for q, near in want.items() if near}
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [r[2] for r in rows] == [i for _, i, _ in want[q]]
        assert [r[1] for r in rows] == pytest.approx([d for d, _, _ in want[q]], rel=1e-12, abs=1e-300)


def table(n, seed, copies=0, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 6)) * 8
    rows = [(i, (centres[i % 12] + r.normal(size=6) * spread).tolist(), int(i % 3)) for i in range(n)]
    return rows + [(n + i, rows[5][1], 1) for i in range(copies)]


@pytest.mark.parametrize("copies", [0, 120])
def test_equal_to_brute_force(spark, monkeypatch, copies):
    monkeypatch.setattr(knn, "CELL_ROWS", 20)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)     # a hot cell of copies is cut into blocks
    monkeypatch.setattr(knn, "QUERY_ROWS", 7)
    points = table(240, 1, copies)
    queries = [(10**6 + i, v, None) for i, v, _ in table(40, 2)] + [(7, points[7][1], None), (None, points[0][1], None), (8, None, None)]
    got = knn.neighbours(spark.createDataFrame(queries, VEC), spark.createDataFrame(points, VEC).repartition(5), 9, label_col="label")
    same(got.collect(), brute(queries, points, 9))


def test_far_cells_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 25)
    points = spark.createDataFrame(table(600, 3, spread=0.2), VEC)
    queries = spark.createDataFrame([(i, v, None) for i, v, _ in table(30, 4, spread=0.2)], VEC)
    met = []
    original = knn._visits
    monkeypatch.setattr(knn, "_visits", lambda *a: met.append(original(*a)) or met[-1])
    same(knn.neighbours(queries, points, 5, label_col="label").collect(),
         brute(table(30, 4, spread=0.2), table(600, 3, spread=0.2), 5))
    assert len(met) == 2


def test_few_points_empty_tables_and_large_offsets(spark):
    points = [(i, [1e6 + i * 1e-3, 1e6], 0) for i in range(5)] + [(9, None, 1), (None, [0.0, 0.0], 1)]
    queries = [(1, [1e6, 1e6], None), (2, [1e6 + 2.2e-3, 1e6], None)]
    p, q = spark.createDataFrame(points, VEC), spark.createDataFrame(queries, VEC)
    same(knn.neighbours(q, p, 16).collect(), brute(queries, points, 16))
    same(knn.neighbours(q, p, 2).collect(), brute(queries, points, 2))
    assert knn.neighbours(q, p.limit(0), 3).collect() == [] and knn.neighbours(q.limit(0), p, 3).collect() == []


def test_vote_breaks_ties_by_label(spark):
    near = spark.createDataFrame([(1, 1.0), (1, 0.0), (1, 2.0), (1, 2.0), (2, 1.0), (2, 0.0), (3, None)], "query_id long, label double")
    got = {r.query_id: (r.prediction, r.share) for r in knn.vote(near).collect()}
    assert got == {1: (2.0, 0.5), 2: (0.0, 0.5)}


def test_classify_separates_blobs(spark):
    rows = table(300, 5, spread=0.3)
    marked = [(i, v, i % 12) for i, v, _ in rows]
    df = spark.createDataFrame(marked, VEC)
    mine = F.floor(F.col("id") / 12) % 4 == 0
    train, test = df.where(~mine), df.where(mine)
    got = {r.query_id: r.prediction for r in knn.classify(train, test, "label", 5).collect()}
    assert got == {i: float(c) for i, _, c in marked if i // 12 % 4 == 0}


def test_visits_leave_in_bounded_batches():
    """A query that visits many cells is repeated for each; a batch of such rows stays bounded."""
    from types import SimpleNamespace

    import pyarrow as pa

    class Queries:
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

        def mapInArrow(self, work, schema):
            return work

    r = np.random.default_rng(4)
    d, m = 64, 300
    pivots, q = r.normal(size=(m, d)), r.normal(size=(500, d))
    cells = knn.Cells(pivots, np.full(m, 9), np.zeros(m), np.full(m, 5.0))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), pa.array(list(q), pa.list_(pa.float64())), pa.array(np.full(500, np.inf))],
                                       names=["query_id", "v", "bound"])
    for second in (False, True):
        out = list(knn._visits(Queries(), cells, 16, second)([batch]))
        assert max(b.num_rows for b in out) * d <= knn.VALUES
        table = pa.Table.from_batches(out)
        far = knn.distances(q, pivots)
        first = [set(cells.first_visits(far[i], 16)) for i in range(500)]
        want = {(i, int(c)) for i in range(500) for c in range(m) if (c in first[i]) != second}
        assert set(zip(table["query_id"].to_pylist(), table["cell"].to_pylist())) == want and table.num_rows == len(want)
        assert all((np.array(v) == q[i]).all() for i, v in zip(table["query_id"].to_pylist()[::997], table["q"].to_pylist()[::997]))
