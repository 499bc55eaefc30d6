from __future__ import annotations

import re
from collections import Counter

import numpy as np
from llm_support import clash, docs, no_docs, sf  # noqa: F401

from sparkwright.llm import catalog, graph, neardup

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def bag(t):
    w = WORD.findall(t.lower())
    return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs):
    """Class (least id) of every row by comparing all pairs."""
    bags = [bag(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both >= 0.8 * sum((bags[i] | bags[j]).values()):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return Counter((d, least[find(i)]) for i, (d, _) in enumerate(docs))


def test_query_against_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.class_id) for r in catalog.op7_neardup(spark, sf).collect()) == brute(docs)


def test_groups_of_edited_copies(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    docs = []
    for g in range(6):
        base = [word() for _ in range(120)]
        docs.append(" ".join(base))
        for _ in range(25):
            own = list(base)
            for k in rng.integers(0, 120, rng.integers(0, 6)):
                own[k] = word()
            docs.append(" ".join(own))
        half = base[:60] + [word() for _ in range(60)]
        docs += [" ".join(half), " ".join(half[:-1] + ["end"])]
    rows = list(enumerate(docs))
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)


def test_templated_texts_make_no_pairs(spark, monkeypatch):
    """Texts that share 85 % of their words with all others, and edited copies of a few of them."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    shared = [word() for _ in range(170)]
    docs = [shared + [word() for _ in range(28)] for _ in range(200)]
    docs += [shared[:rng.integers(150, 171)] + [word() for _ in range(rng.integers(5, 60))] for _ in range(100)]
    docs += [d[:-1] + [word()] for d in docs[:40]] + [d + [word() for _ in range(k)] for k, d in enumerate(docs[40:70])]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    made = []
    real = neardup._open_pairs
    monkeypatch.setattr(neardup, "_open_pairs", lambda *a: made.append(real(*a)) or made[0])
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)
    assert made[0].count() < 10 * len(rows)


def test_open_pairs_hold_all_links(spark, monkeypatch):
    """Sets in one bucket: every link of different roots that includes one outside the main class is among the pairs."""
    monkeypatch.setattr(neardup, "ONE_CELL", 8)
    rng = np.random.default_rng(4)
    for threshold in (0.5, 0.8, 0.95, 1.0):
        bags = [set(range(60))] + [set(rng.choice(75, rng.integers(30, 66), replace=False).tolist()) for _ in range(40)]
        bags += [set(b) - set(rng.choice(75, rng.integers(0, 5)).tolist()) for b in bags for _ in range(2)]
        jaccard = lambda a, b: len(a & b) / len(a | b)
        held = Counter(x for b in bags for x in b)
        rows = [(7, v, v if v >= 12 else 0, 0, len(b & bags[0]) if v else len(b), 1 - jaccard(b, bags[0]),
                 len(b), sum(held[x] > 1 for x in b), [7]) for v, b in enumerate(bags)]
        placed = spark.createDataFrame(rows, "key long, v long, root long, pivot long, o long, d double, "
                                             "size long, common long, keys array<long>") \
            .selectExpr("*", "greatest(common - o, 0) AS beside")
        got = {(r.u, r.v) for r in neardup._open_pairs(placed, threshold).collect()}
        linked = {(i, j) for j in range(12, len(bags)) for i in range(j)
                  if jaccard(bags[i], bags[j]) >= threshold and rows[i][2] != rows[j][2]}
        assert linked <= got and all(i < j for i, j in got)


def test_odd_rows(docs, no_docs):
    odd = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = neardup.classes(clash(docs, "_hash", "_row", "class_id", "key", "u"))
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == brute(odd)
    assert neardup.classes(no_docs).collect() == [] and neardup.keep_one(no_docs).collect() == []


def test_keep_one_leaves_one_row_of_each_class(docs):
    wide = clash(docs, "_hash", "_nth", "_id")
    kept = neardup.keep_one(wide)
    assert kept.columns == wide.columns
    odd = [(r.doc_id, r.text or "") for r in docs.collect()]
    classes = {c for _, c in brute(odd) if c is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(classes) and len(ids) == len(set(ids))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(40):
        h = rng.integers(0, 2**63, 30).astype(np.uint64)
        a, b = rng.integers(0, 9, 30), rng.integers(0, 9, 30)
        b = np.where(rng.random(30) < 0.6, a, b)
        d = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        s = neardup.bag_signatures(d, np.r_[h[a > 0], h[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 512)
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.012 and np.std(gaps) < 0.04


def test_bag_overlap_counts_multiplicity():
    a, b = "a b c d e a b c d e a b c d e", "a b c d e a b c d e x"
    x, y = bag(a), bag(b)
    p, q = neardup.bag(a), neardup.bag(b)
    assert (len(p), len(q), neardup.overlap(p, q)) == (sum(x.values()), sum(y.values()), sum((x & y).values()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (2, 1), *((k, k + 1) for k in range(100, 130))]
    got = {r.vertex: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, **{k: 100 for k in range(100, 131)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []
