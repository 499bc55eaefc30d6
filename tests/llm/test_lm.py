from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_support import clash, docs, no_docs, sf  # noqa: F401
from pyspark.sql import functions as F

from sparkwright.llm import catalog, lm

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_base(docs):
    tokens = [(d, WORD.findall(t.translate(LOW)) + ["\n"]) for d, t in docs]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in docs]
    c = Counter(w for (_, ws), h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
            for (d, ws), h in zip(tokens, held)]


def measured(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-4 * max(1, abs(y[5]))


def test_query_base(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = catalog.op6_lm(spark, sf).collect()
    close(measured(rows), sorted(brute_base(docs), key=str))


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_held_out_texts_are_likelier_than_by_words_alone(spark, size):
    rows = [r for r in catalog.op6_lm(spark, f"/root/testdata/sf{size}").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_rare_words_are_joined(spark, sf, monkeypatch):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    monkeypatch.setattr(lm, "HEAD_SHARE", 1e-3)
    close(measured(lm.score_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()), sorted(brute_base(docs), key=str))


def test_odd_rows(docs, no_docs):
    odd = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = lm.score_documents(clash(docs, "row", "word", "n", "score", "held_out")).collect()
    close(measured(rows), sorted(brute_base(odd), key=str))
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm.score_documents(no_docs).collect() == []


def some_texts(seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join("".join(rng.choice(list("abé"), rng.integers(1, 5))) for _ in range(rng.integers(0, 30))) for _ in range(60)]


def counted(texts, depth):
    parts = [np.unique(code, return_counts=True) for code, _ in lm.grams([lm.words_of(t) for t in texts], depth)]
    return lm.sums(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))


def plain_tree(texts, depth):
    """The same tree as plain dictionaries: next bytes' probabilities of the kept contexts."""
    counts = {}
    for t in texts:
        s = b"\n" * depth + b" ".join(lm.words_of(t)) + b"\n"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts.setdefault(s[i - d:i], Counter())[s[i]] += 1
    every = counts.get(b"", Counter())
    prob = {b"": [(every[b] + 0.5) / (sum(every.values()) + 128) for b in range(256)]}
    for d in range(1, depth + 1):
        for ctx in [c for c in counts if len(c) == d and c[1:] in prob]:
            t, below = counts[ctx], prob[ctx[1:]]
            size = sum(t.values())
            gain = sum(n * math.log(n / size / below[b]) for b, n in t.items())
            if size >= lm.MIN_COUNT and gain > lm.DIVERGENCE * len(t):
                prob[ctx] = [(t[b] + len(t) * below[b]) / (size + len(t)) for b in range(256)]
    return prob


def plain_score(prob, text, depth):
    s = b"\n" * depth + b" ".join(lm.words_of(text)) + b"\n"
    return sum(math.log10(prob[next(s[i - d:i] for d in range(depth, -1, -1) if s[i - d:i] in prob)][s[i]]) for i in range(depth, len(s)))


PROBES = ["", "zzz \x00 日本 abab " + "ab é " * 400, "ab", "\n b  a\t"]


def test_tree_equals_a_plain_one_also_in_pieces(monkeypatch):
    texts = some_texts()
    probes = texts[:20] + PROBES
    prob = plain_tree(texts, 3)
    want = [plain_score(prob, t, 3) for t in probes]
    first, levels, _ = lm.upper_levels(*counted(texts, 3), 3)
    words = [lm.words_of(t) for t in probes]
    assert len(prob) > 10 and np.allclose(lm.Tree(first, levels, 3).score(words), want, rtol=1e-5)
    monkeypatch.setattr(lm, "BYTES_AT_ONCE", 7)
    assert np.allclose(lm.Tree(first, levels, 3).score(words), want, rtol=1e-5)


def test_tree_of_the_table_equals_a_plain_one_in_one_part_or_many(spark, monkeypatch):
    texts = some_texts(2) + PROBES
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, texts[i]) for i in range(5)]
    prob = plain_tree([t for i, t in rows if zlib.crc32(str(i).encode()) % 10], 7)
    want = sorted((i, round(plain_score(prob, t, 7), 3)) for i, t in rows)  # the longest contexts fill 64 bits
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (lm.PART_ROWS, 400):
        monkeypatch.setattr(lm, "PART_ROWS", size)
        got = sorted((r.doc_id, round(r.score, 3)) for r in lm.score_documents(df, 7).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-4, atol=2e-3)


def test_every_context_is_a_distribution():
    prob = plain_tree(some_texts(1), 3)
    assert all(abs(sum(p) - 1) < 1e-9 for p in prob.values())


def test_a_rare_context_of_a_large_corpus_is_kept():
    texts = ["aa bb cc dd"] * 20_000 + ["qx jz"] * 8
    first, levels, _ = lm.upper_levels(*counted(texts, 5), 5)
    alone = lm.Tree(first, {}, 5).score([lm.words_of("qx jz")])[0]
    assert lm.Tree(first, levels, 5).score([lm.words_of("qx jz")])[0] > alone / 2


def test_parts_of_the_tree_by_column_and_in_tasks(spark):
    codes = np.random.default_rng(3).integers(0, 1 << 63, 200, dtype=np.int64)
    key = (codes >> 8) & int(lm.mask(lm.KEY_BYTES - 1))
    got = spark.createDataFrame([(int(k),) for k in key], "key long").select(lm.part_column(F.col("key"), 7).alias("p")).collect()
    assert [r.p for r in got] == lm.part_of(codes.view(np.uint64), 7).tolist()
