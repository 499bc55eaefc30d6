from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pytest
from llm_support import clash, docs, no_docs, sf  # noqa: F401

from sparkwright.llm import catalog, periodic

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(w):
    """Runs by definition: every lag's maximal matches, smallest period only."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q):
                stretch = w[start:start + length]
                if not any(all(stretch[k] == stretch[k - p] for k in range(p, length)) for p in range(1, q)):
                    out[start, q] = length
            i = j
    return [(s, n, q) for (s, q), n in sorted(out.items())]


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    left = " ".join(x for k, x in enumerate(w) if k not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (None,) * 4 if best is None else (*best, best[1] * 1000 // best[2])
    return (len(runs), *four, sha(listed), sha(left))


def got(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_query_against_brute_force(spark, sf):
    rows = {r.doc_id: r for r in catalog.op13_periodic(spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    assert sum(r.n_runs > 0 for r in rows.values()) > 10
    for d in texts:
        assert got(rows[d.doc_id]) == expected(d.doc_id, d.text), d.doc_id


def test_odd_rows(docs, no_docs):
    rows = periodic.digests(clash(docs, "runs", "collapsed", "best", "a", "n_runs")).collect()
    assert sorted(map(str, map(got, rows))) == sorted(str(expected(d.doc_id, d.text)) for d in docs.collect())
    assert periodic.digests(no_docs).collect() == []
    with pytest.raises(ValueError):
        periodic.add_runs(clash(docs, "runs"))


@pytest.mark.parametrize("seed", range(6))
def test_random_words(seed):
    r = random.Random(seed)
    for _ in range(250):
        w = []
        while len(w) < r.choice([8, 30, 90, 250]):
            block = [r.choice("ab" if r.random() < 0.6 else "abcdefgh") for _ in range(r.randint(1, 14))]
            w += block * r.choice([1, 1, 2, 3, 4, 5, 9]) + block[:r.randint(0, len(block))]
        assert periodic.find(w) == brute(w), w


def test_nested_and_neighbouring_runs():
    inner = ["a"] * 7 + ["b"]
    texts = [inner * 5, ["x"] * 6 + ["y"] * 6, list("abab") * 3 + list("cabcab") * 4, ["z"] * 5, list("abcabcabca"),
             list("abcabcabcabc"), [str(i) for i in range(50)] * 4, ([str(i) for i in range(50)] * 4)[:-1]]
    for w in texts:
        assert periodic.find(w) == brute(w)


def test_ranges_hold_every_lag():
    for n in (6, 16, 100, 12345):
        ranges = periodic.lag_ranges(n)
        for q in range(1, n // 4 + 1):
            size = [s for s, low, high in ranges if low <= q <= high]
            assert len(size) == 1 and 2 * q - 1 <= size[0] <= max(3 * q, 5)


def test_long_texts_take_time_in_proportion():
    for w in (["one"] * 200_000, ["a", "b"] * 100_000, [str(i % 40_000) for i in range(200_000)]):
        t = time.perf_counter()
        runs = periodic.find(w)
        assert time.perf_counter() - t < 20 and runs[0][:2] == (0, 200_000)
