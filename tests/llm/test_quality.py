from __future__ import annotations

import re
from collections import Counter

from llm_support import clash, docs, no_docs, sf  # noqa: F401

from sparkwright.llm import catalog, quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(t):
    w = WORD.findall(t)
    n = len(w)
    lines = [a for a in t.split("\n") if WORD.search(a)]
    grams = [tuple(w[k:k + 8]) for k in range(n - 7)]
    seen = Counter(grams)
    covered = {j for k, g in enumerate(grams) if seen[g] > 1 for j in range(k, k + 8)}
    return (n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def measured(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_query_against_brute_force(spark, sf):
    rows = {r.doc_id: r for r in catalog.op8_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert measured(rows[d.doc_id]) == brute(d.text or "")
        assert not (rows[d.doc_id].base_failed and rows[d.doc_id].kept)


def test_clean_documents_stay(spark, sf):
    kept = {r.doc_id: r.kept for r in catalog.op8_quality(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1 and not brute(docs[r.doc_id])[-1]]
    assert sum(kept[r.doc_id] for r in good) >= 0.98 * len(good)


def test_odd_rows(docs, no_docs):
    rows = quality.ledger(clash(docs, "m", "bits", "n_words", "e")).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for d in docs.collect():
        if d.doc_id is not None:
            got, want = by[d.doc_id], brute(d.text or "")
            assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want[:5]
    assert quality.ledger(no_docs).collect() == [] and quality.keep(no_docs).collect() == []


def test_repeats_that_overlap_and_touch(spark):
    a = " ".join(f"a{i}" for i in range(10))
    texts = [a + " " + a, "x " * 30, a + " q " + a, " ".join(f"z{i}" for i in range(7)) * 2, "w"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.ledger(df).collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_policy_and_ablation_follow_the_bits(spark, sf):
    led = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    bits = [r.bits for r in led.collect()]
    mask = quality.PRODUCTION.mask()
    for r in quality.ablations(led).collect():
        b = 1 << [x.name for x in quality.RULES].index(r.rule)
        assert r.n_docs == len(bits) and r.n_failed == sum(bool(x & b) for x in bits)
        assert r.n_failed_alone == sum(x & mask == b for x in bits)
        assert r.n_kept_without == sum(x & mask & ~b == 0 for x in bits)


def test_keep_leaves_all_columns(docs):
    wide = clash(docs, "bits", "m")
    kept = quality.keep(wide)
    assert kept.columns == wide.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if not brute(r.text or "")[-1]}


def test_query_against_sql(spark, sf):
    from oracle_harness import compare, duck
    r = compare(spark, duck(sf), "op8_quality", catalog.op8_quality, catalog.oracle_sql()["op8_quality"], sf)
    assert r["status"] == "ok", r
