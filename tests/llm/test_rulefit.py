from __future__ import annotations

import math
import re
import zlib

import pytest
from llm_support import clash, docs, no_docs, sf  # noqa: F401
from pyspark.sql import functions as F

from sparkwright.llm import catalog, rulefit

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(t):
    t = t or ""
    w, n = WORD.findall(t), len(WORD.findall(t))
    chars = sum(map(len, w))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    held = lambda s: sum(t.count(c) for c in s)
    share = lambda a, b: a / b if b else 0.0
    return (n, share(chars, n), max(map(len, w), default=0), share(len(set(w)), n), share(sum(a == b for a, b in zip(w, w[1:])), n),
            share(held("#*$%&|<>"), chars), share(held("0123456789"), chars), share(held("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars),
            share(held("."), n), share(held(","), n), share(held("!?"), n), share(sum(len(x) == 1 for x in w), n),
            share(n, len(lines)), share(len(lines) - len(set(lines)), len(lines)))


def test_statistics_against_brute_force(spark, sf, docs):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("text").unionByName(docs.select("text"))
    for r in df.select("text", rulefit.statistics(F.col("text")).alias("s")).collect():
        assert tuple(r.s) == pytest.approx(brute(r.text), rel=1e-12)
        assert tuple(r.s.asDict()) == rulefit.NAMES


@pytest.mark.parametrize("size, least", [("sf0.01", 0.97), ("sf0.1", 0.99)])
def test_held_out_accuracy(spark, size, least):
    d = f"/root/testdata/{size}"
    rows = catalog.op12_rulefit(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    for mark in (0, 1):
        of = [r for r in held if r.quality == mark]
        assert sum(r.predicted == mark for r in of) >= (0.9 if mark == 0 else least) * len(of)
    bad, good = ([r.score for r in held if r.quality == m] for m in (0, 1))
    assert sum((b < g) + 0.5 * (b == g) for b in bad for g in good) >= 0.97 * len(bad) * len(good)


def test_compiled_score_against_rules_by_hand(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = rulefit.fit(rulefit.sample(d, spark.read.parquet(f"{sf}/labels.parquet")))
    assert model.rules and len(model.rules) < 200
    for r in d.select("text", model.score(rulefit.statistics(F.col("text"))).alias("score")).collect():
        s = dict(zip(rulefit.NAMES, brute(r.text)))
        margin = model.intercept + sum(w for rule, w in model.rules if all(a < s[n] <= b for n, a, b in rule.bounds))
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-9)


def test_labels_that_say_nothing(spark, docs, no_docs):
    schema = "doc_id long, quality int, toxic int"
    for marks, share in (([], 0.5), ([(1, 1, 0), (2, None, 0), (None, 0, 0), (3, 1, 0), (3, 0, 0)], None)):
        rows = rulefit.score_documents(clash(docs, "s", "score", "label", "words"), spark.createDataFrame(marks, schema)).collect()
        assert len(rows) == docs.count() and len({r.score for r in rows}) == 1 and (share is None or rows[0].score == share)
    assert rulefit.score_documents(no_docs, spark.createDataFrame([], schema)).collect() == []


def test_odd_rows_are_scored(spark, sf, docs):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = rulefit.score_documents(df.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**9)), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert len(rows) == df.count() + docs.count() and all(r.score is not None for r in rows)
    same = {r.score for r in rows if r.doc_id in (10**9, 10**9 + 1)}
    assert len(same) == 1
