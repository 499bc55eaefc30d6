from __future__ import annotations

import corpus_pipeline
from llm_support import clash, docs, no_docs, sf  # noqa: F401
from test_neardup import brute as near_classes
from test_packing import check
from test_quality import brute as quality

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwright.llm import toxicity


def test_stages_against_brute_force(spark, sf):
    """Each stage's rows from its predecessor's, and the packed rows of the last."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "minhash_near_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf).cache())
    start, calm, good, single = (sorted(map(tuple, s.collect())) for s in steps[:4])
    assert all(s.columns == docs.columns for s in steps[:4])
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert calm == [r for r in start if not scores[r[0]]]
    assert set(good) <= set(calm)
    assert all(quality(r[1])[-1] for r in set(calm) - set(good) if not set("#*$%&|<>!") & set(r[1]) and not r[1].isupper()
               and len(set(r[1].split())) > 0.5 * len(r[1].split()))
    classes = near_classes([(r[0], r[1]) for r in good])
    assert [r[0] for r in single] == sorted({c for _, c in classes})
    check(steps[4].collect(), [(r[0], r[1]) for r in single], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_run_applies_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_on_odd_rows(spark, sf, docs, no_docs):
    wide = clash(docs, "score", "bits", "_hash", "piece")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns
        out.count()
        assert stage(spark, no_docs, sf).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, sf).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf).agg(F.sum("length")).first()[0] > 0
