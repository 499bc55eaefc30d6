"""Corpus pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its
predecessor kept and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All stages but the last return the
columns of ``documents`` unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkwright.llm import neardup, packing, quality, toxicity
from sparkwright.llm.catalog import tokenizer_path
from sparkwright.llm.common import table
from sparkwright.session import checkpoint_dir


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production quality policy."""
    return quality.keep(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the kept documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity_filter), ("quality_rules", quality_rules),
          ("minhash_near_dedup", minhash_near_dedup), ("best_fit_packing", best_fit_packing)]

# Learned scores, hashed signatures and tokenizer ids have no SQL form; the
# stages are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each stage returns is written
    under the shared checkpoint folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
