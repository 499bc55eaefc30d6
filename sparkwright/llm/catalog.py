"""Contract queries over the operators of this package, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, html, lm, neardup, packing, periodic, quality, rulefit, sentencepieces, sharding, toxicity, whitening
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards by jump consistent hashing of its id."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 16)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in budgeted windows, read back; conversation -1 says control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_windows(turns.unionByName(extra)))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest inner product for every row whose vec_id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = html.extract_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the suffix tree of the training documents."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates (five-word shingles, 0.8) of every document."""
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, failure bits and verdict of every document."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(F.col("bits"), quality.BASE)).alias("base_failed"),
        quality.passes(F.col("bits"), quality.PRODUCTION).alias("kept"),
        "n_stuttered", "n_shouted", F.col("bits").alias("failure_bits"), F.lit(quality.PRODUCTION.name).alias("policy"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the SentencePiece model, and what they decode to."""
    rows = sentencepieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_tokens", "ids_crc32", F.length("decoded").cast("long").alias("decoded_chars"),
                       F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 32 strongest components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_rulefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    return rulefit.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, and what is left without their repeats."""
    return periodic.digests(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (
        op1_sharding, op2_chat, op3_ann, op4_packing, op5_html, op6_lm, op7_neardup, op8_quality, op9_toxicity,
        op10_sentencepiece, op11_whitening, op12_rulefit, op13_periodic)}


_SPACE = "[\\x20\\x09-\\x0D]"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM u) WHERE c > 1),
gaps AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice),
covered AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM gaps GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS BIGINT) AS n_stuttered,
    CAST(len(list_filter(ws, lambda x: x = upper(x) AND x <> lower(x))) AS BIGINT) AS n_shouted
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
b AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (n_repeat_words * 100 > n_words * 30)::INT + 4 * (n_symbols * 100 > word_chars * 5)::INT
    + 8 * (n_stuttered * 100 > n_words * 30)::INT + 16 * (n_shouted * 100 > n_words * 50)::INT
    + 32 * (n_dup_lines * 100 > n_words * 10)::INT AS BIGINT) AS failure_bits FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
  (failure_bits & 31) = 0 AS kept, n_stuttered, n_shouted, failure_bits, 'web-1' AS policy FROM f"""


def oracle_sql():
    return {"op8_quality": OP8_SQL}
