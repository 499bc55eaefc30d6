"""Catalogue: sources, sinks and column selection over whole tables.

Written copies go under the shared checkpoint folder, as any intermediate does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import profile as P
from ..session import checkpoint_dir
from ..sources import io
from .common import query, rounded, tbl


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


@query("q_catalog", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_catalog(spark, d):
    """A table by its catalog name."""
    name = f"nation_{uuid.uuid4().hex}"
    tbl(spark, d, "nation").createOrReplaceTempView(name)
    return io.load_table(spark, name).select("n_nationkey", "n_name", "n_regionkey")


@query("q_csv", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders""")
def q_csv(spark, d):
    """Orders written as CSV files with a header and read back by schema, the date column parsed."""
    path = _folder(spark, "csv")
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                       F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss.SSSSSS").alias("o_orderdate"))
    o.write.option("header", True).csv(path)
    back = io.read_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string",
                       date_cols=["o_orderdate"], date_format="dd/MM/yyyy HH:mm:ss.SSSSSS")
    return back.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("q_csv_latin", """
SELECT doc_id, nullif(regexp_extract(text, '[A-Za-zÀ-ÿ]+', 0), '') AS first_word FROM documents""")
def q_csv_latin(spark, d):
    """S3: the first word of every document through ISO-8859-1 files; umlauts and accents come back."""
    path = _folder(spark, "latin")
    w = tbl(spark, d, "documents").select("doc_id", F.regexp_extract("text", "[A-Za-zÀ-ÿ]+", 0).alias("first_word"))
    w.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    back = io.read_csv(spark, path, "doc_id long, first_word string", encoding="ISO-8859-1")
    return back.withColumn("first_word", F.nullif("first_word", F.lit("")))


@query("q_checkpoint", """
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY l_orderkey""")
def q_checkpoint(spark, d):
    """An intermediate saved under the shared folder and read again."""
    g = tbl(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    return rounded(io.checkpoint_table(g, "order-lines"))


@query("q_shape", """
SELECT column_name AS "column", CAST(row_number() OVER () - 1 AS INTEGER) AS place, (SELECT count(*) FROM orders) AS n_rows
FROM (DESCRIBE orders)""")
def q_shape(spark, d):
    """Rows and columns of a table, a row per column in schema order."""
    shape = io.profile_shape(tbl(spark, d, "orders"))
    return spark.createDataFrame([(c, i, shape["rows"]) for i, c in enumerate(shape["dtypes"])], '`column` string, place int, n_rows long')


@query("q_preview", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 5")
def q_preview(spark, d):
    """The last five parts by price and key, the preview of an ordered table."""
    return io.tail(tbl(spark, d, "part"), 5, ["p_retailprice", "p_partkey"]).select("p_partkey", "p_name", "p_retailprice")


@query("q_sample", """
SELECT event_id, event_type FROM events WHERE (event_id * 7919 + 3 * 104729) % 10000 < 1000""")
def q_sample(spark, d):
    """A tenth of all events by key hash: the same rows whatever the partitions (the sampling operator itself)."""
    return io.sample(tbl(spark, d, "events"), 0.1, seed=3, key="event_id", method="mod").select("event_id", "event_type")


@query("q_sanitize", """
SELECT c_custkey AS customerkey, c_name AS fullname, c_mktsegment AS marketsegment FROM customer""")
def q_sanitize(spark, d):
    """Column names without blanks, dashes, slashes, quotes and commas."""
    c = tbl(spark, d, "customer").select(F.col("c_custkey").alias("customer-key"), F.col("c_name").alias("full name,"),
                                         F.col("c_mktsegment").alias("market/seg'ment"))
    return C.sanitize_names(c)


@query("q_feature_cols", "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_feature_cols(spark, d):
    """All columns but keys and names, in schema order."""
    c = tbl(spark, d, "customer")
    return c.select(*C.feature_cols(c, ["c_custkey", "c_name"]))


@query("q_transpose", """
WITH m AS (SELECT quality, CAST(count(*) AS DOUBLE) AS n, avg(toxic) AS toxic_share FROM labels GROUP BY quality)
SELECT 'n' AS key, max(n) FILTER (quality = 0) AS "0", max(n) FILTER (quality = 1) AS "1" FROM m
UNION ALL SELECT 'toxic_share', round(max(toxic_share) FILTER (quality = 0), 6), round(max(toxic_share) FILTER (quality = 1), 6) FROM m""")
def q_transpose(spark, d):
    """P10: a class by metric frame turned into metric by class (two rows wide, whatever the table)."""
    m = tbl(spark, d, "labels").groupBy(F.col("quality").cast("string").alias("quality")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("toxic").alias("toxic_share"))
    return rounded(C.transpose_metrics(m, "quality"))


@query("q_sparse_cols", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS some FROM orders""")
def q_sparse_cols(spark, d):
    """Columns with more than 40 % nulls go, one with 20 % stays."""
    k = F.col("o_orderkey")
    o = tbl(spark, d, "orders").select("o_orderkey", F.when(k % 5 != 0, F.col("o_custkey")).alias("some"),
                                       F.when(k % 2 == 0, F.col("o_totalprice")).alias("half"), F.lit(None).cast("int").alias("none"))
    return P.drop_sparse_cols(o, 0.4)
