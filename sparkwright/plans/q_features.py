"""Catalogue: encoders, scalers, selectors and SQL stages."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features as X
from .common import query, rounded, tbl


@query("q_index_levels", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS p_type_idx FROM part""")
def q_index_levels(spark, d):
    """Alphabetical string index (unseen levels kept as an extra index)."""
    p = tbl(spark, d, "part").select("p_partkey", "p_type")
    return X.index_levels(["p_type"]).fit(p).transform(p).select("p_partkey", "p_type_idx")


@query("q_onehot_dropfirst", """
SELECT p_partkey, CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN -1
                       ELSE CAST(dense_rank() OVER (ORDER BY p_type DESC) - 1 AS INTEGER) END AS active_slot,
       CAST((SELECT count(DISTINCT p_type) FROM part) - 1 AS INTEGER) AS n_slots
FROM part""")
def q_onehot_dropfirst(spark, d):
    """One-hot with the alphabetically first level dropped."""
    p = tbl(spark, d, "part").select("p_partkey", "p_type")
    out = Pipeline(stages=X.one_hot(["p_type"], drop="first", unseen="error")).fit(p).transform(p)
    return out.select("p_partkey", X.first_active("p_type_oh").alias("active_slot"),
                      F.size(vector_to_array("p_type_oh")).alias("n_slots"))


@query("q_minmax", """
SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part))
       / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)), 6) AS price_scaled
FROM part""")
def q_minmax(spark, d):
    """Min-max scaling (fit on the whole table)."""
    p = tbl(spark, d, "part").select("p_partkey", "p_retailprice")
    out = Pipeline(stages=X.minmax("p_retailprice", "_s")).fit(p).transform(p)
    return rounded(out.select("p_partkey", vector_to_array("_s")[0].alias("price_scaled")))


@query("q_standardise", """
WITH s AS (SELECT avg(l_quantity) AS mu, stddev_samp(l_quantity) AS sd, stddev_pop(l_quantity) AS sdp FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mu) / sd, 6) AS z, round((l_quantity - mu) / sdp, 6) AS z_pop
FROM lineitem, s""")
def q_standardise(spark, d):
    """Standard scaling with the sample sd (Spark) and the population sd."""
    li = tbl(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    stages = [X.assemble(["l_quantity"], "_v"), X.standardise("_v", "_z")]
    out = Pipeline(stages=stages).fit(li).transform(li)
    n = li.agg(F.count(F.lit(1)).cast("double")).scalar()
    z = vector_to_array("_z")[0]
    return rounded(out.select("l_orderkey", "l_linenumber", z.alias("z"),
                              (z * F.sqrt(n / (n - 1))).alias("z_pop")))


@query("q_target_encode", """
SELECT l.doc_id, round(avg(CAST(l.quality AS DOUBLE)) OVER (PARTITION BY d.source), 6) AS source_te
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def q_target_encode(spark, d):
    """Target encoding of the document source by the quality label, no smoothing."""
    lab = tbl(spark, d, "labels").join(tbl(spark, d, "documents").select("doc_id", "source"), "doc_id")
    lab = lab.withColumn("quality", F.col("quality").cast("double"))
    m = X.target_encode(["source"], "quality").fit(lab)
    return rounded(m.transform(lab).select("doc_id", "source_te"))


@query("q_target_encode_table", """
SELECT o_orderkey, round((sum(y) OVER (PARTITION BY o_custkey) + 2.0 * (SELECT avg(y) FROM o)) / (count(*) OVER (PARTITION BY o_custkey) + 2.0), 6) AS cust_te
FROM o""".replace("\nSELECT", "\nWITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders)\nSELECT", 1))
def q_target_encode_table(spark, d):
    """X21 by joined level table: customer id, smoothed."""
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(X.target_encode_by_table(o, "o_custkey", "y", smoothing=2.0, out="cust_te").select("o_orderkey", "cust_te"))


@query("q_index_table", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS DOUBLE) AS cust_idx FROM orders""")
def q_index_table(spark, d):
    """X18 by joined level table: customer id."""
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey")
    return X.index_by_table(o, "o_custkey", out="cust_idx").select("o_orderkey", "cust_idx")


_VAR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("q_variance_select", " UNION ALL ".join(
    f"SELECT '{c}' AS feature FROM lineitem HAVING var_samp({c}) > 0.01" for c in _VAR_COLS))
def q_variance_select(spark, d):
    """Names of the slots kept by the variance threshold (sample variance > 0.01)."""
    x = X.assemble(_VAR_COLS).transform(tbl(spark, d, "lineitem").select(*_VAR_COLS))
    m = X.variance_select("features", "kept", 0.01).fit(x)
    return spark.createDataFrame([(_VAR_COLS[i],) for i in m.selectedFeatures], "feature string")


@query("q_sql_stage", """
SELECT doc_id, CAST(length(text) - length(replace(text, '!', '')) AS INTEGER) AS n_excl,
       CAST(len(regexp_split_to_array(text, ' ')) AS INTEGER) AS n_parts
FROM documents""")
def q_sql_stage(spark, d):
    """Per-row SQL statements as pipeline stages."""
    doc = tbl(spark, d, "documents").select("doc_id", "text")
    stages = [X.sql_stage("SELECT *, LENGTH(text) - LENGTH(REPLACE(text, '!', '')) AS n_excl FROM __THIS__"),
              X.sql_stage("SELECT *, SIZE(SPLIT(text, ' ')) AS n_parts FROM __THIS__")]
    return Pipeline(stages=stages).fit(doc).transform(doc).select("doc_id", "n_excl", "n_parts")


@query("q_explode_stage", """
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, ' ')) AS w FROM documents)
GROUP BY doc_id""")
def q_explode_stage(spark, d):
    """Explode inside a pipeline (one row per part), then count per document."""
    doc = tbl(spark, d, "documents").select("doc_id", F.split("text", " ").alias("parts"))
    out = Pipeline(stages=[X.explode_stage("parts", "w")]).fit(doc).transform(doc)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
