"""End-to-end recipes on tables: loans (orders per customer), vehicles (parts), songs (orders by year)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean as K
from ..operators import features as X
from ..operators import metrics as E
from ..operators import models as M
from ..operators import split as S
from ..operators import tune as TU
from ..session import cut_lineage
from .common import query, rounded, tbl

# ------------------------------------------------------------------ loans


def loans_frame(spark, d):
    """Last order of each customer, features of the earlier ones (zero where there are none, T14),
    customer attributes, label: the last order is finished."""
    o = tbl(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    last = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")).alias("x")) \
        .select("o_custkey", F.col("x.o_orderkey").alias("last_key"), F.col("x.o_orderdate").alias("last_date"),
                F.col("x.o_totalprice").alias("amount"), (F.col("x.o_orderstatus") == "F").cast("double").alias("label"))
    before = o.join(last.select("o_custkey", "last_key", "last_date"), "o_custkey").where(F.col("o_orderkey") != F.col("last_key"))
    past = before.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_before"), F.avg("o_totalprice").alias("mean_before"), F.max("o_totalprice").alias("max_before"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share_finished"),
        F.max(F.datediff("last_date", "o_orderdate")).cast("long").alias("days_known"))
    c = tbl(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    wide = last.join(past, "o_custkey", "left").withColumn("has_history", F.col("n_before").isNotNull().cast("int"))
    wide = wide.na.fill(0, ["n_before", "mean_before", "max_before", "share_finished", "days_known"])
    return wide.join(c, "o_custkey", "left")


@query("r_loans_features", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
l AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus FROM o WHERE rn = 1),
p AS (SELECT o.o_custkey, count(*) AS n_before, avg(o.o_totalprice) AS mean_before, max(o.o_totalprice) AS max_before,
        avg(CASE WHEN o.o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share_finished,
        max(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.o_orderdate AS DATE))) AS days_known
      FROM o JOIN l ON o.o_custkey = l.o_custkey WHERE o.rn > 1 GROUP BY o.o_custkey)
SELECT l.o_custkey, round(l.o_totalprice, 6) AS amount, CASE WHEN l.o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS label,
  coalesce(n_before, 0) AS n_before, round(coalesce(mean_before, 0), 6) AS mean_before, round(coalesce(max_before, 0), 6) AS max_before,
  round(coalesce(share_finished, 0), 6) AS share_finished, coalesce(days_known, 0) AS days_known,
  CAST(n_before IS NOT NULL AS INTEGER) AS has_history, c_mktsegment, round(c_acctbal, 6) AS c_acctbal
FROM l LEFT JOIN p ON l.o_custkey = p.o_custkey LEFT JOIN customer ON c_custkey = l.o_custkey""")
def r_loans_features(spark, d):
    """Loans recipe, feature stage: latest row per key, history of the earlier rows, attributes."""
    return rounded(loans_frame(spark, d).drop("last_key", "last_date"))


@query("r_loans", """
WITH c AS (SELECT DISTINCT o_custkey FROM orders)
SELECT CAST(count_if((o_custkey * 7919 + 104729) % 10000 >= 7500) AS BIGINT) AS n_scored, true AS in_range FROM c""")
def r_loans(spark, d):
    """Loans recipe, model stage: one-hot segment, forest on the training part, probabilities of the test part."""
    x = cut_lineage(loans_frame(spark, d))
    train, test = S.split_random(x, "o_custkey", [0.75, 0.25], seed=1, method="mod")
    pipe = X.column_transformer(["c_mktsegment"], ["amount", "mean_before", "days_known"], ["n_before", "share_finished", "has_history"])
    stages = pipe.fit(train)
    model, _ = M.random_forest(stages.transform(train), "features", "label", trees=100, depth=4)
    out = M.submission(model.transform(stages.transform(test)), "o_custkey", "p")
    return out.agg(F.count(F.lit(1)).alias("n_scored"), F.min(F.col("p").between(0, 1)).alias("in_range"))


# --------------------------------------------------------------- vehicles


def vehicles_frame(spark, d):
    """Parts inside the price quantiles, rare brands collapsed, a missing size as its own level and a flag."""
    p = tbl(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.nullif("p_size", F.lit(13)).alias("p_size"), "p_retailprice")
    p = K.trim_quantiles(p, "p_retailprice", 0.01, 0.99)
    p = p.withColumns({"size_missing": F.col("p_size").isNull().cast("int"), "size": F.coalesce(F.col("p_size"), F.lit(0)).cast("double")})
    return K.collapse_levels(p, "p_brand", top_n=10, out="brand")


@query("r_vehicles_features", """
WITH t AS (SELECT p_partkey, p_brand, p_type, nullif(p_size, 13) AS p_size, p_retailprice FROM part
  WHERE p_retailprice > (SELECT quantile_cont(p_retailprice, 0.01) FROM part)
    AND p_retailprice < (SELECT quantile_cont(p_retailprice, 0.99) FROM part)),
top AS (SELECT p_brand FROM t GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10)
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'others' END AS brand, p_type,
  CAST(p_size IS NULL AS INTEGER) AS size_missing, CAST(coalesce(p_size, 0) AS DOUBLE) AS size FROM t""")
def r_vehicles_features(spark, d):
    """Vehicles recipe, feature stage: strict quantile trim (F9), top levels (N9), missing values."""
    return rounded(vehicles_frame(spark, d).select("p_partkey", "brand", "p_type", "size_missing", "size"))


@query("r_vehicles", """
WITH t AS (SELECT p_partkey FROM part
  WHERE p_retailprice > (SELECT quantile_cont(p_retailprice, 0.01) FROM part)
    AND p_retailprice < (SELECT quantile_cont(p_retailprice, 0.99) FROM part))
SELECT CASE WHEN (p_partkey * 7919 + 2 * 104729) % 10000 < 8000 THEN 'train' ELSE 'test' END AS part, count(*) AS n, true AS sound
FROM t GROUP BY 1""")
def r_vehicles(spark, d):
    """Vehicles recipe, model stage: one-hot (first level dropped), least squares, E11 on train and on test:
    a fit explains no less than the mean does on its training rows, and errors are finite on both."""
    x = cut_lineage(vehicles_frame(spark, d).withColumn("price", F.col("p_retailprice")))
    train, test = S.split_random(x, "p_partkey", [0.8, 0.2], seed=2, method="mod")
    pipe = X.column_transformer(["brand", "p_type"], ["size"], ["size_missing"]).fit(train)
    model, fitted = M.linear(pipe.transform(train).select("price", "features"), "features", "price", reg=1e-6)
    out = None
    for name, rows, least in (("train", fitted, 0.0), ("test", model.transform(pipe.transform(test)), -0.5)):
        s = E.regression_scores(rows.select("price", "prediction"), "price", "prediction")
        s = s.select(F.lit(name).alias("part"), "n", ((F.col("r2") >= least - 1e-9) & (F.col("r2") <= 1) & (F.col("rmse") >= F.col("mae"))).alias("sound"))
        out = s if out is None else out.unionByName(s)
    return out


# ------------------------------------------------------------------ songs


def songs_frame(spark, d):
    """Orders with numeric features and a rare label, split by year: the last two years are the test."""
    o = tbl(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    li = tbl(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))
    o = o.join(li, "o_orderkey").withColumns({
        "yr": F.year("o_orderdate"), "label": (F.col("qty") > 150).cast("double"), "urgent": (F.col("o_orderpriority") == "1-URGENT").cast("int")})
    return o


@query("r_songs", """
WITH q AS (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey),
t AS (SELECT CASE WHEN qty > 150 THEN 1 ELSE 0 END AS y FROM orders JOIN q ON o_orderkey = l_orderkey WHERE year(o_orderdate) > 1999)
SELECT unnest(['l1', 'l2']) AS penalty, (SELECT count(*) FROM t) AS n_test, (SELECT CAST(sum(y) AS BIGINT) FROM t) AS n_positive, true AS auc_above_bound""")
def r_songs(spark, d):
    """Songs recipe: split by year (M3), scaled pipeline, C path with L1 and L2 (M11), AUC on the test years."""
    x = songs_frame(spark, d).select("o_orderkey", "yr", "label", "lines", F.col("o_totalprice").alias("price"), "disc",
                                     F.col("urgent").cast("double").alias("urgent"))
    x = cut_lineage(S.stratified_folds(x, "o_orderkey", "label", 5, method="mod"))
    train, test = S.split_by_year(x, "yr", 1999)
    scale = Pipeline(stages=[X.assemble(["lines", "price", "disc", "urgent"], "raw"),
                             StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(train)
    train, test = cut_lineage(scale.transform(train)), scale.transform(test)
    n = train.count()
    out = None
    for penalty, elastic in (("l1", 1.0), ("l2", 0.0)):
        lr = LogisticRegression(labelCol="label", elasticNetParam=elastic)
        best = TU.grid_cv(lr, {lr.regParam: [M.reg_param_for_c(c, n) for c in TU.c_path(5)]}, train, "fold", parallelism=8).bestModel
        scored = cut_lineage(best.transform(test).withColumn("p1", C.positive_prob("probability")).select("label", "p1"))
        n_test = scored.agg(F.count(F.lit(1))).scalar()
        n_pos = scored.agg(F.sum("label").cast("long")).scalar()
        row = E.auc(scored, "label", "p1").select(F.lit(penalty).alias("penalty"), n_test.alias("n_test"), n_pos.alias("n_positive"),
                                                  (F.col("auc") >= 0.8).alias("auc_above_bound"))
        out = row if out is None else out.unionByName(row)
    return out
