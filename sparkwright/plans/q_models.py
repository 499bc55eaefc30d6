"""Catalogue: learners, inference, tuning and scoring.

Model fits have no SQL oracle (rows-only checks) except where a closed
form exists (VIF with two predictors, a one-feature OLS slope). The
document feature table is built from whole texts by native expressions.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import features as X
from ..operators import models as M
from ..operators import split as S
from ..operators import stats as ST
from ..operators import text as T
from ..operators import tune as TU
from ..operators.profile import attach_class_weights
from ..session import cut_lineage
from .common import ROUND_NUDGE, query, rounded, tbl

DOC_FEATURES = ["n_chars_k", "n_excl", "n_sentences", "n_caps", "polarity", "subjectivity", "compound"]


def doc_features(spark, d):
    """Labelled documents with numeric text features (whole texts, in-row)."""
    doc = tbl(spark, d, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    doc = T.sentiment(doc, "text")
    doc = doc.select("doc_id", "source", "lang", (F.col("n_chars") / 1000.0).alias("n_chars_k"),
                     TX.count_char("text", "!").cast("double").alias("n_excl"),
                     TX.sentence_count("text").cast("double").alias("n_sentences"),
                     TX.capital_token_count("text").cast("double").alias("n_caps"),
                     "polarity", "subjectivity", "compound")
    lab = tbl(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"),
                                         F.col("toxic").cast("double").alias("toxic"))
    out = S.stratified_folds(doc.join(lab, "doc_id"), "doc_id", "label", 5, method="mod")
    # iterative fits read this table many times: cut the lineage once
    # (reliable checkpoint in the shared folder) instead of recomputing
    # the text features on every optimiser pass
    return cut_lineage(out)


def _p1(df, out="p1"):
    return M.positive_prob_col(df, out=out)


@query("q_logit")
def q_logit(spark, d):
    """M9 (no penalty, no intercept) + M10 (ridge): positive-class probabilities."""
    x = doc_features(spark, d)
    _m0, p0 = M.logit(x, DOC_FEATURES, "label", reg=0.0, intercept=False)
    _m1, p1 = M.logit(x, DOC_FEATURES, "label", reg=0.1, elastic=0.0)
    a = _p1(p0, "p_plain").select("doc_id", "p_plain")
    b = _p1(p1, "p_ridge").select("doc_id", "p_ridge")
    return a.join(b, "doc_id")


@query("q_logit_path")
def q_logit_path(spark, d):
    """L1 and L2 logistic over the full 10-value C path (1e-4 to 1e4) in a scaled pipeline, 5 folds;
    all models of a penalty advance together, one pass over the data per Newton step."""
    from ..operators import paths as PA
    x = doc_features(spark, d)
    s = x.agg(*[f(c).alias(f"{c}_{n}") for c in DOC_FEATURES for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    x = x.select("label", "fold", *[((F.col(c) - s[f"{c}_mean"]) / (s[f"{c}_sd"] or 1.0)).alias(c) for c in DOC_FEATURES])
    rows = []
    for penalty, elastic in (("l1", 1.0), ("l2", 0.0)):
        path = PA.logit_path(x, DOC_FEATURES, "label", TU.c_path(10), elastic, "fold")
        rows += [(penalty, *r) for r in PA.path_rows(path)]
    return spark.createDataFrame(rows, "penalty string, c_index int, c double, feature string, coef double, cv_accuracy double, "
                                       "cv_log_loss double, best boolean")


@query("q_forest")
def q_forest(spark, d):
    """Random forest (100 trees, depth 4, 32 bins)."""
    _m, p = M.random_forest(doc_features(spark, d), DOC_FEATURES, "label", trees=100, depth=4, bins=32)
    return _p1(p).select("doc_id", "p1", "prediction")


@query("q_tree")
def q_tree(spark, d):
    """M13 + A23: decision tree with balanced class weights."""
    x = attach_class_weights(doc_features(spark, d), "label", "w")
    _m, p = M.decision_tree(x, DOC_FEATURES, "label", depth=4, weight="w")
    return p.select("doc_id", "prediction", "w")


@query("q_mlp")
def q_mlp(spark, d):
    """Multilayer perceptron with layer sizes taken from the data."""
    x = X.assemble(DOC_FEATURES, "raw").transform(doc_features(spark, d))
    from pyspark.ml.feature import StandardScaler
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    _m, p = M.mlp(x, "features", "label", hidden=(5,))
    return p.select("doc_id", "prediction")


@query("q_gbt")
def q_gbt(spark, d):
    """Gradient-boosted trees (re-aim of the boosting libraries)."""
    _m, p = M.gbt(doc_features(spark, d), DOC_FEATURES, "label", rate=0.1, depth=3)
    return _p1(p).select("doc_id", "p1")


@query("q_svm")
def q_svm(spark, d):
    """Linear SVM."""
    _m, p = M.linear_svm(doc_features(spark, d), DOC_FEATURES, "label", c=1.0)
    return p.select("doc_id", "prediction")


@query("q_adaboost")
def q_adaboost(spark, d):
    """AdaBoost with stumps (weighted trees, lineage cut per round)."""
    _ls, p = M.adaboost(doc_features(spark, d), DOC_FEATURES, "label")
    return p.select("doc_id", "ada_score", "prediction")


def stack_bases():
    from pyspark.ml import classification as MC
    kinds = [("lr", MC.LogisticRegression, {}), ("dt", MC.DecisionTreeClassifier, {"maxDepth": 3}),
             ("rf", MC.RandomForestClassifier, {"numTrees": 50, "maxDepth": 4, "seed": 7}),
             ("gb", MC.GBTClassifier, {"maxIter": 20, "maxDepth": 3, "seed": 7})]
    return [(n, lambda tr, k=k, o=o: k(featuresCol="features", labelCol="label", **o).fit(tr)) for n, k, o in kinds]


@query("q_stack", """
SELECT l.doc_id, CAST(1 AS BIGINT) AS n_oof, true AS in_range FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def q_stack(spark, d):
    """Stacking on out-of-fold base probabilities (T15), meta logistic regression: every row has
    one set of out-of-fold probabilities, and the stacked model scores the rows anew."""
    x = doc_features(spark, d)
    model, oof = M.stack(x, DOC_FEATURES, "label", "fold", stack_bases())
    n = oof.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_oof"))
    fresh = _p1(model.transform(x.drop("label", "fold"))).select("doc_id", F.col("p1").between(0, 1).alias("in_range"))
    return n.join(fresh, "doc_id")


_KNN_SPLIT = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, (vec_id * 7919) % 10 AS part FROM embeddings),
p AS (SELECT q.vec_id AS query_id, t.vec_id AS id, t.label, list_distance(q.v, t.v) AS distance
  FROM e q JOIN e t ON q.part >= 7 AND t.part < 7),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS "rank" FROM p QUALIFY "rank" <= 16)"""


def _knn_split(spark, d):
    e = tbl(spark, d, "embeddings").withColumn("part", S.hash_bucket("vec_id", 10, method="mod"))
    return e.where(F.col("part") < 7), e.where(F.col("part") >= 7)


@query("q_knn", _KNN_SPLIT + """
SELECT query_id, "rank", id, round(distance, 6) AS distance FROM r""")
def q_knn(spark, d):
    """Exact 16 nearest training vectors (70 %) of every held-out one, by the pruned join."""
    from ..operators import knn
    train, test = _knn_split(spark, d)
    return rounded(knn.neighbours(test, train, 16, "vec_id", "embedding", "label").select("query_id", "rank", "id", "distance"))


@query("q_knn_vote", _KNN_SPLIT + """,
c AS (SELECT query_id, label, count(*) AS n FROM r GROUP BY 1, 2),
w AS (SELECT query_id, label, n, sum(n) OVER (PARTITION BY query_id) AS of,
  row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS k FROM c)
SELECT query_id, CAST(label AS DOUBLE) AS prediction, round(n / of, 6) AS share FROM w WHERE k = 1""")
def q_knn_vote(spark, d):
    """Label of every held-out vector by the vote of its 16 nearest training vectors (ties to the smaller label)."""
    from ..operators import knn
    train, test = _knn_split(spark, d)
    return rounded(knn.classify(train, test, "label", 16, "vec_id", "embedding"))


@query("q_stack_probs")
def q_stack_probs(spark, d):
    """Out-of-fold probabilities of the four base learners and the meta model's, per document."""
    _model, oof = M.stack(doc_features(spark, d), DOC_FEATURES, "label", "fold", stack_bases())
    return _p1(oof).select("doc_id", "lr", "dt", "rf", "gb", F.col("p1").alias("meta"))


@query("q_cv")
def q_cv(spark, d):
    """M7: grid CV (AUC) over depth of a random forest held in the pipeline."""
    from pyspark.ml.classification import RandomForestClassifier
    x = X.assemble(DOC_FEATURES).transform(doc_features(spark, d))
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=100, seed=7)
    cvm = TU.grid_cv(rf, {rf.maxDepth: [2, 3, 4, 5]}, x, "fold", parallelism=4)
    return spark.createDataFrame([(i, float(m)) for i, m in enumerate(cvm.avgMetrics)], "grid_point int, auc double")


@query("q_search")
def q_search(spark, d):
    """M8: 200 draws over learning rate (log), depth and leaf size of boosted trees, by successive halving; a row
    per draw and rung with its AUC."""
    from pyspark.ml.classification import GBTClassifier
    x = X.assemble(DOC_FEATURES).transform(doc_features(spark, d)).select("features", "label", "fold")
    space = {"stepSize": ("logfloat", 0.0001, 0.1), "maxDepth": ("int", 2, 8, 1), "minInstancesPerNode": ("int", 50, 110, 2)}
    _best, _score, rows = TU.halving_search(
        lambda p: GBTClassifier(featuresCol="features", labelCol="label", seed=7, **p), space, x, "fold", n_trials=200)
    return spark.createDataFrame(
        [(t, r, m, k, float(s), float(p["stepSize"]), p["maxDepth"], p["minInstancesPerNode"]) for t, r, m, k, s, p in rows],
        "trial int, rung int, rounds int, folds int, mean_auc double, step_size double, max_depth int, min_leaf int")


@query("q_ols_pvalues")
def q_ols_pvalues(spark, d):
    """OLS of per-order revenue with standard errors and p-values (intercept last)."""
    x = cut_lineage(order_revenue(spark, d))
    return ST.ols(x, ["gross", "avg_disc", "avg_tax", "n_lines"], "revenue")


@query("q_ols_slope", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS coef, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept
FROM lineitem""")
def q_ols_slope(spark, d):
    """M21 one-feature check against the closed form."""
    t = ST.ols(tbl(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return rounded(t.agg(F.max(F.when(F.col("feature") == "l_quantity", F.col("coef"))).alias("coef"),
                         F.max(F.when(F.col("feature") == "intercept", F.col("coef"))).alias("intercept")), 4)


@query("q_ols_inference", """
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, corr(l_extendedprice, l_quantity) AS r, count(*) AS n,
  stddev_samp(l_extendedprice) / stddev_samp(l_quantity) AS ratio FROM lineitem)
SELECT round(b, 4) AS coef, round(sqrt((1 - r * r) / (n - 2)) * ratio, 4) AS std_err, round(b / (sqrt((1 - r * r) / (n - 2)) * ratio), 3) AS t FROM s""")
def q_ols_inference(spark, d):
    """Coefficient, standard error and t of a one-feature OLS against their closed forms."""
    t = ST.ols(tbl(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice").where("feature = 'l_quantity'")
    nudged = lambda c, k: F.round(F.lit(ROUND_NUDGE) + F.col(c), k).alias(c)
    return t.select(nudged("coef", 4), nudged("std_err", 4), nudged("t", 3))


_TABLE_SQL = """
WITH c AS (SELECT count(*) FILTER (x AND y) AS a, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c,
  count(*) FILTER (NOT x AND NOT y) AS d FROM (SELECT l_discount > 0.05 AS x, l_quantity * 1000 + l_extendedprice > 60000 AS y FROM lineitem)),
l AS (SELECT ln(a * 1.0 / b) - ln(c * 1.0 / d) AS coef, ln(c * 1.0 / d) AS intercept, sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d) AS se FROM c)"""


def _two_by_two(spark, d):
    li = tbl(spark, d, "lineitem")
    return cut_lineage(li.select((F.col("l_discount") > 0.05).cast("double").alias("x"),
                                 (F.col("l_quantity") * 1000 + F.col("l_extendedprice") > 60000).cast("double").alias("y")))


@query("q_odds_closed", _TABLE_SQL + """
SELECT round(coef, 3) AS coef, round(intercept, 3) AS intercept, round(exp(coef), 3) AS odds_ratio, round((exp(coef) - 1) * 100, 2) AS pct_change FROM l""")
def q_odds_closed(spark, d):
    """A logistic fit on one binary feature is the log odds ratio of its two-by-two table."""
    m, _p = M.logit(_two_by_two(spark, d), ["x"], "y", max_iter=200)
    nudged = lambda c, k: F.round(F.lit(ROUND_NUDGE) + c, k)
    return ST.odds_table(m, ["x"], spark).select(
        nudged(F.col("coef"), 3).alias("coef"), nudged(F.lit(float(m.intercept)), 3).alias("intercept"),
        nudged(F.col("odds_ratio"), 3).alias("odds_ratio"), nudged(F.col("pct_change"), 2).alias("pct_change"))


@query("q_glm_closed", _TABLE_SQL + """
SELECT round(coef, 4) AS coef, round(se, 4) AS std_err, round(coef / se, 3) AS t FROM l""")
def q_glm_closed(spark, d):
    """The binomial GLM's coefficient, standard error and z on one binary feature against their closed forms."""
    t = ST.glm_table(ST.glm(_two_by_two(spark, d), ["x"], "y"), ["x"], spark).where("feature = 'x'")
    nudged = lambda c, k: F.round(F.lit(ROUND_NUDGE) + F.col(c), k).alias(c)
    return t.select(nudged("coef", 4), nudged("std_err", 4), nudged("t", 3))


def order_revenue(spark, d):
    """Per-order revenue and its candidate predictors, aggregated from lineitem."""
    li = tbl(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum("l_extendedprice").alias("gross"), F.avg("l_discount").alias("avg_disc"),
        F.avg("l_tax").alias("avg_tax"), F.count(F.lit(1)).cast("double").alias("n_lines"))


@query("q_refit")
def q_refit(spark, d):
    """M21 + M22: OLS of per-order revenue, keep p <= 0.1 (T24: the code's rule), refit."""
    x = cut_lineage(order_revenue(spark, d))
    keep, table = ST.refit_significant(x, ["gross", "avg_disc", "avg_tax", "n_lines"], "revenue", 0.1)
    return table


@query("q_backward")
def q_backward(spark, d):
    """Backward elimination on binomial GLM p-values (> 0.05 removed)."""
    keep = ST.backward_eliminate(doc_features(spark, d), DOC_FEATURES, "label", 0.05)
    return spark.createDataFrame([(k,) for k in keep], "feature string")


@query("q_glm")
def q_glm(spark, d):
    """GLM, binomial (default) and Gaussian (T26) coefficient tables."""
    x = doc_features(spark, d)
    a = ST.glm_table(ST.glm(x, DOC_FEATURES, "label", "binomial"), DOC_FEATURES, spark).withColumn("family", F.lit("binomial"))
    b = ST.glm_table(ST.glm(x, DOC_FEATURES, "label", "gaussian"), DOC_FEATURES, spark).withColumn("family", F.lit("gaussian"))
    return a.unionByName(b)


@query("q_vif", """
SELECT 'l_quantity' AS feature, round(1 / (1 - corr(l_quantity, l_extendedprice) ^ 2), 6) AS vif FROM lineitem
UNION ALL SELECT 'l_extendedprice', round(1 / (1 - corr(l_quantity, l_extendedprice) ^ 2), 6) FROM lineitem""")
def q_vif(spark, d):
    """VIF = diagonal of the inverse correlation matrix (2 predictors: 1 / (1 - r^2))."""
    return rounded(ST.vif(tbl(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("q_odds")
def q_odds(spark, d):
    """M26 + N24 + M28: odds ratios and percent change of odds from a logistic fit."""
    m, _p = M.logit(doc_features(spark, d), DOC_FEATURES, "label")
    return ST.odds_table(m, DOC_FEATURES, spark)


@query("q_importance")
def q_importance(spark, d):
    """M27 + O5: forest importances with names, one excluded, top 5."""
    m, _p = M.random_forest(doc_features(spark, d), DOC_FEATURES, "label", trees=100, depth=4)
    rows = M.importances(m, DOC_FEATURES, exclude=["n_chars_k"], k=5)
    return spark.createDataFrame(rows, "feature string, importance double")


@query("q_kbest")
def q_kbest(spark, d):
    """X24 + X26: assemble, then keep the 3 best features by ANOVA F."""
    x = X.assemble(DOC_FEATURES).transform(doc_features(spark, d))
    m = X.k_best("features", "label", "sel", 3).fit(x)
    return spark.createDataFrame([(DOC_FEATURES[i],) for i in m.selectedFeatures], "feature string")


_KB_COLS = ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']


@query("q_kbest_anova", """
WITH u AS (SELECT 'l_quantity' AS feature, l_returnflag AS g, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice' AS feature, l_returnflag AS g, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'l_discount' AS feature, l_returnflag AS g, l_discount AS v FROM lineitem UNION ALL SELECT 'l_tax' AS feature, l_returnflag AS g, l_tax AS v FROM lineitem),
gs AS (SELECT feature, g, count(*) AS n, avg(v) AS m, var_samp(v) AS vs FROM u GROUP BY feature, g),
tot AS (SELECT feature, avg(v) AS mu, count(*) AS nn FROM u GROUP BY feature),
f AS (SELECT gs.feature, (sum(gs.n * (gs.m - tot.mu) * (gs.m - tot.mu)) / (count(*) - 1))
                         / (sum((gs.n - 1) * gs.vs) / (max(tot.nn) - count(*))) AS fstat
      FROM gs JOIN tot ON gs.feature = tot.feature GROUP BY gs.feature)
SELECT feature FROM f ORDER BY fstat DESC LIMIT 2""")
def q_kbest_anova(spark, d):
    """X26 against the closed form: the 2 best of 4 columns by ANOVA F for the return flag."""
    from pyspark.ml.feature import StringIndexer
    li = tbl(spark, d, "lineitem").select("l_returnflag", *_KB_COLS)
    li = StringIndexer(inputCol="l_returnflag", outputCol="label").fit(li).transform(li)
    x = X.assemble(_KB_COLS).transform(li)
    m = X.k_best("features", "label", "sel", 2).fit(x)
    return spark.createDataFrame([(_KB_COLS[i],) for i in m.selectedFeatures], "feature string")


@query("q_coef_select")
def q_coef_select(spark, d):
    """Refit on features whose |coef| >= 1.25 x median |coef| (scaled features)."""
    from pyspark.ml.feature import StandardScaler
    x = X.assemble(DOC_FEATURES, "raw").transform(doc_features(spark, d))
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    m, _p = M.logit(x, "features", "label")
    idx = X.coef_select(m.coefficients.toArray(), 1.25)
    x2 = X.slice_vector("features", "sel", idx).transform(x)
    m2, p2 = M.logit(x2.drop("features").withColumnRenamed("sel", "features"), "features", "label")
    return _p1(p2).select("doc_id", "p1")


@query("q_column_transformer")
def q_column_transformer(spark, d):
    """One-hot (all levels) + standard scaling + passthrough into one vector, then a fit."""
    x = doc_features(spark, d)
    pipe = X.column_transformer(["source", "lang"], ["n_chars_k", "n_sentences"], ["polarity"])
    model, tr = X.fit_transform(pipe, x)[:2]
    _m, p = M.logit(tr, "features", "label", reg=0.01)
    return _p1(p).select("doc_id", "p1")


@query("q_submission")
def q_submission(spark, d):
    """S6 + N23 + M29: fit a pipeline on the labelled documents only (T5),
    score every document, emit id + probability of class 1."""
    from pyspark.ml import Pipeline
    train = doc_features(spark, d)
    alld = tbl(spark, d, "documents").select("doc_id", "text", "n_chars")
    alld = T.sentiment(alld, "text").select(
        "doc_id", (F.col("n_chars") / 1000.0).alias("n_chars_k"), TX.count_char("text", "!").cast("double").alias("n_excl"),
        TX.sentence_count("text").cast("double").alias("n_sentences"),
        TX.capital_token_count("text").cast("double").alias("n_caps"),
        "polarity", "subjectivity", "compound")
    pipe = Pipeline(stages=[X.assemble(DOC_FEATURES), LogisticRegression(featuresCol="features", labelCol="label")])
    model = pipe.fit(train)
    return M.submission(model.transform(alld), "doc_id", "quality_prob")


@query("q_training_summary", """
SELECT CAST(quality AS DOUBLE) AS label, CAST(count(*) AS BIGINT) AS support, true AS in_range FROM labels l
JOIN documents d ON l.doc_id = d.doc_id GROUP BY quality""")
def q_training_summary(spark, d):
    """Precision, recall and F by label of a logistic fit as rows, with the labels' supports."""
    x = doc_features(spark, d)
    m, p = M.logit(x, DOC_FEATURES, "label")
    s = M.training_summary(m)
    rows = [(float(k), *map(float, r)) for k, r in enumerate(zip(
        s["precision_by_label"], s["recall_by_label"], s["f_by_label"]))]
    by = spark.createDataFrame(rows, "label double, precision double, recall double, f double")
    n = p.groupBy("label").agg(F.count(F.lit(1)).alias("support"))
    ok = F.greatest("precision", "recall", "f") <= 1
    return n.join(by, "label").select("label", "support", ok.alias("in_range"))


@query("q_score_rank")
def q_score_rank(spark, d):
    """Train on orders before the hold-out half-year, score the hold-out,
    sum positive votes per customer, top 15."""
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    o = o.withColumns({"label": (F.col("o_orderstatus") == "F").cast("double"),
                       "price_k": F.col("o_totalprice") / 1000.0, "month": F.month("o_orderdate").cast("double")})
    train, hold = S.split_by_year(o, F.year("o_orderdate"), 2000)
    x = X.assemble(["price_k", "month"]).transform(train)
    model = LogisticRegression(featuresCol="features", labelCol="label").fit(x)
    return M.score_and_rank(model, X.assemble(["price_k", "month"]).transform(hold), "o_custkey", 15)
