"""Catalogue: evaluation metrics and splits.

Scored binding: labels (quality as the label) joined with documents, score
``n_chars / (n_chars + 1000)`` (deterministic; integer lengths give tied
scores).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import to_class
from ..operators import metrics as E
from ..operators import split as S
from .common import query, rounded, tbl

_SCORED = """s AS (SELECT l.doc_id, l.quality AS label,
  CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 1000.0) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def scored(spark, d):
    lab = tbl(spark, d, "labels")
    doc = tbl(spark, d, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars").cast("double")
    return lab.join(doc, "doc_id").select("doc_id", F.col("quality").alias("label"), (n / (n + 1000.0)).alias("score"))


_CELLS = """c AS (SELECT count(*) FILTER (WHERE label = 1 AND score > {t}) AS tp,
  count(*) FILTER (WHERE label = 0 AND score > {t}) AS fp, count(*) FILTER (WHERE label = 0 AND NOT score > {t}) AS tn,
  count(*) FILTER (WHERE label = 1 AND NOT score > {t}) AS fn FROM s)"""


@query("q_confusion", f"""
WITH {_SCORED}, {_CELLS.format(t=0.7)},
l AS (SELECT 1 AS label, 1 AS pred, tp AS n FROM c UNION ALL SELECT 0, 1, fp FROM c
      UNION ALL SELECT 0, 0, tn FROM c UNION ALL SELECT 1, 0, fn FROM c)
SELECT label, pred, n, round(n / (SELECT tp + fp + tn + fn FROM c), 6) AS share FROM l""")
def q_confusion(spark, d):
    """E1 + E2: 2x2 confusion with every cell present, and cell shares."""
    return rounded(E.confusion(scored(spark, d), "label", "score", 0.7, ">", percent=True))


@query("q_prf", f"""
WITH {_SCORED}, {_CELLS.format(t=0.7)}
SELECT round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) AS f1,
  round(((tp / (tp + fn)) + (tn / (tn + fp))) / 2, 6) AS auc_hard
FROM c""")
def q_prf(spark, d):
    """E3 + E7: scores of the positive class and AUC of hard predictions."""
    return rounded(E.classification_scores(scored(spark, d), "label", "score", 0.7))


@query("q_report", f"""
WITH {_SCORED}, p AS (SELECT label, CASE WHEN score > 0.7 THEN 1 ELSE 0 END AS pred FROM s),
cls AS (SELECT label AS cls FROM p UNION SELECT pred FROM p),
t AS (SELECT label AS cls, count(*) AS support, count(*) FILTER (WHERE label = pred) AS tp FROM p GROUP BY label),
q AS (SELECT pred AS cls, count(*) AS n_pred FROM p GROUP BY pred),
j AS (SELECT cls.cls, coalesce(t.support, 0) AS support, coalesce(t.tp, 0) AS tp, coalesce(q.n_pred, 0) AS n_pred
      FROM cls LEFT JOIN t ON cls.cls = t.cls LEFT JOIN q ON cls.cls = q.cls)
SELECT cls, round(tp / n_pred, 6) AS precision, round(tp / support, 6) AS recall,
  round(2 * (tp / n_pred) * (tp / support) / ((tp / n_pred) + (tp / support)), 6) AS f1, support FROM j""")
def q_report(spark, d):
    """Per-class precision / recall / F1 / support."""
    s = scored(spark, d).withColumn("pred", to_class("score", 0.7))
    return rounded(E.report_by_label(s, "label", "pred"))


_ROC_SQL = f"""
WITH {_SCORED}, g AS (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
                             count(*) FILTER (WHERE label <> 1) AS neg FROM s GROUP BY score),
c AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
             (SELECT sum(pos) FROM g) AS P, (SELECT sum(neg) FROM g) AS N FROM g)"""


@query("q_roc", _ROC_SQL + """
SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr, round(tp / (tp + fp), 6) AS precision,
       round(tp / P, 6) AS recall FROM c""")
def q_roc(spark, d):
    """E5 + E9: ROC and PR points at every distinct score (distributed running sums)."""
    return rounded(E.roc_points(scored(spark, d), "label", "score"))


@query("q_auc", f"""
WITH {_SCORED}, g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos,
                             count(*) FILTER (WHERE label <> 1) AS neg FROM s GROUP BY score),
c AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM g)
SELECT round(sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)), 6) AS auc FROM c""")
def q_auc(spark, d):
    """Exact AUC by rank sums (ties count one half)."""
    return rounded(E.auc(scored(spark, d), "label", "score"))


@query("q_youden", _ROC_SQL + """
SELECT round(threshold, 6) AS threshold, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr,
       round(tp / P - fp / N, 6) AS j
FROM c ORDER BY tp / P - fp / N DESC, threshold DESC LIMIT 1""")
def q_youden(spark, d):
    """E8 + O6: Youden-optimal threshold (argmax of TPR - FPR)."""
    return rounded(E.youden(scored(spark, d), "label", "score"))


def _thr_sql(ts):
    parts = []
    for t in ts:
        parts.append(f"""SELECT {t}::DOUBLE AS threshold, count(*) FILTER (WHERE label = 1 AND score > {t}) AS tp,
  count(*) FILTER (WHERE label = 0 AND score > {t}) AS fp, count(*) FILTER (WHERE label = 0 AND NOT score > {t}) AS tn,
  count(*) FILTER (WHERE label = 1 AND NOT score > {t}) AS fn FROM s""")
    return " UNION ALL ".join(parts)


@query("q_thresholds", f"""
WITH {_SCORED}, c AS ({_thr_sql([0.5, 0.7, 0.75])})
SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0))
        / nullif((tp / nullif(tp + fp, 0)) + (tp / nullif(tp + fn, 0)), 0), 6) AS f1
FROM c""")
def q_thresholds(spark, d):
    """Three thresholds in one aggregate pass, labelled by value."""
    return rounded(E.compare_thresholds(scored(spark, d), "label", "score", [0.5, 0.7, 0.75]))


@query("q_regression_scores", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
           FROM lineitem),
p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS yhat FROM lineitem, f)
SELECT count(*) AS n, round(1 - sum((y - yhat) * (y - yhat)) / (count(*) * var_pop(y)), 4) AS r2,
       round(sqrt(sum((y - yhat) * (y - yhat)) / count(*)), 4) AS rmse, round(avg(abs(y - yhat)), 4) AS mae FROM p""")
def q_regression_scores(spark, d):
    """M20 + E11: linear regression (normal equations) and R2 / RMSE / MAE."""
    from ..operators.models import linear
    li = tbl(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    model, pred = linear(li, ["l_quantity"], "l_extendedprice")
    return rounded(E.regression_scores(pred, "l_extendedprice", "prediction"), 4)


# ---------------------------------------------------------------- splits

_H = "((doc_id * 7919) % 1073741824)"


@query("q_folds", f"""
SELECT doc_id, quality,
  CAST((row_number() OVER (PARTITION BY quality ORDER BY {_H}, doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels""")
def q_folds(spark, d):
    """M6: exact stratified 5 folds (ordinal within class by key hash, mod k)."""
    lab = tbl(spark, d, "labels").select("doc_id", "quality")
    return S.stratified_folds(lab, "doc_id", "quality", 5, method="mod")


@query("q_stratified", f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_H}, doc_id) AS rn,
                  count(*) OVER (PARTITION BY quality) AS nc FROM labels)
SELECT doc_id, quality, CASE WHEN rn <= floor(nc * 0.2 + 0.5) THEN 1 ELSE 0 END AS is_test FROM r""")
def q_stratified(spark, d):
    """M2: exact stratified 20% test split."""
    lab = tbl(spark, d, "labels").select("doc_id", "quality")
    return S.split_stratified(lab, "doc_id", "quality", 0.2, method="mod")


@query("q_fold_scores", f"""
WITH {_SCORED}, f AS (SELECT s.*, CAST((row_number() OVER (PARTITION BY label ORDER BY {_H.replace('doc_id', 's.doc_id')}, s.doc_id) - 1) % 5 AS INTEGER) AS fold FROM s),
a AS (SELECT fold, avg(CASE WHEN (CASE WHEN score > 0.7 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END) AS score FROM f GROUP BY fold)
SELECT round(avg(score), 6) AS mean_score, round(stddev_samp(score), 6) AS std_score, count(*) AS n_folds FROM a""")
def q_fold_scores(spark, d):
    """E12 over M6 folds: accuracy per fold, then mean and sd."""
    s = S.stratified_folds(scored(spark, d), "doc_id", "label", 5, method="mod")
    per = s.groupBy("fold").agg(F.avg((to_class("score", 0.7) == F.col("label")).cast("double")).alias("score"))
    return rounded(E.mean_score(per))


@query("q_split", """
WITH t AS (SELECT o_orderstatus, CASE WHEN (o_orderkey * 7919 + 42 * 104729) % 10000 < 7000 THEN 0
                                       WHEN (o_orderkey * 7919 + 42 * 104729) % 10000 < 8500 THEN 1 ELSE 2 END AS split
           FROM orders),
g AS (SELECT split, o_orderstatus, count(*) AS n FROM t GROUP BY split, o_orderstatus)
SELECT split, o_orderstatus, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share FROM g""")
def q_split(spark, d):
    """M1 + E13: repeatable 70/15/15 key-hash split and class balance per split."""
    o = tbl(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    s = S.split_random(o, "o_orderkey", [0.7, 0.15, 0.15], seed=42, method="mod", out="split")
    return rounded(E.class_balance(s, "o_orderstatus", "split"))


@query("q_split_year", """
SELECT CASE WHEN year(o_orderdate) <= 1999 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM orders GROUP BY 1""")
def q_split_year(spark, d):
    """M3: split by year."""
    o = tbl(spark, d, "orders")
    tr, te = S.split_by_year(o, F.year("o_orderdate"), 1999)
    return tr.groupBy(F.lit("train").alias("part")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        te.groupBy(F.lit("test").alias("part")).agg(F.count(F.lit(1)).alias("n")))


# Seven years of orders: six of them can be validated, from the second on; the last is the hold-out.
_WF_FOLDS = {
    "expanding": [(1996, "1995"), (1997, "1995, 1996"), (1998, "1995, 1996, 1997"), (1999, "1995, 1996, 1997, 1998"),
                  (2000, "1995, 1996, 1997, 1998, 1999")],
    "rolling": [(1996, "1995"), (1997, "1995, 1996"), (1998, "1996, 1997"), (1999, "1997, 1998"), (2000, "1998, 1999")],
}


def _wf_sql():
    parts = []
    for mode, folds in _WF_FOLDS.items():
        until = {"expanding": "-07-01", "rolling": "-12-31 23:59:59.999999"}[mode]
        for i, (v, years) in enumerate(folds):
            parts.append(f"SELECT '{mode}' AS mode, {i} AS fold, 'train' AS role, count(*) AS n FROM orders "
                         f"WHERE year(o_orderdate) IN ({years}) AND o_orderdate < TIMESTAMP '{v - 1}-07-01 00:00:00'")
            parts.append(f"SELECT '{mode}', {i}, 'valid', count(*) FROM orders WHERE year(o_orderdate) = {v} "
                         f"AND o_orderdate < TIMESTAMP '{v}{until}'")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@query("q_walkforward", _wf_sql())
def q_walkforward(spark, d):
    """M4 + M5: expanding (validated on the first half-year) and rolling (2-year, whole year) walk-forward,
    up to 6 folds, 6-month embargo (T35)."""
    o = tbl(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    years = [r[0] for r in o.select("yr").distinct().collect()]   # one row per year
    outs = []
    for mode, months in (("expanding", 6), ("rolling", 12)):
        plan = S.walk_forward_plan(years, mode, n_folds=6, width=2)
        wf = S.walk_forward(o, "yr", "o_orderdate", plan, embargo_months=6, valid_months=months)
        outs.append(wf.groupBy(F.lit(mode).alias("mode"), "fold", "role").agg(F.count(F.lit(1)).alias("n")))
    return outs[0].unionByName(outs[1])
