"""Evaluation.

Counts come from one conditional aggregate (no join to a label grid).
Curves need a running sum over scores: rows are first grouped by score
(partial aggregation), then ``running_sum`` cuts the distinct scores into
ranges of about equal size, sums inside each, and adds offsets from a table
with one row per range: no unpartitioned window over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import to_class
from .windows import grouped_running


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def running_sum(df: DataFrame, order: str, cols: Sequence[str], descending: bool = True,
                partitions: int | None = None, suffix: str = "_cum") -> DataFrame:
    """Global running sums of ``cols`` ordered by the unique key ``order``, range by range (``grouped_running``)."""
    return grouped_running(df, [], [order], {f"{c}{suffix}": F.col(c) for c in cols}, partitions, descending=descending)


# ------------------------------------------------------------ confusion

def confusion_counts(df: DataFrame, label: str, score: str | Column, threshold: float = 0.5,
                     op: str = ">", pred: str | None = None) -> DataFrame:
    """E1 wide: one row with tp, fp, tn, fn (threshold applied to scores, T36)."""
    y = _c(label)
    p = _c(pred) if pred is not None else to_class(_c(score), threshold, op)
    return df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))


def confusion(df: DataFrame, label: str, score: str | Column | None = None, threshold: float = 0.5,
              op: str = ">", pred: str | None = None, percent: bool = False) -> DataFrame:
    """E1/E2 long form: (label, pred, n[, share]) with all four cells present."""
    c = confusion_counts(df, label, score, threshold, op, pred)
    cells = [(1, 1, "tp"), (0, 1, "fp"), (0, 0, "tn"), (1, 0, "fn")]
    out = c.select(F.inline(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"),
                                               F.col(n).alias("n")) for a, b, n in cells])))
    if percent:
        total = c.select(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).scalar()
        out = out.withColumn("share", F.try_divide(F.col("n").cast("double"), total))
    return out


def _scores_from_counts(tp, fp, tn, fn) -> dict[str, Column]:
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    prec, rec = d(tp, tp + fp), d(tp, tp + fn)
    return {"accuracy": d(tp + tn, tp + fp + tn + fn), "precision": prec, "recall": rec,
            "f1": F.try_divide(2 * prec * rec, prec + rec), "tnr": d(tn, tn + fp)}


def classification_scores(df: DataFrame, label: str, score=None, threshold: float = 0.5, op: str = ">",
                          pred: str | None = None) -> DataFrame:
    """E3 (+ E7): accuracy, precision, recall, F1 of the positive class (T16
    argument order), and the AUC of hard predictions ``(TPR + TNR) / 2`` (T18)."""
    c = confusion_counts(df, label, score, threshold, op, pred)
    s = _scores_from_counts(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return c.select(*[v.alias(k) for k, v in s.items() if k != "tnr"],
                    ((s["recall"] + s["tnr"]) / 2).alias("auc_hard"))


def report_by_label(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision, recall, F1 and support (any number of classes)."""
    y, p = _c(label), _c(pred)
    labels = df.select(y.alias("cls")).union(df.select(p.alias("cls"))).distinct()
    # one aggregate per class, by joining each row to its true and predicted class
    t = df.groupBy(y.alias("cls")).agg(F.count(F.lit(1)).alias("support"),
                                       F.count_if(y == p).alias("tp"))
    pp = df.groupBy(p.alias("cls")).agg(F.count(F.lit(1)).alias("n_pred"))
    j = labels.join(t, "cls", "left").join(pp, "cls", "left").na.fill(0)
    prec = F.try_divide(F.col("tp").cast("double"), F.col("n_pred"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("support"))
    return j.select("cls", prec.alias("precision"), rec.alias("recall"),
                    F.try_divide(2 * prec * rec, prec + rec).alias("f1"), "support")


# ---------------------------------------------------------------- curves

def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score (map-side partial aggregation)."""
    y = _c(label)
    return df.filter(_c(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """At each distinct score t (predict positive when score >= t):
    tp, fp, tpr, fpr, precision, recall."""
    g = score_table(df, label, score)
    totals = g.agg(F.struct(F.sum("pos").alias("P"), F.sum("neg").alias("N"))).scalar()   # one subquery
    P, N = totals["P"], totals["N"]
    c = running_sum(g, "threshold", ["pos", "neg"], descending=True)
    tp, fp = F.col("pos_cum"), F.col("neg_cum")
    return c.select("threshold", tp.alias("tp"), fp.alias("fp"),
                    F.try_divide(tp.cast("double"), P).alias("tpr"),
                    F.try_divide(fp.cast("double"), N).alias("fpr"),
                    F.try_divide(tp.cast("double"), tp + fp).alias("precision"),
                    F.try_divide(tp.cast("double"), P).alias("recall"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under ROC (Mann-Whitney, ties count one half), one row."""
    g = score_table(df, label, score)
    c = running_sum(g, "threshold", ["neg"], descending=False)          # negatives with score <= t
    below = F.col("neg_cum") - F.col("neg")                              # strictly below t
    return c.agg(F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") * 0.5)),
                              (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def youden(df: DataFrame, label: str, score: str) -> DataFrame:
    """E8 (+ O6): threshold maximising TPR - FPR; ties go to the higher threshold."""
    r = roc_points(df, label, score).withColumn("j", F.col("tpr") - F.col("fpr"))
    return r.orderBy(F.desc("j"), F.desc("threshold")).limit(1).select("threshold", "tpr", "fpr", "j")


def compare_thresholds(df: DataFrame, label: str, score: str, thresholds: Sequence[float],
                       op: str = ">") -> DataFrame:
    """Confusion counts and scores at several thresholds in one pass.

    Each threshold contributes four conditional counts to one aggregate;
    rows are labelled by the threshold value (T31).
    """
    y = _c(label)
    exprs = []
    for i, t in enumerate(thresholds):
        p = to_class(_c(score), t, op)
        exprs += [F.count_if((y == 1) & (p == 1)).alias(f"tp{i}"), F.count_if((y == 0) & (p == 1)).alias(f"fp{i}"),
                  F.count_if((y == 0) & (p == 0)).alias(f"tn{i}"), F.count_if((y == 1) & (p == 0)).alias(f"fn{i}")]
    agg = df.agg(*exprs)
    rows = []
    for i, t in enumerate(thresholds):
        tp, fp, tn, fn = (F.col(f"{k}{i}") for k in ("tp", "fp", "tn", "fn"))
        s = _scores_from_counts(tp, fp, tn, fn)
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), tp.alias("tp"), fp.alias("fp"), tn.alias("tn"),
                             fn.alias("fn"), s["accuracy"].alias("accuracy"), s["precision"].alias("precision"),
                             s["recall"].alias("recall"), s["f1"].alias("f1")))
    return agg.select(F.inline(F.array(*rows)))


def regression_scores(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE, MAE (and n) in one aggregate; R2 = 1 - SSE / (n * var_pop(y))."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    e = [F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("_sse"),
         F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("_vy")]
    a = df.groupBy(*by).agg(*e) if by else df.agg(*e)
    return a.select(*by, "n", (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("n") * F.col("_vy"))).alias("r2"),
                    F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), "mae")


def mean_score(df: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Mean (and sd) of fold scores."""
    e = [F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"),
         F.count(F.lit(1)).alias("n_folds")]
    return df.groupBy(*by).agg(*e) if by else df.agg(*e)


def class_balance(df: DataFrame, label: str, split: str | None = None) -> DataFrame:
    """Class counts and shares, per split when given."""
    by = [split] if split else []
    g = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))   # over the grouped result only
    return g.withColumn("share", F.col("n") / F.sum("n").over(w))
