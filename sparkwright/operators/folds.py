"""Walk-forward fits (M4, M5 with any learner): one model per fold, folds side by side.

The panel is written once, partitioned by year. Each fold reads only the years
it needs, fits on the years before its validation year and scores that year.
Folds are independent jobs: they run from a thread pool, each in a scheduler
pool of its own, so that the small stages of one fit fill the gaps of another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import SCRATCH, checkpoint_dir
from .metrics import auc as exact_auc

SCORES = ("fold int, mode string, valid_year int, first_train_year int, last_train_year int, n_train long, n_valid long, "
          "tp long, fp long, fn long, tn long, auc double, auc_hard double")


@dataclass(frozen=True)
class Fold:
    """One fold of a walk-forward plan."""

    index: int
    valid_year: int
    train_years: tuple[int, ...]


def concurrently(spark, tasks: Sequence[Callable[[], object]], width: int = 4, pool: str = "sparkwright") -> list:
    """Results of independent Spark drivers' calls, in order, ``width`` at a time,
    each in its own scheduler pool. The first error is raised once the running ones end."""
    def run(i: int, task: Callable[[], object]):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{pool}-{i % width}")
        try:
            return task()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, width)) as threads:
        waits = [threads.submit(inheritable_thread_target(spark)(run), i, t) for i, t in enumerate(tasks)]
        return [w.result() for w in waits]


def written_by_year(df: DataFrame, year: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder, partitioned by ``year``, and read back."""
    spark = df.sparkSession
    base = spark.conf.get(SCRATCH, None) or f"{checkpoint_dir(spark).rstrip('/')}/tables"
    path = f"{base}/panel-{uuid.uuid4().hex}"
    df.write.partitionBy(year).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def train_part(panel: DataFrame, fold: Fold, year: str, date: str, embargo_months: int = 6) -> DataFrame:
    """Rows of the fold's train years that lie ``embargo_months`` before its validation year (0: all)."""
    rows = panel.where(F.col(year).isin(*fold.train_years))
    if embargo_months:
        start = F.make_timestamp_ntz(F.lit(fold.valid_year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        rows = rows.where(F.col(date) < F.add_months(start, -embargo_months))
    return rows


def valid_part(panel: DataFrame, fold: Fold, year: str, date: str, valid_months: int = 12) -> DataFrame:
    """Rows of the first ``valid_months`` of the validation year."""
    rows = panel.where(F.col(year) == fold.valid_year)
    return rows if valid_months >= 12 else rows.where(F.month(date) <= valid_months)


def confusion(scored: DataFrame, label: str) -> tuple[int, int, int, int]:
    """tp, fp, fn, tn of a scored frame, in one aggregate; null labels do not count."""
    y, p = F.col(label).cast("int"), F.col("prediction").cast("int")
    r = scored.agg(*[F.count_if((y == a) & (p == b)).alias(n) for n, a, b in
                     (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]).first()
    return r.tp, r.fp, r.fn, r.tn


def walk_forward_fits(panel: DataFrame, year: str, date: str, plan: Sequence[tuple[int, Sequence[int]]],
                      fit: Callable[[DataFrame], object], label: str, mode: str = "expanding", embargo_months: int = 6,
                      valid_months: int = 12, width: int = 4) -> DataFrame:
    """M4/M5: a row per fold of ``plan`` (``split.walk_forward_plan``) with its
    sizes, confusion counts and AUC on the validation year.

    ``panel`` is read from storage by every fold (``written_by_year``), ``fit``
    takes its training rows and returns a model with ``transform``. ``auc`` ranks by
    the probability of class 1, ``auc_hard`` by the prediction (the
    mean of both hit rates); each is null where the year has one class only.
    A fold without training rows, or whose training rows have one class,
    has counts and null scores. Rows with a null label are left out.
    """
    return walk_forward_studies(panel, year, date, [(mode, plan, valid_months)], fit, label, embargo_months, width)


def walk_forward_studies(panel: DataFrame, year: str, date: str, studies: Sequence[tuple[str, Sequence[tuple[int, Sequence[int]]], int]],
                         fit: Callable[[DataFrame], object], label: str, embargo_months: int = 6, width: int = 4) -> DataFrame:
    """``walk_forward_fits`` of several studies (mode, plan, valid_months): folds
    with the same training rows share one fit, the largest start first.

    ``fit`` gives the same model whenever it gets the same rows.
    """
    spark = panel.sparkSession
    panel = panel.where(F.col(label).isNotNull())
    uses: dict[tuple[int, tuple[int, ...]], list[tuple[int, int, str, int]]] = {}
    for s, (mode, plan, months) in enumerate(studies):
        for i, (valid_year, train_years) in enumerate(plan):
            uses.setdefault((int(valid_year), tuple(sorted(int(y) for y in train_years))), []).append((s, i, mode, months))

    def one(valid_year: int, train_years: tuple[int, ...], wanted: Sequence[tuple[int, int, str, int]]) -> list[tuple]:
        fold = Fold(0, valid_year, train_years)
        train = train_part(panel, fold, year, date, embargo_months)
        seen = {int(r[0]): r[1] for r in train.groupBy(label).count().collect()}
        model = fit(train) if len(seen) > 1 else None
        rows = []
        for s, i, mode, months in wanted:
            valid = valid_part(panel, fold, year, date, months)
            head = (i, mode, valid_year, train_years[0], train_years[-1], sum(seen.values()))
            rows.append((s, i, (*head, *(scores(model, valid) if model else (valid.count(), *(None,) * 6)))))
        return rows

    def scores(model, valid: DataFrame) -> tuple:
        scored = model.transform(valid).select(F.col(label), "prediction", vector_to_array("probability")[1].alias("p1"))
        tp, fp, fn, tn = confusion(scored, label)
        both = tp + fn > 0 and fp + tn > 0
        auc = exact_auc(scored, label, "p1").first()[0] if both else None
        return tp + fp + fn + tn, tp, fp, fn, tn, auc, (tp / (tp + fn) + tn / (fp + tn)) / 2 if both else None

    jobs = sorted(uses.items(), key=lambda u: -len(u[0][1]))
    got = concurrently(spark, [lambda k=k, w=w: one(*k, w) for k, w in jobs], width, "fold")
    return spark.createDataFrame([r for *_, r in sorted((r for rows in got for r in rows), key=lambda r: r[:2])], SCORES)
