"""Encoders, scalers and selectors (X18-X29), Spark ML stages.

Fitted stages hold level lists, means and variances; fitting them is one
distributed aggregate each. Spark's indexer and target encoder keep every
level in the driver: for ids use the ``_by_table`` forms, which join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import feature as MF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import join_on
from .windows import grouped_running


def index_levels(cols: Sequence[str], unseen: str = "keep", order: str = "alphabetAsc",
                 suffix: str = "_idx") -> MF.StringIndexer:
    """String indexer; unseen levels get the extra index (``keep``).

    Alphabetical order is the default: frequency order breaks ties by
    layout (H1)."""
    return MF.StringIndexer(inputCols=list(cols), outputCols=[c + suffix for c in cols],
                            handleInvalid=unseen, stringOrderType=order)


def index_by_table(df: DataFrame, col: str, levels: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """X18 for columns with many levels (ids): the level table stays distributed and is joined by level.

    Levels (of ``levels``, or of ``df`` itself) are numbered from 0 in
    ascending order, range by range; unseen and null levels get the number of
    levels.
    """
    out = out or col + "_idx"
    src = (levels if levels is not None else df).select(F.col(col).alias("_level")).where(F.col("_level").isNotNull()).distinct()
    table = grouped_running(src, [], ["_level"], {"_place": F.lit(1)}, inclusive=False)
    n = table.agg(F.count(F.lit(1))).scalar()
    j = df.join(table, F.col(col) == F.col("_level"), "left")
    return j.withColumn(out, F.coalesce("_place", n).cast("double")).drop("_level", "_place")


def target_encode_by_table(df: DataFrame, col: str, label: str, train: DataFrame | None = None, smoothing: float = 0.0,
                           out: str | None = None) -> DataFrame:
    """X21 for columns with many levels (ids): level means as a table joined by level.

    A level's value is ``(sum + smoothing * prior) / (n + smoothing)``; unseen
    levels get the prior (the overall mean), a null level is a level.
    """
    out = out or col + "_te"
    src = train if train is not None else df
    y = F.col(label).cast("double")
    g = src.groupBy(col).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    t = g.agg(F.struct(F.sum("_s").alias("s"), F.sum("_n").alias("n"))).scalar()
    prior = F.try_divide(t["s"], t["n"].cast("double"))
    j = join_on(df, g, [col], "left")
    value = F.try_divide(F.coalesce("_s", F.lit(0.0)) + smoothing * prior, F.coalesce("_n", F.lit(0)) + F.lit(float(smoothing)))
    return j.withColumn(out, F.coalesce(value, prior)).drop("_s", "_n")


def one_hot(cols: Sequence[str], drop: str | None = "first", unseen: str = "keep",
            suffix: str = "_oh") -> list:
    """One-hot stages. ``drop="first"`` drops the alphabetically first
    level (T25): levels are indexed in descending order and Spark drops the
    last index. ``drop=None`` keeps every level (X20)."""
    order = "alphabetDesc" if drop == "first" else "alphabetAsc"
    idx = MF.StringIndexer(inputCols=list(cols), outputCols=[c + "_i" for c in cols],
                           handleInvalid=unseen, stringOrderType=order)
    enc = MF.OneHotEncoder(inputCols=[c + "_i" for c in cols], outputCols=[c + suffix for c in cols],
                           dropLast=drop == "first", handleInvalid="keep" if unseen == "keep" else "error")
    return [idx, enc]


def assemble(cols: Sequence[str], out: str = "features", handle_invalid: str = "error") -> MF.VectorAssembler:
    """Vector assembly; ``handle_invalid="error"`` surfaces nulls."""
    return MF.VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid)


def standardise(col: str, out: str, with_mean: bool = True) -> MF.StandardScaler:
    """Standard scaling with the sample sd (Spark). See ``population_sd_factor``."""
    return MF.StandardScaler(inputCol=col, outputCol=out, withMean=with_mean, withStd=True)


def population_sd_factor(n) -> float:
    """Multiply Spark-scaled values (sample sd) by this to get
    population-sd scaling: sd_pop = sd_samp * sqrt((n-1)/n)."""
    return (n / (n - 1)) ** 0.5


def minmax(col: str, out: str) -> list:
    """Min-max scaling of one numeric column (assembled to a vector first)."""
    return [MF.VectorAssembler(inputCols=[col], outputCol=col + "_vec"),
            MF.MinMaxScaler(inputCol=col + "_vec", outputCol=out)]


def column_transformer(onehot: Sequence[str], scale: Sequence[str], passthrough: Sequence[str],
                       out: str = "features") -> Pipeline:
    """Full one-hot for categoricals, standard scaling for numerics,
    passthrough columns, assembled into one vector."""
    stages = one_hot(onehot, drop=None) if onehot else []
    if scale:
        stages += [MF.VectorAssembler(inputCols=list(scale), outputCol="_num", handleInvalid="keep"),
                   MF.StandardScaler(inputCol="_num", outputCol="_num_s", withMean=True, withStd=True)]
    parts = [c + "_oh" for c in onehot] + (["_num_s"] if scale else []) + list(passthrough)
    stages.append(MF.VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)


def target_encode(cols: Sequence[str], label: str, smoothing: float = 0.0, target_type: str = "binary",
                  suffix: str = "_te") -> Pipeline:
    """Target encoding (mean label per level), no smoothing by default.

    Levels are indexed first (the encoder takes numeric categories)."""
    idx = MF.StringIndexer(inputCols=list(cols), outputCols=[c + "_ti" for c in cols], handleInvalid="keep",
                           stringOrderType="alphabetAsc")
    enc = MF.TargetEncoder(inputCols=[c + "_ti" for c in cols], outputCols=[c + suffix for c in cols],
                           labelCol=label, smoothing=smoothing, targetType=target_type, handleInvalid="keep")
    return Pipeline(stages=[idx, enc])


def variance_select(col: str, out: str, threshold: float) -> MF.VarianceThresholdSelector:
    """Keep vector slots whose (sample) variance exceeds ``threshold``."""
    return MF.VarianceThresholdSelector(featuresCol=col, outputCol=out, varianceThreshold=threshold)


def k_best(col: str, label: str, out: str, k: int, feature_type: str = "continuous",
           label_type: str = "categorical") -> MF.UnivariateFeatureSelector:
    """Select the k best features (ANOVA F for continuous vs categorical)."""
    s = MF.UnivariateFeatureSelector(featuresCol=col, labelCol=label, outputCol=out, selectionMode="numTopFeatures")
    return s.setFeatureType(feature_type).setLabelType(label_type).setSelectionThreshold(float(k))


def coef_select(coefs: Sequence[float], factor: float = 1.25) -> list[int]:
    """Indices of coefficients with ``|c| >= factor * median(|c|)`` (p-sized, driver)."""
    import numpy as np
    a = np.abs(np.asarray(coefs, dtype=float))
    return [int(i) for i in np.nonzero(a >= factor * np.median(a))[0]]


def slice_vector(col: str, out: str, indices: Sequence[int]) -> MF.VectorSlicer:
    """X27 companion: keep the given vector slots."""
    return MF.VectorSlicer(inputCol=col, outputCol=out, indices=list(indices))


def sql_stage(statement: str) -> MF.SQLTransformer:
    """A per-row SQL statement over ``__THIS__`` as a pipeline stage."""
    return MF.SQLTransformer(statement=statement)


def explode_stage(col: str, out: str) -> MF.SQLTransformer:
    """Explode inside a pipeline (changes the row count, T10)."""
    return MF.SQLTransformer(statement=f"SELECT *, explode({col}) AS {out} FROM __THIS__")


def fit_transform(stages: list | Pipeline, train: DataFrame, *others: DataFrame):
    """Fit on ``train`` only (T5), transform train and every other frame with one fitted pipeline (T4)."""
    pipe = stages if isinstance(stages, Pipeline) else Pipeline(stages=list(stages))
    model: PipelineModel = pipe.fit(train)
    return (model, model.transform(train), *[model.transform(o) for o in others])


def slot_names(df: DataFrame, col: str) -> list[str]:
    """M28 helper: slot names of an assembled vector from its ML metadata."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    attrs = []
    for kind in ("numeric", "binary", "nominal"):
        attrs += meta.get("attrs", {}).get(kind, [])
    names = [a["name"] for a in sorted(attrs, key=lambda a: a["idx"])]
    return names or [f"{col}_{i}" for i in range(meta.get("num_attrs", 0))]


def first_active(col: str) -> F.Column:
    """Index of the first non-zero slot of a vector (-1 if none)."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(col)
    return (F.array_position(F.transform(arr, lambda x: x != 0), F.lit(True)) - 1).cast("int")
