"""Learned models and the column algebra around them.

Trees are MLlib ``GBTRegressor`` (distributed: one job per tree level); an
ensemble is several seeds whose predictions are averaged.  The wrappers around
the trees (capacity and per-eic normalisation, residual second order, difference
targets, month switch, routing) are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.scalars import clip_floor, per_unit

# Default tree settings: the reference's learning rate and sampling, at a size
# that trains in seconds (all settable).
GBT_DEFAULTS = {
    "lossType": "absolute",
    "stepSize": 0.06,
    "featureSubsetStrategy": "0.6",
    "subsamplingRate": 0.9,
    "minInstancesPerNode": 50,
    "maxDepth": 5,
    "maxIter": 20,
    "maxBins": 64,
}

MAX_FITS = 4  # seeds fitted at a time

FIRST_ORDER_MONTHS = [11, 12, 1, 2, 3]


def fit_gbt_ensemble(df: DataFrame, features: Sequence[str], label: str, seeds: Sequence[int] = (0, 1),
                     params: Mapping | None = None) -> list[PipelineModel]:
    """One pipeline (assembler + GBT with L1 loss) per seed.

    The seeds are fitted side by side over the same kept rows: a tree level is a short job, and one seed's jobs use the
    cores that another's leave idle.
    """
    settings = {**GBT_DEFAULTS, **(params or {})}
    train = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features],
                      F.col(label).cast("double").alias("_label")).na.drop()

    def fit(s: int) -> PipelineModel:
        gbt = GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol="_pred", seed=int(s), **settings)
        pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features",
                                                handleInvalid="keep"), gbt])
        return pipe.fit(train)

    if not seeds:
        return []
    train = train.persist()
    with ThreadPool(min(len(seeds), MAX_FITS)) as pool:
        models = pool.map(inheritable_thread_target(df.sparkSession)(fit), seeds)
    train.unpersist()
    return models


def predict_ensemble(models: Sequence[PipelineModel], df: DataFrame, features: Sequence[str],
                     out: str = "prediction") -> DataFrame:
    """Mean of the seeds' predictions, computed in one pass over ``df``."""
    x = df.withColumns({f"_x_{c}": F.col(f"`{c}`").cast("double") for c in features})
    cur = x
    for i, m in enumerate(models):
        assembler, gbt_model = m.stages
        a = VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="_features", handleInvalid="keep")
        cur = gbt_model.transform(a.transform(cur)).withColumnRenamed("_pred", f"_p{i}").drop("_features")
    mean = sum(F.col(f"_p{i}") for i in range(len(models))) / len(models)
    return cur.withColumn(out, mean).drop(*[f"_p{i}" for i in range(len(models))], *[f"_x_{c}" for c in features])


def save_models(models: Sequence[PipelineModel], path: str) -> None:
    """Persist each seed's pipeline under ``path/seed_i``."""
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/seed_{i}")


def load_models(path: str, n: int) -> list[PipelineModel]:
    return [PipelineModel.load(f"{path}/seed_{i}") for i in range(n)]


# --- Column algebra around the trees ------------------------------------------------------------
def first_order_share(first: str = "predictions_first_order", capacity: str = "installed_capacity") -> Column:
    """First-order prediction per unit of capacity, 0 without capacity."""
    return F.when(F.col(capacity) > 0, F.col(first) / F.col(capacity)).otherwise(F.lit(0.0))


def capacity_target(y: str = "target", capacity: str = "installed_capacity") -> Column:
    """Training target of the second order: y / capacity when capacity > 0."""
    return per_unit(y, capacity)


def capacity_restore(raw, capacity: str = "installed_capacity", clip_residual: bool = True) -> Column:
    """Second-order prediction: clip(raw, 0) * capacity.

    ``clip_residual=True`` is the reference's behaviour (Q11): a residual model can
    then only raise the first order; ``False`` keeps negative corrections.
    """
    r = F.col(raw) if isinstance(raw, str) else raw
    return (clip_floor(r) if clip_residual else r) * F.col(capacity)


def merge_with_suffix(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_client") -> DataFrame:
    """Left join; right-side columns that clash with the left get ``suffix``."""
    clash = [c for c in right.columns if c in left.columns and c not in on]
    r = right.withColumnsRenamed({c: f"{c}{suffix}" for c in clash})
    return left.join(r, on=list(on), how="left")


def residual_target(y: str, first: str) -> Column:
    """Two-order residual target y - first."""
    return F.col(y) - F.col(first)


def two_order_combine(first: str, second: str) -> Column:
    """first + second."""
    return F.col(first) + F.col(second)


def month_switch(first: str, second: str, ts: str, months: Sequence[int] = FIRST_ORDER_MONTHS) -> Column:
    """First order in the given months, second otherwise, clipped at 0."""
    m = F.month(ts)
    return clip_floor(F.when(m.isin(*months), F.col(first)).otherwise(F.col(second)))


def eic_target(y: str = "target", eic: str = "eic_count") -> Column:
    """Consumption target per eic."""
    return per_unit(y, eic)


def production_share(pred: str = "predictions_production", capacity: str = "installed_capacity") -> Column:
    """Production prediction per unit of capacity, unchanged without capacity."""
    return per_unit(pred, capacity)


def eic_restore(raw, eic: str = "eic_count") -> Column:
    r = F.col(raw) if isinstance(raw, str) else raw
    return r * F.col(eic)


def diff_target(y: str, lag_col: str, eic: str = "eic_count") -> Column:
    """Difference target y/eic - lag."""
    return per_unit(y, eic) - F.col(lag_col)


def diff_restore(diff, lag_col: str, eic: str = "eic_count") -> Column:
    """(predicted difference + lag) * eic."""
    d = F.col(diff) if isinstance(diff, str) else diff
    return (d + F.col(lag_col)) * F.col(eic)


def weighted_average(cols: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """sum(w_i p_i) / sum(w_i)."""
    w = list(weights) if weights else [1.0 / len(cols)] * len(cols)
    return sum(F.lit(wi) * F.col(c) for wi, c in zip(w, cols)) / F.lit(sum(w))


def route(production: str, consumption: str, flag: str = "is_consumption") -> Column:
    """Production rows take one model, consumption rows the other."""
    return F.when(F.col(flag) == 0, F.col(production)).otherwise(F.col(consumption))
