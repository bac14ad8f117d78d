"""Out-of-fold predictions of log10 rates by gradient-boosted trees, held out by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..errors import Refused
from ..functions import rates
from ..schemas import MODEL_FEATURES
from . import boosting, guards, splits

MODEL_VERSION = "gbt_v2"
BOOST_PARAMS = {"maxIter": 300, "stepSize": 0.05, "minInstancesPerNode": 10, "maxDepth": 4, "maxBins": 64}


def feature_stages(features: Sequence[str], nullable: Sequence[str]) -> tuple[list, list[str]]:
    """Imputation and assembly; a nullable feature also gets a column saying it was missing."""
    plain = [f for f in features if f not in nullable]
    inputs = plain + [f"{f}__filled" for f in nullable] + [f"{f}__missing" for f in nullable]
    stages = []
    if nullable:
        stages.append(Imputer(inputCols=list(nullable), outputCols=[f"{f}__filled" for f in nullable]))
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__x"))
    return stages, inputs


def feature_matrix(df: DataFrame, features: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    """Features as doubles in a fixed order, nulls kept, with a missing flag per nullable feature."""
    return df.withColumns({**{f: F.col(f).cast("double") for f in features},
                           **{f"{f}__missing": F.col(f).isNull().cast("double") for f in nullable}})


def out_of_fold_predictions(df: DataFrame, features: Sequence[str] = MODEL_FEATURES, *,
                            nullable: Sequence[str] = ("girth_x", "girth_z"), key: str = "code_id",
                            group: str = "construction_program_id", n_splits: int | None = None,
                            params: dict | None = None, model_version: str = MODEL_VERSION) -> DataFrame:
    """(key, pred_log10_ler, fold, model_version) for every row.

    Each fold's model is trained on the uncensored rows of the other groups and predicts every row of its own, censored
    ones included. All folds grow together; a null of a ``nullable`` feature is a value of its own, others are refused.
    """
    needed = {f"{f} is null": guards.nulls(f) for f in features if f not in nullable}
    if needed:
        guards.enforce(guards.counts(df, needed))
    folded = splits.with_folds(df.select(key, group, "censored", "true_ler", *features), n_splits, group)
    held = {r["fold"]: r["rows"] for r in folded.groupBy("fold").agg(F.count_if(~F.col("censored")).alias("rows")).collect()}
    total = sum(held.values())
    empty = sorted(f for f, rows in held.items() if total == rows)
    if empty:
        raise Refused(f"folds {empty} have no uncensored training row")
    params = BOOST_PARAMS | (params or {})
    ready = folded.select(key, "fold", (~F.col("censored")).alias("train"), rates.log_target().alias("y"), *features)
    out = boosting.out_of_fold(ready, features, key=key, trees=params["maxIter"], depth=params["maxDepth"], rate=params["stepSize"],
                               min_rows=params["minInstancesPerNode"], max_bins=params["maxBins"])
    return out.select(key, F.col("pred").alias("pred_log10_ler"), "fold", F.lit(model_version).alias("model_version"))
