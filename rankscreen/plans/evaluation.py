"""The evaluation: two scores against measured labels, with intervals, diagnostics and a written report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import scratch
from ..constants import (
    BOOTSTRAP_RESAMPLES, BOOTSTRAP_SEED, LABEL_NOISE_DRAWS, MODEL_SCORE, PHI_SCORE,
)
from ..functions import rates
from ..operators import guards, metrics, model, reconcile, resample
from ..schemas import MODEL_FEATURES
from ..sources import tables

_MODEL, _BASE, _DIFF = "model", "baseline", "difference"


@dataclass(frozen=True)
class Evaluation:
    metrics: DataFrame
    programs: DataFrame
    size_scaling: DataFrame
    predictions: DataFrame | None = None


def metric_table(scored: DataFrame, model_score: str = MODEL_SCORE, baseline_score: str = PHI_SCORE, *,
                 n_resamples: int = BOOTSTRAP_RESAMPLES, seed: int = BOOTSTRAP_SEED,
                 chosen: Sequence[metrics.Metric] | None = None) -> DataFrame:
    """(metric, scorer, estimate, low, high, n_censored, excl_censored) for both scores and their difference."""
    chosen = list(chosen or metrics.default_metrics())
    scored = scratch.table(scored.select("code_id", "censored", "rank_value", F.col(model_score).alias(_MODEL),
                                         F.col(baseline_score).alias(_BASE)), "scored")
    points = scratch.table(metrics.score_report(scored, [_MODEL, _BASE], metrics=chosen), "points")

    def estimate(which):
        return F.max(F.when(F.col("scorer") == which, F.col("estimate")))

    gap = points.groupBy("metric").agg((estimate(_MODEL) - estimate(_BASE)).alias("estimate")).select(
        "metric", F.lit(_DIFF).alias("scorer"), "estimate", F.lit(None).cast("long").alias("n_censored"),
        F.lit(None).cast("double").alias("excl_censored"))
    replicates = resample.bootstrap_replicates(scored, _MODEL, _BASE, n_resamples=n_resamples, seed=seed, metrics=chosen)
    intervals = resample.bootstrap_intervals(replicates, (_MODEL, _BASE, _DIFF))
    return points.unionByName(gap).join(intervals, ["metric", "scorer"]).select(
        "metric", "scorer", "estimate", "low", "high", "n_censored", "excl_censored")


def with_noise_ceiling(table: DataFrame, labelled: DataFrame, n_draws: int = LABEL_NOISE_DRAWS) -> DataFrame:
    ceiling = resample.label_noise_ceiling(labelled, n_draws=n_draws).select(
        "metric", F.lit("observed").alias("scorer"), F.col("mean").alias("estimate"), F.col("p05").alias("low"),
        F.col("p95").alias("high"), F.lit(None).cast("long").alias("n_censored"), F.lit(None).cast("double").alias("excl_censored"))
    return table.unionByName(ceiling)


def program_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("construction_program_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("censored").alias("n_censored"),
        F.avg(F.col("censored").cast("double")).alias("censoring_rate"), F.countDistinct("family").alias("n_families"))


def evaluate(measurements: DataFrame, features: DataFrame, *, expected_rows: int | None = None,
             predictions_path: str | None = None, n_resamples: int = BOOTSTRAP_RESAMPLES, n_draws: int = LABEL_NOISE_DRAWS,
             feature_columns: Sequence[str] = MODEL_FEATURES, n_splits: int | None = None, params: dict | None = None) -> Evaluation:
    """Guards, one-to-one join, out-of-fold model, both metrics with paired intervals, ceiling and size scaling."""
    measurements, features = scratch.table(measurements, "m"), scratch.table(features, "f")
    checks = {**guards.single_protocol(), **guards.censoring_shape(), **guards.group_key(measurements, "construction_program_id")}
    if expected_rows is not None:
        checks["row count"] = guards.wrong_row_count(expected_rows)
    guards.enforce(guards.counts(measurements, checks))
    own = ["code_id", "construction_program_id", "family", "protocol_hash", "rounds", "shots", "failures", "censored",
           "true_ler", "true_ler_ub", "true_ler_ci_low", "true_ler_ci_high"]
    shared = [c for c in ("n", "k", "d_upper", "n_ancilla", "n_total") if c in measurements.columns and c in features.columns]
    frame = reconcile.join_one_to_one(measurements.select(*own, *shared, PHI_SCORE), features, "code_id", shared,
                                      (PHI_SCORE,), names=("measurements", "features"))
    frame = scratch.table(frame.withColumn("rank_value", rates.ranking_value()), "frame")
    predictions = scratch.table(model.out_of_fold_predictions(frame, feature_columns, n_splits=n_splits, params=params), "predictions")
    if predictions_path:
        tables.write_table(predictions, predictions_path, predictions.schema, key="code_id",
                           tag=("model_version", model.MODEL_VERSION), forbidden_prefix="true_")
    scored = reconcile.join_one_to_one(frame, predictions.select("code_id", "pred_log10_ler"), "code_id", (), ())
    scored = scored.withColumn(MODEL_SCORE, rates.model_score())
    guards.enforce(guards.counts(scored, {f"{c} is not finite": guards.not_finite(c) for c in (MODEL_SCORE, PHI_SCORE)}))
    table = metric_table(scored, n_resamples=n_resamples)
    metrics.require_defined(table)
    return Evaluation(with_noise_ceiling(table, frame, n_draws), program_counts(frame), metrics.size_scaling(frame), predictions)


def _cell(c: str, width: int, pattern: str = "%.3f") -> Column:
    text = F.format_string(pattern, F.col(c)) if pattern else F.col(c).cast("string")
    return F.lpad(F.coalesce(F.when(F.col(c).isNotNull(), text), F.lit("-")), width, " ")


def report_lines(table: DataFrame) -> DataFrame:
    """The metric table as fixed-width text under a header, one row per line, in order."""
    names = ("estimate", "low", "high", "n_censored", "excl_censored")
    header = f"{'metric':<44} {'scorer':<12}" + "".join(n[:13].rjust(14 if n == "excl_censored" else 10 if n != "n_censored" else 11) for n in names)
    rows = table.select("metric", "scorer", F.concat(
        F.rpad("metric", 44, " "), F.lit(" "), F.rpad("scorer", 12, " "), _cell("estimate", 10), _cell("low", 10),
        _cell("high", 10), _cell("n_censored", 11, ""), _cell("excl_censored", 14)).alias("line"))
    top = table.sparkSession.createDataFrame([("", "", header)], "metric string, scorer string, line string")
    # Two metrics and four scorers: one short task puts them in order.
    return top.unionByName(rows).coalesce(1).sortWithinPartitions("metric", "scorer").select("line")


def write_report(result: Evaluation, path: str) -> None:
    """The metric table as JSON, its text form, and the diagnostics; nothing is overwritten."""
    tables.write_json(result.metrics, f"{path}/metrics")
    tables.write_json(result.programs, f"{path}/programs")
    tables.write_json(result.size_scaling, f"{path}/size_scaling")
    tables.write_text(report_lines(result.metrics), f"{path}/report")
