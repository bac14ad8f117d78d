"""Summary of a calibration run: measurements per cell, size scaling, projections and what did not finish."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import scratch
from ..constants import MAX_SHOTS, MIN_FAILURES, SHOT_BATCH
from ..functions import rates
from ..operators import projection, trials
from ..sources import cells as cell_source

STOP_REASONS = ("min_failures", "max_shots", "wall_clock")


@dataclass(frozen=True)
class CalibrationSummary:
    per_cell: DataFrame
    size_scaling: DataFrame
    projection: DataFrame
    status_counts: DataFrame
    unfinished: DataFrame
    pairs: DataFrame


def cell_table(flat: DataFrame, *, max_shots: int = MAX_SHOTS, shot_batch: int = SHOT_BATCH,
               min_failures: int = MIN_FAILURES) -> DataFrame:
    """Per (p, item, decoder): the rate, trials to the failure target, and the core-hours of such a run."""
    need = flat.withColumns(rates.shots_needed_columns(max_shots=max_shots, min_failures=min_failures))
    need = need.withColumns(rates.run_shots_columns(max_shots=max_shots, shot_batch=shot_batch))
    pace = F.col("decode_seconds") / F.nullif("shots", F.lit(0))
    return need.withColumns({"core_hours": F.col("run_shots") * pace / 3600.0,
                             "core_hours_unbatched": F.col("run_shots_unbatched") * pace / 3600.0})


def summarize(cells: DataFrame, population: DataFrame, *, small: str, large: str, max_shots: int = MAX_SHOTS,
              shot_batch: int = SHOT_BATCH, min_failures: int = MIN_FAILURES,
              stop_reasons: Sequence[str] = STOP_REASONS) -> CalibrationSummary:
    """``cells`` are nested documents; any population with ``code_id, n, d_upper`` can be projected from them."""
    flat = scratch.table(cell_source.flatten(cells), "cells")
    options = {"shot_batch": shot_batch, "min_failures": min_failures}
    # Decoders stop by themselves, so reasons are counted per decoder.
    stopped = trials.zero_filled_counts(flat, "stopped_by", stop_reasons)
    failed = trials.zero_filled_counts(cells, "status", ("killed", "died")).withColumnRenamed("status", "stopped_by")
    return CalibrationSummary(
        cell_table(flat, max_shots=max_shots, **options), projection.named_pair(flat, small, large, "name"),
        projection.project_population(population, flat, caps=[max_shots], **options),
        stopped.unionByName(failed), cell_source.unfinished(cells), cell_source.flatten_pairs(cells))
