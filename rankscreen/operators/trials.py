"""From trial outcomes and batch shards to one row per item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import MAX_SHOTS, MIN_FAILURES
from ..functions import rates
from . import ranks


def trial_failures(outcomes: DataFrame, item: str = "item", trial: str = "trial") -> DataFrame:
    """A trial fails when any observable's prediction differs; trials and failing trials per item."""
    wrong = F.bool_or(F.col("predicted") != F.col("actual"))
    return (outcomes.groupBy(item, trial).agg(wrong.alias("failed"))
            .groupBy(item).agg(F.count(F.lit(1)).alias("shots"), F.count_if("failed").alias("failures")))


def packed_failure(predicted: str, actual: str, observables: int) -> Column:
    """Does a bit-packed trial (low bit first, in one integer column per word) differ inside the first bits."""
    mask = (1 << observables) - 1 if observables < 64 else -1
    return F.bit_count(F.col(predicted).bitwiseXOR(F.col(actual)).bitwiseAND(F.lit(mask))) > 0


def stop_batches(batches: DataFrame, item: str = "item", *, min_failures: int = MIN_FAILURES,
                 max_shots: int = MAX_SHOTS) -> DataFrame:
    """Keep each item's batches up to and including the one that reaches the failure target or the cap.

    Adds the running totals ``shots`` and ``failures`` through each kept batch.
    """
    run = ranks.running_sums(batches, [item], "batch_index", {"shots": "batch_shots", "failures": "batch_failures"})
    prior_failures = F.col("failures") - F.col("batch_failures")
    prior_shots = F.col("shots") - F.col("batch_shots")
    return run.filter((prior_failures < min_failures) & (prior_shots < max_shots))


def stop_reason(failures: Column, shots: Column, min_failures: int, max_shots: int) -> Column:
    return (F.when(failures >= min_failures, F.lit("min_failures"))
            .when(shots >= max_shots, F.lit("max_shots")).otherwise(F.lit("running")))


def consolidate(stopped: DataFrame, item: str = "item", *, min_failures: int = MIN_FAILURES,
                max_shots: int = MAX_SHOTS) -> DataFrame:
    """One row per item: the last running totals, summed seconds and invocations, batches and the stop reason."""
    per_item = stopped.groupBy(item).agg(
        F.max("shots").alias("shots"), F.max("failures").alias("failures"), F.count(F.lit(1)).alias("n_batches"),
        F.sum("batch_osd_invocations").alias("osd_invocations"), F.sum("batch_decode_seconds").alias("decode_seconds"))
    return per_item.withColumn("stopped_by", stop_reason(F.col("failures"), F.col("shots"), min_failures, max_shots))


def stop_paired(trials: DataFrame, treatments: Sequence[str], item: str = "item", index: str = "trial", *,
                min_failures: int = MIN_FAILURES, max_shots: int = MAX_SHOTS) -> DataFrame:
    """Trials kept when a run stops at the first trial where every treatment already has its failures, or at the cap.

    ``treatments`` are boolean failure columns; ``index`` counts trials from 0.
    """
    flags = trials.withColumns({f"__f_{t}": F.col(t).cast("long") for t in treatments})
    run = ranks.running_sums(flags, [item], index, {f"__r_{t}": f"__f_{t}" for t in treatments})
    before = [F.col(f"__r_{t}") - F.col(f"__f_{t}") for t in treatments]
    fewest = before[0] if len(before) == 1 else F.least(*before)
    return run.filter((fewest < min_failures) & (F.col(index) < max_shots)).select(*trials.columns)


def paired_stop_summary(kept: DataFrame, treatments: Sequence[str], item: str = "item", *,
                        min_failures: int = MIN_FAILURES, max_shots: int = MAX_SHOTS) -> DataFrame:
    per = kept.groupBy(item).agg(F.count(F.lit(1)).alias("shots"),
                                 *[F.count_if(t).alias(f"failures_{t}") for t in treatments])
    fewest = [F.col(f"failures_{t}") for t in treatments]
    fewest = fewest[0] if len(fewest) == 1 else F.least(*fewest)
    return per.withColumn("stopped_by", stop_reason(fewest, F.col("shots"), min_failures, max_shots))


def pair_treatments(long: DataFrame, treatments: Sequence[str], by: Sequence[str], failed: str = "failed",
                    treatment: str = "treatment") -> DataFrame:
    """Long (trial, treatment, failed) rows to one row per trial with a column per treatment.

    The paired self-join as one aggregation: rows of a trial meet by its key, and trials missing a treatment drop out.
    """
    wide = long.groupBy(*by).agg(*[F.max(F.when(F.col(treatment) == t, F.col(failed))).alias(t) for t in treatments])
    return wide.dropna(subset=list(treatments))


def contingency(paired: DataFrame, by: Sequence[str], a: str = "fail_a", b: str = "fail_b") -> DataFrame:
    """Paired 2x2 table and the exact McNemar p-value per group."""
    x, y = F.col(a), F.col(b)
    table = paired.groupBy(*by).agg(
        F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"),
        F.count_if(x & y).alias("both_fail"), F.count_if(~x & ~y).alias("neither_fails"))
    return table.withColumn("mcnemar_exact_p", rates.mcnemar_exact("only_a", "only_b"))


def tally(trials: DataFrame, by: Sequence[str], *, failed: str = "failed", seconds: str = "seconds",
          converged: str = "converged", rounds: str = "rounds", k: str = "k",
          min_failures: int = MIN_FAILURES) -> DataFrame:
    """Per treatment cell: trials, failures, rate fields, milliseconds per trial and the converged fraction."""
    cells = trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shots"), F.count_if(failed).alias("failures"), F.sum(seconds).alias("decode_seconds"),
        F.count_if(converged).alias("bp_converged"), F.max(rounds).alias("rounds"), F.max(k).alias("k"))
    n = F.nullif("shots", F.lit(0)).cast("double")
    return (cells.withColumns(rates.tolerant_label_columns(min_failures=min_failures))
            .withColumns({"ms_per_shot": F.lit(1000.0) * F.col("decode_seconds") / n,
                          "bp_convergence_fraction": F.col("bp_converged") / n}))


STATES = ("done", "partial", "not_started", "failed", "row_error")


def classify(population: DataFrame, results: DataFrame, shards: DataFrame, deaths: DataFrame,
             item: str = "code_id") -> DataFrame:
    """Every item's state. ``results`` carries ``row_ok``; ``deaths`` has one row per death; two deaths fail an item."""
    has_result = results.groupBy(item).agg(F.bool_and("row_ok").alias("__ok"))
    has_shard = shards.groupBy(item).agg(F.count(F.lit(1)).alias("n_shards"))
    died = deaths.groupBy(item).agg(F.count(F.lit(1)).alias("n_deaths"))
    joined = population.join(has_result, item, "left").join(has_shard, item, "left").join(died, item, "left")
    state = (F.when(F.col("__ok"), "done").when(F.col("__ok").isNotNull(), "row_error")
             .when(F.coalesce("n_deaths", F.lit(0)) >= 2, "failed")
             .when(F.coalesce("n_shards", F.lit(0)) > 0, "partial").otherwise("not_started"))
    return joined.withColumn("state", state).withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("n_shards", "n_deaths")}).drop("__ok")


def deaths_by_item(sessions: DataFrame, item: str = "code_id", at_least: int = 2) -> DataFrame:
    """Items that died at least so often over all sessions; ``died`` is an array of ids per session."""
    return (sessions.select(F.explode("died").alias(item)).groupBy(item).agg(F.count(F.lit(1)).alias("n_deaths"))
            .filter(F.col("n_deaths") >= at_least))


def zero_filled_counts(df: DataFrame, column: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per value for every listed value, zeros included; a column per value, then long form."""
    wide = df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(f"__{i}") for i, v in enumerate(values)])
    cells = F.array(*[F.struct(F.lit(v).alias(column), F.col(f"__{i}").alias("n")) for i, v in enumerate(values)])
    return wide.select(*by, F.explode(cells).alias("c")).select(*by, f"c.{column}", "c.n")


def batch_digests(trials: DataFrame, by: Sequence[str], order: str, payload: Sequence[str], size: int) -> DataFrame:
    """sha256 of each batch's content in trial order. A batch has ``size`` trials by definition, so the list is bounded."""
    keyed = trials.withColumn("batch_index", F.floor(F.col(order) / size).cast("long"))
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in payload])
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("t"))))
    joined = F.concat_ws(";", F.transform(rows, lambda x: x["t"]))
    return keyed.groupBy(*by, "batch_index").agg(F.sha2(joined, 256).alias("batch_sha256"))


def digest_mismatches(recorded: DataFrame, drawn: DataFrame, by: Sequence[str]) -> DataFrame:
    """Batches whose recorded digest is not the one drawn again, or that only one side has."""
    keys = [*by, "batch_index"]
    both = recorded.withColumnRenamed("batch_sha256", "recorded").join(
        drawn.withColumnRenamed("batch_sha256", "drawn"), keys, "full")
    return both.filter(~F.col("recorded").eqNullSafe(F.col("drawn")))
