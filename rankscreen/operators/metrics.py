"""Ranking metrics of score columns against the measured order: Spearman and tie-aware Recall@k-of-top-n.

All scores are handled in one job: values go to long form, one rank table holds every column's distinct values, and
each metric is one aggregation. Every score is "higher is better"; the truth is ascending in the ranking value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import RECALL_K, RECALL_TOP_N
from ..errors import Refused
from .. import scratch
from . import ranks

_TRUTH = "__truth"


def _subsets() -> Column:
    """The subset 'excluded' repeats the uncensored rows, so a metric and its censored-excluded value share one job."""
    return F.explode(F.when(F.col("censored"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("excluded"))))


def ranked_pairs(df: DataFrame, scores: Sequence[str], truth: str = "rank_value",
                 by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, subset, scorer, item) with the standing of its score and of its truth.

    ``t_below``/``t_tie`` and ``s_below``/``s_tie`` count the rows before it and tied with it; scores are negated, so
    smaller is better on both sides. The input is computed once, into a table of the ranked columns only, and the rank
    table holds distinct values; an item's ranks are looked up by value and items are never joined to items.
    """
    by = list(by)
    narrow = scratch.table(df.select(
        *by, "censored", F.col(truth).cast("double").alias(_TRUTH),
        *[(-F.col(s).cast("double")).alias(f"__s_{i}") for i, s in enumerate(scores)]), "ranked-columns")
    cells = [F.struct(F.lit(_TRUTH).alias("column"), F.col(_TRUTH).alias("value"))]
    cells += [F.struct(F.lit(s).alias("column"), F.col(f"__s_{i}").alias("value")) for i, s in enumerate(scores)]
    long = (narrow.select(*by, _subsets().alias("subset"), F.array(*cells).alias("__cells"))
            .select(*by, "subset", F.explode("__cells").alias("cell"))
            .select(*by, "subset", "cell.column", "cell.value"))
    cuts = ranks.Ranges.of(long, "value")
    table = scratch.table(ranks.value_ranks(long, [*by, "subset", "column"], "value", ranges=cuts), "value-ranks")
    truth_side = table.filter(F.col("column") == _TRUTH).select(
        *by, "subset", F.col("value").alias(_TRUTH), F.col("below").alias("t_below"), F.col("tie").alias("t_tie"))
    score_side = table.filter(F.col("column") != _TRUTH).select(
        *by, "subset", F.col("column").alias("scorer"), F.col("value").alias("__score"),
        F.col("below").alias("s_below"), F.col("tie").alias("s_tie"))
    scored = F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(f"__s_{i}").alias("__score"))
                       for i, s in enumerate(scores)])
    rows = narrow.select(*by, _TRUTH, scored.alias("__scored"), _subsets().alias("subset"))
    rows = (_join(rows, truth_side, [*by, "subset", _TRUTH], cuts.rows, "t_tie")
            .select(*by, "subset", "t_below", "t_tie", F.explode("__scored").alias("c"))
            .select(*by, "subset", "t_below", "t_tie", "c.scorer", "c.__score"))
    return _join(rows, score_side, [*by, "subset", "scorer", "__score"], cuts.rows, "s_tie")


def _join(rows: DataFrame, table: DataFrame, on: list[str], total: int, tie: str) -> DataFrame:
    return (ranks.join_ranks(rows, table.withColumnRenamed(tie, "tie"), on, total).withColumnRenamed("tie", tie))


@dataclass(frozen=True)
class Standing:
    """Where a row stands on both sides: weight before it and tied with it; each row counts ``weight`` times."""

    t_below: Column
    t_tie: Column
    s_below: Column
    s_tie: Column
    weight: Column


@dataclass(frozen=True)
class Metric:
    """A named aggregate over standings; anything of this shape can be reported and resampled."""

    name: str
    value: Callable[[Standing], Column]


def spearman_metric() -> Metric:
    """Correlation of average ranks, null when undefined (fewer than two rows or a constant column)."""
    def value(x: Standing) -> Column:
        # Twice the average rank: whole numbers, so the sums are as exact as a double allows.
        t, s, w = x.t_below * 2 + x.t_tie + 1, x.s_below * 2 + x.s_tie + 1, x.weight
        t, s = t.cast("double"), s.cast("double")
        n = F.sum(w).cast("double")
        st, ss, stt, sss, sts = F.sum(t * w), F.sum(s * w), F.sum(t * t * w), F.sum(s * s * w), F.sum(t * s * w)
        vt, vs = stt - st * st / n, sss - ss * ss / n
        # A constant column leaves only rounding residue, far below one part in 1e13 of the sum of squares.
        defined = (n >= 2) & (vt > stt * 1e-13) & (vs > sss * 1e-13)
        return F.when(defined, (sts - st * ss / n) / F.sqrt(F.abs(vt * vs)))
    return Metric("spearman", value)


def recall_metric(k: int = RECALL_K, top_n: int = RECALL_TOP_N) -> Metric:
    """Expected share of the true top ``top_n`` inside the score's top ``k`` under independent random tie-breaks;
    null with fewer than max(k, top_n) rows."""
    if k < 1 or top_n < 1:
        raise Refused(f"k and top_n must be >= 1; got {k} and {top_n}")

    def value(x: Standing) -> Column:
        hit = ranks.top_share(top_n, x.t_below, x.t_tie) * ranks.top_share(k, x.s_below, x.s_tie)
        return F.when(F.sum(x.weight) >= max(k, top_n), F.sum(hit * x.weight) / top_n)
    return Metric(f"recall_at_{k}_of_top_{top_n}", value)


def default_metrics() -> list[Metric]:
    return [spearman_metric(), recall_metric()]


def pair_metrics(pairs: DataFrame, by: Sequence[str] = (), metrics: Sequence[Metric] | None = None) -> DataFrame:
    """Every metric of every scorer in one aggregation: (metric, scorer, estimate, n_censored, excl_censored)."""
    by, metrics = list(by), metrics or default_metrics()
    at = Standing(F.col("t_below"), F.col("t_tie"), F.col("s_below"), F.col("s_tie"), F.lit(1))
    stats = pairs.groupBy(*by, "scorer", "subset").agg(
        F.count(F.lit(1)).alias("n"), *[m.value(at).alias(f"__m{i}") for i, m in enumerate(metrics)])

    def pick(column, subset):
        return F.max(F.when(F.col("subset") == subset, F.col(column)))

    wide = stats.groupBy(*by, "scorer").agg(
        (pick("n", "all") - F.coalesce(pick("n", "excluded"), F.lit(0))).alias("n_censored"),
        F.array(*[F.struct(F.lit(m.name).alias("metric"), pick(f"__m{i}", "all").alias("estimate"),
                           pick(f"__m{i}", "excluded").alias("excl_censored"))
                  for i, m in enumerate(metrics)]).alias("__m"))
    return (wide.select(*by, "scorer", "n_censored", F.explode("__m").alias("m"))
            .select(*by, "m.metric", "scorer", "m.estimate", "n_censored", "m.excl_censored"))


def score_report(df: DataFrame, scores: Sequence[str], truth: str = "rank_value",
                 metrics: Sequence[Metric] | None = None) -> DataFrame:
    """(metric, scorer, estimate, n_censored, excl_censored) of every score against the measured order."""
    return pair_metrics(ranked_pairs(df, scores, truth), metrics=metrics)


def require_defined(report: DataFrame) -> DataFrame:
    """Refuse a report in which a full-frame metric is undefined."""
    bad = report.filter(F.col("estimate").isNull()).select("metric", "scorer").limit(3).collect()
    if bad:
        raise Refused(f"undefined on these rows: {[tuple(r) for r in bad]}")
    return report


def size_scaling(df: DataFrame, by: str = "construction_program_id", size: str = "d_upper",
                 rate: str = "true_ler") -> DataFrame:
    """Per program: counts, distinct sizes among uncensored rows, and Spearman of size against rate.

    'no reading' with fewer than two distinct sizes; null correlation when a column is constant.
    """
    counts = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("censored").alias("n_censored"),
        F.countDistinct(F.when(~F.col("censored"), F.col(size))).alias("distinct_sizes"))
    points = df.filter(~F.col("censored")).select(by, "censored", rate, F.col(size).cast("double").alias(size))
    # Both orders ascending here, unlike a score: flip the sign the pair builder gives a score.
    flipped = points.withColumn("__neg", -F.col(size))
    rho = (pair_metrics(ranked_pairs(flipped, ["__neg"], rate, [by]), [by], [spearman_metric()])
           .select(by, F.col("estimate").alias("__rho")))
    read = F.col("distinct_sizes") >= 2
    return counts.join(rho, by, "left").select(
        by, "n_items", "n_censored", "distinct_sizes",
        F.when(read, F.lit("left to the reader")).otherwise(F.lit("no reading")).alias("reading"),
        F.when(read, F.col("__rho")).alias("spearman_size_vs_rate"))
