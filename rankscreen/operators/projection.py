"""Cost and censoring of future runs, projected from measured calibration cells.

Cells are rows ``(p, decoder, code_id, n, d_upper, rounds, shots, failures, decode_seconds)``. Everything a projection
says about an item depends on its (d_upper, n) alone, so a population is reduced to counts per distinct size first and
the projection is worked out once per size; per-item rows are a join at the end, made only when asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import scratch
from ..constants import MAX_SHOTS, MIN_FAILURES, SHOT_BATCH
from ..errors import Refused
from ..functions import rates
from . import ranks, reconcile
from .sampling import first_fraction

CELL = ["p", "decoder"]


def power_law_fit(points: DataFrame, by: Sequence[str], size: str = "size", seconds: str = "seconds") -> DataFrame:
    """Least squares of log seconds on log size: (by, a, b, fit_codes); flat when fewer than two sizes or a time is 0."""
    x, y = F.ln(F.col(size).cast("double")), F.ln(F.when(F.col(seconds) > 0, F.col(seconds)))
    usable = (F.min(size) != F.max(size)) & (F.min(seconds) > 0)
    flat = F.ln(F.greatest(F.avg(seconds), F.lit(1e-12)))
    return points.groupBy(*by).agg(
        F.when(usable, F.regr_intercept(y, x)).otherwise(flat).alias("a"),
        F.when(usable, F.regr_slope(y, x)).otherwise(F.lit(0.0)).alias("b"), F.count(F.lit(1)).alias("fit_codes"))


def cell_fit(cells: DataFrame) -> DataFrame:
    used = cells.filter("shots > 0").select(
        *CELL, (F.col("n") * F.col("rounds")).cast("double").alias("size"),
        (F.col("decode_seconds") / F.col("shots")).alias("seconds"))
    return power_law_fit(used, CELL)


def population_sizes(population: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, d_upper, n, items, top_items): how many items have each size, and how many of them are in the top third.

    The top third is the first ceil(N / 3) by d, then n, descending; items of one size are interchangeable here.
    """
    by = list(by)
    # d and n as one exactly representable number, largest first.
    keyed = population.select(*by, (-(F.col("d_upper").cast("double") * float(1 << 31) + F.col("n"))).alias("__key"))
    places = scratch.table(ranks.value_ranks(keyed, by, "__key"), "size-places")
    totals = places.groupBy(*by).agg(F.sum("tie").alias("__n"))
    joined = places.join(totals, by) if by else places.withColumn("__n", totals.select("__n").scalar())
    limit = F.ceil(F.col("__n") / 3.0)
    d = F.floor(-F.col("__key") / float(1 << 31))
    return joined.select(
        *by, d.cast("int").alias("d_upper"), (-F.col("__key") - d * float(1 << 31)).cast("int").alias("n"),
        F.col("tie").alias("items"), F.least("tie", F.greatest(limit - F.col("below"), F.lit(0))).cast("long").alias("top_items"))


def _with_cell_groups(sizes: DataFrame, cells: DataFrame) -> DataFrame:
    """Each size under each (p, decoder): the settings of the run, as one array, exploded in place."""
    used = cells.filter("shots > 0")
    if used.isEmpty():
        raise Refused("no cell has any trial")
    settings = used.agg(F.array_sort(F.collect_set(F.struct(*CELL))).alias("all")).select("all").scalar()
    return sizes.withColumn("__g", F.explode(settings)).select(*sizes.columns, "__g.p", "__g.decoder")


def nearest_donor(sizes: DataFrame, donors: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """(by, d_upper, n, donor): the donor nearest in d_upper, then in n, then with the smallest id.

    Two as-of joins: the donor d's on either side of each d, then inside those the donor n's on either side of each n.
    Only the neighbours that enclose a value can be nearest, so no size meets every donor.
    """
    by = list(by)
    sizes = scratch.table(sizes.select(*by, "d_upper", "n").distinct(), "donor-sizes")
    known = scratch.table(donors.groupBy(*by, "d_upper", "n").agg(F.min("code_id").alias("donor")), "donors")
    ends = ranks.enclosing_points(sizes, known, by, "d_upper")
    options = F.explode(F.array_distinct(F.array_compact(F.array("point_below", "point_above"))).cast("array<int>"))
    d_options = ends.select(*by, "d_upper", options.alias("donor_d"))
    gap_d = F.abs(F.col("donor_d") - F.col("d_upper"))
    closest = d_options.groupBy(*by, "d_upper").agg(F.min(gap_d).alias("__gap"))
    d_options = d_options.join(closest, [*by, "d_upper"]).filter(gap_d == F.col("__gap")).drop("__gap")
    pairs = scratch.table(sizes.join(d_options, [*by, "d_upper"]), "donor-pairs")
    at_d = [*by, "donor_d"]
    n_ends = ranks.enclosing_points(pairs, known.withColumnRenamed("d_upper", "donor_d"), at_d, "n")
    n_options = n_ends.select(*at_d, "n", options.alias("donor_n"))
    found = (pairs.join(n_options, [*at_d, "n"])
             .join(known.withColumnsRenamed({"d_upper": "donor_d", "n": "donor_n"}), [*at_d, "donor_n"]))
    best = F.min(F.struct(gap_d.alias("gd"), F.abs(F.col("donor_n") - F.col("n")).alias("gn"), F.col("donor").alias("id")))
    return found.groupBy(*by, "d_upper", "n").agg(best.alias("m")).select(*by, "d_upper", "n", F.col("m.id").alias("donor"))


def bracket_labels(values: DataFrame, fit: DataFrame, by: Sequence[str], value: str, size: str = "size",
                   name: str = "name") -> DataFrame:
    """(by, value, bracket): the two named fit points that enclose each value, or which end it lies beyond."""
    by = list(by)
    names = fit.groupBy(*by, size).agg(F.min(name).alias("__first"), F.max(name).alias("__last"))
    ends = fit.groupBy(*by).agg(F.min(F.struct(size, name)).alias("__lo"), F.max(F.struct(size, name)).alias("__hi"))
    near = ranks.enclosing_points(values, fit.withColumnRenamed(size, value), by, value)
    below = names.select(*by, F.col(size).cast("double").alias("point_below"), F.col("__last").alias("__below"))
    above = names.select(*by, F.col(size).cast("double").alias("point_above"), F.col("__first").alias("__above"))
    joined = near.join(below, [*by, "point_below"], "left").join(above, [*by, "point_above"], "left").join(ends, by)
    label = (F.when(F.col("point_below").isNull(), F.concat(F.lit("below "), F.col("__lo")[name]))
             .when(F.col("point_above").isNull(), F.concat(F.lit("above "), F.col("__hi")[name]))
             .when(F.col("__below") == F.col("__above"), F.col("__below"))
             .otherwise(F.concat(F.col("__below"), F.lit(" .. "), F.col("__above"))))
    return joined.select(*by, value, label.alias("bracket"))


def project_sizes(sizes: DataFrame, cells: DataFrame, *, caps: Sequence[int] = (MAX_SHOTS,), shot_batch: int = SHOT_BATCH,
                  min_failures: int = MIN_FAILURES) -> DataFrame:
    """Every size under every (p, decoder, cap): projected seconds per trial, donor, run length and core-hours."""
    if min(caps) < 1 or shot_batch < 1:
        raise Refused("caps and shot_batch must be >= 1")
    used = scratch.table(cells.filter("shots > 0"), "cells")
    placed = scratch.table(_with_cell_groups(sizes, used), "sizes-by-cell")
    donors = nearest_donor(placed, used)
    donor_cells = used.select(*CELL, F.col("code_id").alias("donor"), F.col("shots").alias("donor_shots"),
                              F.col("failures").alias("donor_failures"))
    out = placed.join(donors, [*CELL, "d_upper", "n"]).join(donor_cells, [*CELL, "donor"]).join(cell_fit(used), CELL)
    out = out.withColumns({
        "seconds_per_shot": rates.power_law("a", "b", (F.col("n") * F.col("d_upper")).cast("double")),
        "donor_failure_fraction": F.col("donor_failures") / F.col("donor_shots"),
        "max_shots": F.explode(F.array(*[F.lit(c).cast("long") for c in caps]))})
    need = rates.shots_needed_columns("donor_shots", "donor_failures", max_shots=F.col("max_shots"), min_failures=min_failures)
    out = out.withColumns(need)
    out = out.withColumns(rates.run_shots_columns(max_shots=F.col("max_shots"), shot_batch=shot_batch))
    return out.withColumns({
        "core_hours": F.col("run_shots") * F.col("seconds_per_shot") / 3600.0,
        "core_hours_unbatched": F.col("run_shots_unbatched") * F.col("seconds_per_shot") / 3600.0})


def _three_valued(flag: Column, weight: Column, prefix: str) -> list[Column]:
    """Censored, not censored and unknown, weighted; null is unknown."""
    zero = F.lit(0).cast("long")
    yes = F.sum(F.when(flag, weight).otherwise(zero))
    unknown = F.sum(F.when(flag.isNull(), weight).otherwise(zero))
    total = F.sum(weight)
    return [yes.alias(f"{prefix}_censored"), (total - yes - unknown).alias(f"{prefix}_not_censored"),
            unknown.alias(f"{prefix}_unknown"), (yes / F.nullif(total, zero)).alias(f"{prefix}_censored_fraction")]


def summarize_projection(projected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per setting: core-hours, the costliest item, unknowns, and censoring overall and in the top third."""
    items, top, x = F.col("items"), F.col("top_items"), F.col("exceeds_max_shots")
    return projected.groupBy(*by, *CELL, "max_shots").agg(
        F.sum(items).alias("population_codes"), F.sum(items * F.col("core_hours")).alias("core_hours"),
        F.sum(items * F.col("core_hours_unbatched")).alias("core_hours_unbatched"),
        F.max("core_hours").alias("max_code_core_hours"), *_three_valued(x, items, "all"), *_three_valued(x, top, "top"),
        F.sum(top).alias("top_codes"), F.min(F.when(top > 0, F.col("d_upper"))).alias("top_d_upper_min"),
        F.max("a").alias("a"), F.max("b").alias("b"), F.max("fit_codes").alias("fit_codes"))


def project_population(population: DataFrame, cells: DataFrame, **options) -> DataFrame:
    return summarize_projection(project_sizes(population_sizes(population), cells, **options))


def project_items(population: DataFrame, cells: DataFrame, **options) -> DataFrame:
    """Per-item rows of the projection: every item under every setting."""
    projected = scratch.table(project_sizes(population_sizes(population), cells, **options).drop("items", "top_items"), "projected")
    # Distinct sizes only, so the side is small for any population; counted before it is broadcast.
    return population.join(ranks.bounded_broadcast(projected, projected.count()), ["d_upper", "n"])


def fit_points(cells: DataFrame, name: str = "code_id") -> DataFrame:
    return cells.filter("shots > 0").select(*CELL, (F.col("n") * F.col("rounds")).cast("double").alias("size"), F.col(name).alias("name"))


def bracket_counts(population: DataFrame, cells: DataFrame, name: str = "code_id") -> DataFrame:
    """(p, decoder, bracket, items): where the population lies among the fit points."""
    sizes = population.groupBy((F.col("n") * F.col("d_upper")).cast("double").alias("size")).agg(F.count(F.lit(1)).alias("items"))
    placed = scratch.table(_with_cell_groups(sizes, cells), "sized-items")
    labels = bracket_labels(placed, fit_points(cells, name), CELL, "size")
    return placed.join(labels, [*CELL, "size"]).groupBy(*CELL, "bracket").agg(F.sum("items").alias("items"))


def outside_fit(population: DataFrame, cells: DataFrame) -> DataFrame:
    """Items whose n * d lies outside the fitted sizes of a setting."""
    ends = fit_points(cells).groupBy(*CELL).agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    size = (F.col("n") * F.col("d_upper")).cast("double")
    sizes = population.select(size.alias("size")).distinct()
    out = _with_cell_groups(sizes, cells).join(ends, CELL).filter("size < lo or size > hi").select(*CELL, "size")
    return population.select("code_id", size.alias("size")).join(out, "size").select(*CELL, "code_id", F.col("size").alias("n_d_upper"))


def named_pair(cells: DataFrame, small: str, large: str, name: str = "code_id") -> DataFrame:
    """Two named items side by side per (p, decoder), and whether their intervals separate."""
    fields = ["failures", "shots", "ler", "ler_ci_low", "ler_ci_high"]

    def side(which):
        return F.max(F.when(F.col(name) == which, F.struct(*fields)))

    wide = (cells.filter(F.col(name).isin(small, large)).groupBy(*CELL)
            .agg(side(small).alias("s"), side(large).alias("l")).filter("s is not null and l is not null"))
    apart = rates.separated("s.ler_ci_low", "s.ler_ci_high", "l.ler_ci_low", "l.ler_ci_high")
    return wide.select(*CELL, *[F.col(f"s.{f}").alias(f"small_{f}") for f in fields],
                       *[F.col(f"l.{f}").alias(f"large_{f}") for f in fields], apart.alias("intervals_separate"))


def threshold_readings(cells: DataFrame, program: str = "construction_program_id") -> DataFrame:
    """Per (p, program) with two items or more: is the largest item separately lower, and is every interval above p."""
    at = F.struct("n", "code_id")
    per = cells.groupBy("p", program).agg(
        F.count(F.lit(1)).alias("n_items"), F.min_by("ler_ci_low", at).alias("small_low"),
        F.max_by("ler_ci_high", at).alias("large_high"), F.every(F.col("ler_ci_low") > F.col("p")).alias("every_interval_above_p"))
    improves = F.col("large_high") < F.col("small_low")
    return per.filter("n_items >= 2").select(
        "p", program, "n_items", improves.alias("larger_separately_lower"), "every_interval_above_p",
        (~improves & F.col("every_interval_above_p")).alias("above_threshold"))


def composition(population: DataFrame, flagged: DataFrame, by: Sequence[str], program: str = "construction_program_id",
                settings: Sequence[str] = ("p",)) -> DataFrame:
    """Range of d and the share of items from flagged programs, per population and setting; programs are counted first."""
    per = population.groupBy(*by, program).agg(F.count(F.lit(1)).alias("items"), F.min("d_upper").alias("lo"),
                                               F.max("d_upper").alias("hi"))
    totals = per.groupBy(*by).agg(F.sum("items").alias("codes"), F.min("lo").alias("d_upper_min"), F.max("hi").alias("d_upper_max"))
    shares = per.join(flagged, program).groupBy(*by, *settings).agg(
        F.sum(F.when(F.col("above_threshold"), F.col("items")).otherwise(F.lit(0))).alias("flagged"),
        F.sum("items").alias("read"))
    return totals.join(shares, list(by)).select(*by, *settings, "codes", "d_upper_min", "d_upper_max",
                      (F.col("flagged") / F.col("codes")).alias("fraction_flagged"),
                      ((F.col("codes") - F.col("read")) / F.col("codes")).alias("fraction_without_reading"))


def reprojection_grid(population: DataFrame, cells: DataFrame, budgets: Sequence[int], caps: Sequence[int], cores: int,
                      **options) -> DataFrame:
    """Projection over budget, rate and cap: every population that fits a budget, in one job."""
    by_budget = reconcile.grid(population, budget=budgets).filter(F.col("n") <= F.col("budget"))
    out = summarize_projection(project_sizes(population_sizes(by_budget, ["budget"]), cells, caps=caps, **options), ["budget"])
    return out.withColumn("wall_hours", rates.wall_hours("core_hours", "max_code_core_hours", cores))


def ratio_summary(probe: DataFrame, ratio: str = "ratio") -> DataFrame:
    return probe.agg(F.count(ratio).alias("codes"), F.percentile(ratio, 0.5).alias("median"), F.max(ratio).alias("max"),
                     F.min(ratio).alias("min"))


def probe_table(projected: DataFrame, measured: DataFrame, *, max_shots: int = MAX_SHOTS,
                min_failures: int = MIN_FAILURES) -> DataFrame:
    """Projected items with what a probe measured: ``shots, failures, seconds, finished`` (absent where not started)."""
    j = projected.join(measured, "code_id", "left")
    need = rates.shots_needed_columns("shots", "failures", max_shots=max_shots, min_failures=min_failures)
    started = F.col("shots") > 0
    measured_sps = F.when(started, F.col("seconds") / F.nullif("shots", F.lit(0)))
    censored = (F.when(F.col("finished"), F.col("failures") < min_failures)
                .when(started, need["exceeds_max_shots"]))
    return j.withColumns({
        "started": F.coalesce(started, F.lit(False)), "measured_seconds_per_shot": measured_sps,
        "measured_failure_fraction": F.when(started, F.col("failures") / F.nullif("shots", F.lit(0))),
        "censored_at_max_shots": censored}).withColumn(
        "ratio", F.col("measured_seconds_per_shot") / F.col("seconds_per_shot"))


def cost_report(projected: DataFrame, measured: DataFrame, *, max_shots: int = MAX_SHOTS,
                min_failures: int = MIN_FAILURES) -> DataFrame:
    """One row: ratios of measured to projected seconds, two re-projections, and censoring by subset.

    A finished item costs what it took, a started one its measured pace over the projected run, any other its
    projection times the median or the largest ratio. The lowest third is of started items by failure fraction.
    """
    t = scratch.table(probe_table(projected, measured, max_shots=max_shots, min_failures=min_failures), "probe")
    ratios = scratch.table(ratio_summary(t.filter("started")), "ratios")
    own = F.when(F.col("finished"), F.col("seconds")).otherwise(
        F.col("measured_seconds_per_shot") * F.greatest("run_shots", "shots"))
    status = F.when(F.col("started"), F.col("censored_at_max_shots")).otherwise(F.col("exceeds_max_shots"))
    top = first_fraction(t.select("code_id", "d_upper", "n", status.alias("status")),
                         [F.col("d_upper").desc(), F.col("n").desc(), F.col("code_id").asc()])
    lowest = first_fraction(t.filter("started").select("code_id", "measured_failure_fraction", "censored_at_max_shots"),
                            [F.col("measured_failure_fraction").asc(), F.col("code_id").asc()])
    totals = t.agg(
        F.count(F.lit(1)).alias("codes"), F.sum("core_hours").alias("projected"),
        F.coalesce(F.sum(F.when(F.col("started"), own)), F.lit(0.0)).alias("__own"),
        F.coalesce(F.sum(F.when(~F.col("started"), F.col("core_hours"))), F.lit(0.0)).alias("__rest"),
        F.count_if(status).alias("all_censored"), F.count_if(status.isNull()).alias("all_unknown"))
    top_sum = top.agg(F.count(F.lit(1)).alias("top_codes"), F.count_if("status").alias("top_censored"),
                      F.count_if(F.col("status").isNull()).alias("top_unknown"), F.min("d_upper").alias("top_d_upper_min"))
    low_sum = lowest.agg(F.count(F.lit(1)).alias("lowest_codes"), F.count_if("censored_at_max_shots").alias("lowest_censored"),
                         F.count_if(F.col("censored_at_max_shots").isNull()).alias("lowest_unknown"))

    def of(one_row: DataFrame, *names: str) -> list[Column]:
        return [one_row.select(n).scalar().alias(n) for n in names]

    wide = totals.select("*", *[ratios.select(c).scalar().alias(f"ratio_{c}") for c in ("median", "max", "min")],
                         *of(top_sum, "top_codes", "top_censored", "top_unknown", "top_d_upper_min"),
                         *of(low_sum, "lowest_codes", "lowest_censored", "lowest_unknown"))
    for which in ("median", "max"):
        wide = wide.withColumn(f"reprojected_at_{which}", F.col("__own") / 3600.0 + F.col("__rest") * F.col(f"ratio_{which}"))
    return wide.drop("__own", "__rest")
