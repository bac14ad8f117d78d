"""Rates, intervals, labels and cost arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..constants import (
    MAX_SHOTS, MIN_DIM, MIN_FAILURES, OPEN_AND_SWAP_TICKS, SHOT_BATCH, Z_95,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _refuse_unless(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def rate_unchecked(p_fail, rounds, k) -> Column:
    """Per-round, per-unit rate of a per-trial failure fraction; the caller vouches for the domain."""
    p_fail, rounds, k = _col(p_fail), _col(rounds), _col(k)
    return F.when(p_fail == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.pow(F.lit(1.0) - p_fail, F.lit(1.0) / (rounds * k)))


def error_rate(p_fail, rounds, k) -> Column:
    """As ``rate_unchecked``, refusing a fraction outside [0, 1), fewer than one round, or k below one."""
    p_fail, rounds, k = _col(p_fail), _col(rounds), _col(k)
    ok = (p_fail >= 0) & (p_fail < 1) & (rounds >= 1) & (k >= 1)
    return _refuse_unless(ok, rate_unchecked(p_fail, rounds, k),
                          "a rate needs a failure fraction in [0, 1), rounds >= 1 and k >= 1")


def _wilson_parts(failures: Column, shots: Column, z: float) -> tuple[Column, Column]:
    n = shots.cast("double")
    p = failures / n
    denom = F.lit(1.0) + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (F.lit(2.0) * n)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (F.lit(4.0) * n * n)) / denom
    return centre - half, centre + half


def wilson_low(failures, shots, z: float = Z_95) -> Column:
    """Lower Wilson bound, clamped at 0; null for no trials."""
    failures, shots = _col(failures), _col(shots)
    return F.when(shots > 0, F.greatest(F.lit(0.0), _wilson_parts(failures, shots, z)[0]))


def wilson_high(failures, shots, z: float = Z_95) -> Column:
    """Upper Wilson bound, clamped at 1; null for no trials."""
    failures, shots = _col(failures), _col(shots)
    return F.when(shots > 0, F.least(F.lit(1.0), _wilson_parts(failures, shots, z)[1]))


def wilson_interval(failures, shots, z: float = Z_95) -> Column:
    """struct(low, high); refuses no trials or a failure count outside [0, shots]."""
    failures, shots = _col(failures), _col(shots)
    ok = (shots > 0) & (failures >= 0) & (failures <= shots)
    both = F.struct(wilson_low(failures, shots, z).alias("low"), wilson_high(failures, shots, z).alias("high"))
    return _refuse_unless(ok, both, "an interval needs shots > 0 and failures in [0, shots]")


def is_censored(failures, min_failures: int = MIN_FAILURES) -> Column:
    return _col(failures) < min_failures


def label_columns(shots="shots", failures="failures", rounds="rounds", k="k", *,
                  min_failures: int = MIN_FAILURES, max_shots: int = MAX_SHOTS) -> dict[str, Column]:
    """Counts to label columns, for ``withColumns``; refuses impossible counts and an item that failed every trial."""
    shots, failures, rounds, k = map(_col, (shots, failures, rounds, k))
    ok = (shots > 0) & (shots <= max_shots) & (failures >= 0) & (failures <= shots)
    low = error_rate(wilson_low(failures, shots), rounds, k)
    high = error_rate(wilson_high(failures, shots), rounds, k)
    censored = _refuse_unless(ok, is_censored(failures, min_failures),
                              "a label needs shots in (0, cap] and failures in [0, shots]")
    rate = F.when(failures >= min_failures, error_rate(failures / shots.cast("double"), rounds, k))
    return {"censored": censored, "true_ler": rate, "true_ler_ub": high,
            "true_ler_ci_low": low, "true_ler_ci_high": high}


def stored_p(p) -> Column:
    """An error rate as it is stored: six decimals, half to even."""
    return F.bround(_col(p), 6)


def tolerant_label_columns(shots="shots", failures="failures", rounds="rounds", k="k", *,
                           min_failures: int = MIN_FAILURES) -> dict[str, Column]:
    """Label columns that keep edge cases as nulls: no trials is censored, all failed has no rate."""
    shots, failures, rounds, k = map(_col, (shots, failures, rounds, k))
    none = shots == 0
    all_failed = (shots > 0) & (failures == shots)
    usable = ~none & ~all_failed
    n = F.nullif(shots, F.lit(0)).cast("double")
    return {
        "censored": none | (~all_failed & (failures < min_failures)),
        "ler": F.when(usable & (failures >= min_failures), rate_unchecked(failures / n, rounds, k)),
        "ler_ci_low": F.when(usable, rate_unchecked(wilson_low(failures, shots), rounds, k)),
        "ler_ci_high": F.when(usable, rate_unchecked(wilson_high(failures, shots), rounds, k)),
        "all_shots_failed": all_failed,
    }


def ranking_value(censored="censored", rate="true_ler", bound="true_ler_ub") -> Column:
    """What an item is ranked by: its rate, or its upper bound when censored."""
    return F.when(_col(censored), _col(bound)).otherwise(_col(rate))


def model_score(pred="pred_log10_ler") -> Column:
    return -_col(pred)


def log_target(censored="censored", rate="true_ler") -> Column:
    """Regression target, null where censored; refuses a rate with no finite logarithm."""
    censored, rate = _col(censored), _col(rate)
    ok = (rate > 0) & (rate < math.inf)
    return F.when(~censored, _refuse_unless(ok, F.log10(rate), "an uncensored row needs a positive finite rate"))


def phi(k="k", d="d_upper", n="n") -> Column:
    """The baseline score k d^2 / n."""
    return _col(k) * _col(d) * _col(d) / _col(n).cast("double")


def size_columns(n="n", d="d_upper", n_checks="n_checks") -> dict[str, Column]:
    n, d, n_checks = _col(n), _col(d), _col(n_checks)
    return {"n_ancilla": n_checks, "n_total": n + n_checks, "n_d_upper": n * d}


def schedule_columns(l="l", m="m", a_exps="a_exps", b_exps="b_exps", d="d_upper") -> dict[str, Column]:
    """Schedule costs from parameters; refuses two monomials that coincide on the l by m torus."""
    l, m, a, b, d = map(_col, (l, m, a_exps, b_exps, d))

    def folded(e: Column) -> Column:
        return F.array_distinct(F.transform(e, lambda x: F.struct(F.pmod(x["i"], l), F.pmod(x["j"], m))))

    terms = F.size(a) + F.size(b)
    distinct = (F.size(folded(a)) == F.size(a)) & (F.size(folded(b)) == F.size(b))
    per_round = _refuse_unless(distinct, F.lit(2) * l * m * terms, "two monomials coincide, so no schedule exists")
    return {"cx_per_round": per_round, "cx_total": per_round * d,
            "circuit_ticks": d * (F.lit(2) * terms + F.lit(OPEN_AND_SWAP_TICKS))}


def schedulable(l="l", m="m", a_exps="a_exps", b_exps="b_exps") -> Column:
    l, m, a, b = map(_col, (l, m, a_exps, b_exps))

    def distinct(e: Column) -> Column:
        return F.size(F.array_distinct(F.transform(e, lambda x: F.struct(F.pmod(x["i"], l), F.pmod(x["j"], m))))) == F.size(e)

    return distinct(a) & distinct(b)


def shots_needed_columns(shots="shots", failures="failures", *, max_shots: int | Column = MAX_SHOTS,
                         min_failures: int = MIN_FAILURES) -> dict[str, Column]:
    """Trials to reach the failure target: estimate, Wilson range, and a three-valued 'exceeds the cap'."""
    shots, failures = _col(shots), _col(failures)
    need = F.lit(float(min_failures))
    low, high = wilson_low(failures, shots), wilson_high(failures, shots)
    estimate = F.when((shots > 0) & (failures > 0),
                      F.ceil(F.lit(min_failures) * shots / F.nullif(failures, F.lit(0)).cast("double")))
    range_low = F.when(shots > 0, F.ceil(need / F.nullif(high, F.lit(0.0))))
    range_high = F.when((shots > 0) & (low > 0), F.ceil(need / F.nullif(low, F.lit(0.0))))
    exceeds = (F.when(shots == 0, F.lit(None).cast("boolean"))
               .when(failures > 0, estimate > max_shots)
               .when(range_low > max_shots, F.lit(True)))
    return {"shots_estimate": estimate.cast("long"), "shots_range_low": range_low.cast("long"),
            "shots_range_high": range_high.cast("long"), "exceeds_max_shots": exceeds}


def run_shots_columns(estimate="shots_estimate", exceeds="exceeds_max_shots", *, max_shots: int | Column = MAX_SHOTS,
                      shot_batch: int = SHOT_BATCH) -> dict[str, Column]:
    """Trials a run would take, in whole batches and unbatched; unknown or over the cap is costed at the cap."""
    estimate, exceeds = _col(estimate), _col(exceeds)
    cap = (max_shots if isinstance(max_shots, Column) else F.lit(max_shots)).cast("long")
    at_cap = estimate.isNull() | F.coalesce(exceeds, F.lit(False))
    batched = F.least(F.ceil(estimate / F.lit(float(shot_batch))).cast("long") * shot_batch, cap)
    return {"run_shots": F.when(at_cap, cap).otherwise(batched),
            "run_shots_unbatched": F.when(at_cap, cap).otherwise(F.least(estimate, cap))}


def separated(low_a, high_a, low_b, high_b) -> Column:
    """Do two intervals separate; null when either is unknown."""
    low_a, high_a, low_b, high_b = map(_col, (low_a, high_a, low_b, high_b))
    return F.when(low_a.isNotNull() & low_b.isNotNull(), (high_a < low_b) | (high_b < low_a))


def power_law(a, b, size) -> Column:
    return F.exp(_col(a) + _col(b) * F.ln(_col(size)))


def wall_hours(core_hours, longest, cores: int) -> Column:
    return F.greatest(_col(core_hours) / F.lit(float(cores)), _col(longest))


def _ln_factorial(x: Column) -> Column:
    """Stirling's series; from 64 on the first term left out is below 1e-16."""
    v = x.cast("double")
    return (v + 0.5) * F.ln(v) - v + 0.5 * math.log(2 * math.pi) + 1 / (12 * v) - 1 / (360 * F.pow(v, 3)) + 1 / (1260 * F.pow(v, 5))


def mcnemar_exact(only_a, only_b) -> Column:
    """Two-sided exact p-value on discordant counts, in log space.

    The largest term of the lower tail is at i = min(a, b); the sum walks down from it by term ratios. Terms beyond
    4.5 sqrt(n) places fall below 1e-17 of the first, so a row's work grows with sqrt(n) at most.
    """
    a, b = _col(only_a).cast("long"), _col(only_b).cast("long")
    n, m = a + b, F.least(a, b)
    # The logarithm of n over m: a sum of logs where m is short, else by series.
    summed = F.aggregate(
        F.when(m > 0, F.sequence(F.lit(1).cast("long"), F.least(m, F.lit(64)))).otherwise(F.array().cast("array<bigint>")),
        F.lit(0.0), lambda acc, i: acc + F.ln((n - m + i).cast("double")) - F.ln(i.cast("double")))
    log_top = F.when(m <= 64, summed).otherwise(_ln_factorial(n) - _ln_factorial(m) - _ln_factorial(n - m))
    steps = F.least(m, (F.ceil(4.5 * F.sqrt(n.cast("double"))) + 10).cast("long"))
    tail = F.aggregate(
        F.when(m > 0, F.sequence(m, m - steps + 1)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, i: F.struct(
            (s["term"] * i / (n - i + 1)).alias("term"),
            (s["total"] + s["term"] * i / (n - i + 1)).alias("total")),
        lambda s: s["total"])
    p = F.exp(F.lit(math.log(2.0)) + log_top + F.ln(tail) - n * F.lit(math.log(2.0)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))


def null_if_nan(x) -> Column:
    x = _col(x)
    return F.when(~F.isnan(x), x)
