"""Orderings, listings, bounded picks and seeded samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import scratch
from ..constants import MIN_D_UPPER, MIN_DIM
from ..errors import Refused
from ..functions import rng
from . import ranks

_TEMPLATES_PER_TASK = 10_000


def longest_first(df: DataFrame, cost: str = "n_d_upper", key: str = "code_id", out: str = "position") -> DataFrame:
    """Position of every item when the costliest run first."""
    return ranks.row_index(df, [F.col(cost).desc(), F.col(key).asc()], out=out)


def listing(df: DataFrame, by: str, order: Sequence[str], masked: Sequence[str], out: str = "position") -> DataFrame:
    """Rows numbered inside their group, with the point estimates of censored rows blanked."""
    placed = ranks.row_index(df, [F.col(c).asc() for c in order], [by], out)
    return placed.withColumns({c: F.when(~F.col("censored"), F.col(c)) for c in masked})


def first_fraction(df: DataFrame, order: Sequence[Column], parts: int = 3) -> DataFrame:
    """The first ceil(N / parts) rows under a total order."""
    placed = ranks.row_index(df, order, out="__idx")
    size = placed.select("__idx").count()
    return placed.filter(F.col("__idx") < math.ceil(size / parts)).drop("__idx")


def top_third_by_size(df: DataFrame, d: str = "d_upper", n: str = "n", key: str = "code_id") -> DataFrame:
    return first_fraction(df, [F.col(d).desc(), F.col(n).desc(), F.col(key).asc()])


def lowest_failing(df: DataFrame, fraction: str = "failure_fraction", key: str = "code_id", *,
                   third_only: bool = False) -> DataFrame:
    """Items by failure fraction, numbered, or only the lowest third of them."""
    order = [F.col(fraction).asc(), F.col(key).asc()]
    return first_fraction(df, order) if third_only else ranks.row_index(df, order, out="position")


def evenly_spaced(df: DataFrame, count: int, cost: str = "n_d_upper", key: str = "code_id") -> DataFrame:
    """``count`` items at evenly spaced ranks, costliest first; ranks round half up; all items when count covers them."""
    placed = longest_first(df, cost, key)
    size = placed.select("position").count()
    if count >= size:
        return placed
    if count == 1:
        wanted = [0]
    else:
        wanted = sorted({(2 * i * (size - 1) + count - 1) // (2 * (count - 1)) for i in range(count)})
    picks = df.sparkSession.createDataFrame([(w,) for w in wanted], "position long")
    return placed.join(ranks.bounded_broadcast(picks, len(wanted)), "position")


def best_items(df: DataFrame, n: int, value: str = "rank_value", key: str = "code_id") -> DataFrame:
    """The ``n`` best items for a report: a distributed top-n, nothing else reaches the driver."""
    return df.orderBy(F.col(value).asc(), F.col(key).asc()).limit(n)


def spanning(df: DataFrame, count: int, d: str = "d_upper", n: str = "n", key: str = "code_id") -> DataFrame:
    """``count`` items nearest to evenly spaced targets over the range of ``d``, none used twice; ties by n, then key.

    Each target keeps its ``count`` nearest items, which are enough whatever the earlier targets took; the limit is
    applied before the shuffle. The final choice looks at those count^2 rows.
    """
    spark = df.sparkSession
    lo, hi, size = df.agg(F.min(d), F.max(d), F.count(F.lit(1))).head()
    if count > size:
        raise Refused(f"cannot choose {count} from {size} items")
    if count == 0:
        return df.limit(0)
    targets = [float(lo)] if count == 1 else [lo + (hi - lo) * i / (count - 1) for i in range(count)]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(targets)])
    spread = df.select(d, n, key, F.explode(cells).alias("c")).select(
        F.col("c.i").alias("i"), F.abs(F.col(d) - F.col("c.t")).alias("gap"), n, key)
    near = spread.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("gap", n, key))).filter(F.col("r") <= count)
    by_target: dict[int, list] = {}
    for row in near.orderBy("i", "r").collect():
        by_target.setdefault(row["i"], []).append(row[key])
    used: dict = {}
    for i in range(count):
        used[next(k for k in by_target[i] if k not in used)] = i
    picks = spark.createDataFrame([(k, i) for k, i in used.items()], df.select(F.col(key), F.lit(0).alias("pick")).schema)
    return df.join(ranks.bounded_broadcast(picks, count), key)


def candidate_grid(templates: DataFrame, budget: int) -> DataFrame:
    """Every (template, l, m) with l, m >= 2 and 2lm <= budget, and its weight under the uniform draw."""
    max_l = budget // (2 * MIN_DIM)
    if max_l < MIN_DIM:
        raise Refused(f"budget {budget} is too small for the smallest candidate")
    # A small file is one task however many candidates its templates have, so templates are spread by their number.
    tasks = max(1, -(-templates.count() // _TEMPLATES_PER_TASK))
    rows = templates.repartition(tasks, *templates.columns) if tasks > 1 else templates
    rows = rows.withColumn("l", F.explode(F.sequence(F.lit(MIN_DIM), F.lit(max_l))))
    max_m = F.floor(F.lit(budget) / (2 * F.col("l"))).cast("int")
    rows = rows.withColumn("m", F.explode(F.sequence(F.lit(MIN_DIM), max_m)))
    n_l, n_m = max_l - MIN_DIM + 1, max_m - (MIN_DIM - 1)
    return rows.withColumn("weight", F.lit(1.0) / (F.lit(n_l) * n_m))


def rejection_cause(k: str = "k", d: str = "d_upper", min_d: int = MIN_D_UPPER) -> Column:
    """Null when admitted, else why not."""
    return F.when(F.col(k) < 1, "k<1").when(F.col(d) < min_d, f"d_upper<{min_d}")


def admission_counts(candidates: DataFrame, programs: DataFrame, program: str = "construction_program_id") -> DataFrame:
    """Accepted and rejected candidates per program and cause, programs with none included."""
    per = candidates.groupBy(program).agg(
        F.count_if(F.col("cause").isNull()).alias("accepted"),
        F.count_if(F.col("cause") == "k<1").alias("rejected_k"),
        F.count_if(F.col("cause").startswith("d_upper")).alias("rejected_d"))
    return programs.select(program).distinct().join(per, program, "left").na.fill(0)


def weighted_order(df: DataFrame, stratum: str, key: Sequence[str], seed: int, weight: str = "weight",
                   out: str = "walk_key") -> DataFrame:
    """A sort key that orders each stratum as a weighted draw without replacement, independent between strata."""
    u = rng.random_unit(F.lit(seed), F.col(stratum), *[F.col(c) for c in key])
    return df.withColumn(out, -F.ln(u) / F.col(weight))


def fill_level(capacities: dict[int, int], wanted: int) -> tuple[int, int]:
    """(level, extra): every stratum gets min(capacity, level), and ``extra`` of those with room get one more.

    ``capacities`` maps a capacity to how many strata have it: the even split with each shortfall shared evenly.
    """
    total = sum(c * s for c, s in capacities.items())
    if wanted > total:
        raise Refused(f"{wanted} items wanted, every stratum is exhausted at {total}")
    taken, open_strata = 0, sum(capacities.values())
    for cap in sorted(capacities):
        level = (wanted - taken) // open_strata
        if level < cap:
            return level, (wanted - taken) - level * open_strata
        taken += cap * capacities[cap]
        open_strata -= capacities[cap]
    return max(capacities, default=0), 0


def balanced_sample(candidates: DataFrame, strata: DataFrame, stratum: str, key: Sequence[str], count: int,
                    seed: int) -> tuple[DataFrame, DataFrame]:
    """An even sample over strata and a report per stratum.

    ``candidates`` carry ``cause`` (null = admissible) and ``weight``. A stratum short of its quota is exhausted and
    its shortfall shared evenly by the others. The report has the first quota, the final one, candidates walked and
    rejections by cause among those walked. What reaches the driver is a histogram of capacities.
    """
    walked = scratch.table(weighted_order(candidates, stratum, key, seed), "walk")
    cap = scratch.table(
        strata.select(stratum).distinct().join(
            walked.filter("cause is null").groupBy(stratum).agg(F.count(F.lit(1)).alias("capacity")), stratum, "left")
        .na.fill(0).withColumn("__h", rng.random_int(F.lit(seed), F.lit("quota"), F.col(stratum))), "capacity")
    histogram = {r["capacity"]: r["count"] for r in cap.groupBy("capacity").count().collect()}
    n_strata = sum(histogram.values())
    level, extra = fill_level(histogram, count)
    order = [F.col("__h").asc(), F.col(stratum).asc()]
    first = ranks.row_index(cap, order, out="__first")
    room = ranks.row_index(cap.filter(F.col("capacity") > level), order, out="__open").select(stratum, "__open")
    got_extra = F.coalesce(F.col("__open") < extra, F.lit(False)).cast("long")
    quotas = first.join(room, stratum, "left").select(
        stratum, "capacity",
        (F.lit(count // n_strata) + (F.col("__first") < count % n_strata).cast("long")).alias("first_quota"),
        (F.least(F.col("capacity"), F.lit(level)) + got_extra).alias("quota"))
    quotas = scratch.table(quotas, "quotas")
    accepted = ranks.row_index(walked.filter("cause is null"), [F.col("walk_key").asc(), *[F.col(c).asc() for c in key]],
                               [stratum], "__pos")
    picks = accepted.join(quotas.select(stratum, "quota"), stratum).filter(F.col("__pos") < F.col("quota")).drop("__pos", "quota")
    picks = scratch.table(picks.withColumn("order_key", rng.random_int(
        F.lit(seed), F.lit("shuffle"), F.col(stratum), *[F.col(c) for c in key])), "picks")
    last = picks.groupBy(stratum).agg(F.max("walk_key").alias("__last"))
    exhausted = F.col("capacity") < F.greatest("first_quota", "quota")
    exhausted = exhausted | ((F.col("quota") == F.col("capacity")) & (F.col("capacity") < F.lit(level)))
    seen = walked.join(last, stratum, "left").join(
        quotas.select(stratum, exhausted.alias("exhausted")), stratum).filter(
        F.col("exhausted") | (F.col("walk_key") <= F.col("__last")))
    causes = seen.groupBy(stratum).agg(F.count(F.lit(1)).alias("attempts"),
                                       F.count_if(F.col("cause") == "k<1").alias("rejected_k"),
                                       F.count_if(F.col("cause").startswith("d_upper")).alias("rejected_d"))
    report = (quotas.withColumn("exhausted", exhausted).join(causes, stratum, "left")
              .na.fill(0, ["attempts", "rejected_k", "rejected_d"]).drop("capacity"))
    return picks, report


def uniform_draws(templates: DataFrame, admissible: DataFrame | Callable[[DataFrame], DataFrame], template: str, count: int,
                  budget: int, seed: int) -> DataFrame:
    """``count`` draws with replacement: template, then l, then m uniform; what is not admissible is drawn again.

    ``admissible`` is a table of (template, l, m), or a function that keeps the admissible of any rows with these columns:
    then only what is drawn is judged, and no grid is built.
    Attempt numbers index the draws, so the first ``count`` accepted attempts are the sample however the range is cut.
    """
    spark = templates.sparkSession
    named = scratch.table(ranks.row_index(templates.select(template).distinct(), [F.col(template).asc()], out="__t"), "templates")
    n_t = named.count()
    grid = None if callable(admissible) else scratch.table(admissible.join(named, template).drop(template), "admissible")
    max_l = budget // (2 * MIN_DIM)
    limit = max(10_000, count * 200)

    def draws(upto: int) -> DataFrame:
        a = spark.range(upto).withColumnRenamed("id", "attempt")
        at = F.col("attempt")
        t = rng.random_below(n_t, F.lit(seed), F.lit("t"), at)
        l = (rng.random_below(max_l - MIN_DIM + 1, F.lit(seed), F.lit("l"), at) + MIN_DIM).cast("int")
        rows = a.select("attempt", t.alias("__t"), l.alias("l"))
        max_m = F.floor(F.lit(budget) / (2 * F.col("l"))).cast("long")
        m = (rng.random_below(max_m - (MIN_DIM - 1), F.lit(seed), F.lit("m"), at) + MIN_DIM).cast("int")
        rows = rows.filter(max_m >= MIN_DIM).withColumn("m", m)
        if grid is not None:
            return rows.join(grid, ["__t", "l", "m"])
        return admissible(rows.join(named, "__t")).select("__t", "l", "m", "attempt")

    upto = min(limit, count * 4 + 1000)
    while True:
        accepted = scratch.table(draws(upto), "draws")
        got = accepted.count()
        if got >= count:
            break
        if upto >= limit:
            raise Refused(f"{got} of {count} draws accepted within {limit} attempts")
        upto = min(limit, upto * 4)
    placed = ranks.row_index(accepted, [F.col("attempt").asc()], out="draw")
    return placed.filter(F.col("draw") < count).join(named, "__t").drop("__t")
