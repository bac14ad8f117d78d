"""Paired bootstrap intervals and the label-noise ceiling.

A resample never copies rows: it is a weight per (replicate, item), and a duplicated item is a tie, which the weighted
ranks handle exactly. Both scores are read on the same weights, so their difference is paired.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import scratch
from ..constants import (
    BOOTSTRAP_RESAMPLES, BOOTSTRAP_SEED, LABEL_NOISE_DRAWS, LABEL_NOISE_SEED, RECALL_K, RECALL_TOP_N,
)
from ..errors import Refused
from ..functions import rates, rng
from . import ranks
from .metrics import Metric, Standing, default_metrics

_COLUMNS = ("truth", "a", "b")
_DRAWS_PER_TASK = 250_000
#: Replicates that share a task's reading and coding of the items, at most, and rows that leave it at once.
_REPLICATES_PER_TASK = 16
_ROWS_PER_BATCH = 250_000
#: Items of one replicate in a task: some 80 bytes each there, and 24 in the broadcast.
_REPLICATE_ROWS = 8_000_000
_PACK = 1 << 16
#: Items of the label-noise ceiling that are drawn to bound the others, at most.
_FEW = 5_000


def resample_weights(spark, n_items: int, n_resamples: int, seed: int) -> DataFrame:
    """(rep, row_idx, w): how often each replicate of ``n_items`` draws with replacement took each item.

    Each draw is a hash of (seed, replicate, slot), so it can be made anywhere. Draws are made all over and counted per (replicate, item).
    """
    ids = spark.range(n_items * n_resamples)
    rep = F.expr(f"id div {n_items}L")
    slot = F.col("id") % F.lit(n_items)
    draws = ids.select(rep.alias("rep"), rng.random_below(n_items, F.lit(seed), rep, slot).alias("row_idx"))
    return draws.groupBy("rep", "row_idx").agg(F.count(F.lit(1)).alias("w"))


def _packed(items: DataFrame) -> DataFrame:
    """The items' values as rows of ``_PACK`` items each, in the order of ``row_idx``."""
    x = F.sort_array(F.collect_list(F.struct("row_idx", *_COLUMNS)))
    return items.groupBy(F.expr(f"row_idx div {_PACK}L").alias("pack")).agg(x.alias("x")).select("pack", *[F.col(f"x.{c}").alias(f"__{c}") for c in _COLUMNS])


def _order_codes(packs: list, n: int) -> np.ndarray:
    """The position of each item's value among the distinct ones: nulls first, NaN last."""
    value, null = np.empty(n), np.zeros(n, bool)
    for pack, column in packs:
        at = slice(pack * _PACK, pack * _PACK + len(column))
        null[at] = column.is_null().to_numpy(zero_copy_only=False)
        value[at] = column.fill_null(-math.inf).to_numpy(zero_copy_only=False)
    codes = np.unique(value, return_inverse=True)[1].astype(np.int32)
    if null.any():
        codes += 1
        codes[null] = 0
    return codes


def _task_standings(items: DataFrame, n: int, n_resamples: int, seed: int) -> DataFrame:
    """(rep, w and the standings of ``_COLUMNS``) of each item a replicate drew, made on arrays of the items.

    A task reads the broadcast packs once, codes each column by its order, and then draws and counts one replicate after
    the other: a column's counts by code, added up, are what is below. Nothing is sorted per replicate, nor shuffled.
    """
    names = [f"{c}_{k}" for c in _COLUMNS for k in ("below", "tie")]
    tasks = max(1, min(-(-n_resamples // _REPLICATES_PER_TASK), -(-n * n_resamples // _DRAWS_PER_TASK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packs = set(), [[] for _ in _COLUMNS]
        for batch in batches:
            for i, (task, pack) in enumerate(zip(batch.column("task").to_pylist(), batch.column("pack").to_pylist())):
                own.add(task)
                for c, column in zip(_COLUMNS, packs):
                    column.append((pack, batch.column(f"__{c}")[i].values))
        codes = [_order_codes(packs.pop(0), n) for _ in _COLUMNS]
        distinct = [int(c.max()) + 1 for c in codes]
        for rep in (r for task in sorted(own) for r in range(task, n_resamples, tasks)):
            drawn = np.bincount(rng.ints_below(n, n, seed, rep), minlength=n).astype(np.int32)
            took = np.flatnonzero(drawn)
            w, made = drawn[took], []
            for code, size in zip(codes, distinct):
                tie = np.bincount(code[took], w, size).astype(np.int32)     # exact: whole numbers far below 2^53
                below = np.cumsum(tie, dtype=np.int32) - tie
                made += [below[code[took]], tie[code[took]]]
            for at in range(0, len(took), _ROWS_PER_BATCH):
                cut = slice(at, at + _ROWS_PER_BATCH)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(w[cut]), rep), w[cut], *[m[cut] for m in made])], ["rep", "w", *names])

    placed = items.sparkSession.range(0, tasks, 1, tasks).withColumnRenamed("id", "task")
    placed = placed.crossJoin(F.broadcast(scratch.table(_packed(items), "resample-packs")))
    drawn = placed.mapInArrow(run, ", ".join(["rep long", *[f"{c} int" for c in ("w", *names)]]))
    return drawn.select("rep", *[F.col(c).cast("long").alias(c) for c in ("w", *names)])


def _ranged_standings(weighted: DataFrame, items: DataFrame) -> DataFrame:
    """The same for replicates too large for a task: each column's replicate is cut into ranges of its values."""
    weighted = scratch.table(weighted, "resample")
    for c in _COLUMNS:
        cuts = ranks.Ranges.of(items, c)
        table = ranks.value_ranks(weighted, ["rep"], c, "w", cuts)
        weighted = (ranks.join_ranks(weighted, table, ["rep", c], cuts.rows)
                    .withColumnRenamed("below", f"{c}_below").withColumnRenamed("tie", f"{c}_tie"))
    return weighted


def _looked_up(weights: DataFrame, items: DataFrame) -> DataFrame:
    """The weights with their items' values, read from broadcast arrays of ``_PACK`` items each, so that no draw is shuffled."""
    at = (F.col("row_idx") % F.lit(_PACK)).cast("int")
    return (weights.withColumn("pack", F.expr(f"row_idx div {_PACK}L")).join(F.broadcast(scratch.table(_packed(items), "resample-packs")), "pack")
            .select("rep", "row_idx", "w", *[F.get(F.col(f"__{c}"), at).alias(c) for c in _COLUMNS]))


def bootstrap_replicates(df: DataFrame, score_a: str, score_b: str, key: str = "code_id", truth: str = "rank_value", *,
                         n_resamples: int = BOOTSTRAP_RESAMPLES, seed: int = BOOTSTRAP_SEED,
                         metrics: Sequence[Metric] | None = None, task_rows: int = _REPLICATE_ROWS) -> DataFrame:
    """(rep, metric, a, b, difference): both scores of every replicate, measured on the same draw."""
    if n_resamples < 1:
        raise Refused(f"n_resamples must be >= 1; got {n_resamples}")
    metrics = metrics or default_metrics()
    narrow = df.select(key, F.col(truth).cast("double").alias("truth"), (-F.col(score_a).cast("double")).alias("a"),
                       (-F.col(score_b).cast("double")).alias("b"))
    items = ranks.row_index(narrow, [F.col(key).asc()]).drop(key)
    items = scratch.table(items, "resample-items")
    n = items.count()
    if 0 < n <= task_rows:
        placed = _task_standings(items, n, n_resamples, seed)
    else:
        weights = resample_weights(df.sparkSession, n, n_resamples, seed)
        placed = _ranged_standings(_looked_up(weights, items) if n <= 2 * _REPLICATE_ROWS else weights.join(items, "row_idx"), items)

    def standing(side: str) -> Standing:
        return Standing(F.col("truth_below"), F.col("truth_tie"), F.col(f"{side}_below"), F.col(f"{side}_tie"), F.col("w"))

    values = placed.groupBy("rep").agg(
        *[m.value(standing(side)).alias(f"__{side}{i}") for i, m in enumerate(metrics) for side in "ab"])
    cells = F.array(*[F.struct(F.lit(m.name).alias("metric"), F.col(f"__a{i}").alias("a"), F.col(f"__b{i}").alias("b"))
                      for i, m in enumerate(metrics)])
    return (values.select("rep", F.explode(cells).alias("c")).select("rep", "c.metric", "c.a", "c.b")
            .withColumn("difference", F.col("a") - F.col("b")))


def require_defined(replicates: DataFrame) -> DataFrame:
    """A replicate on which a metric is undefined is refused, never dropped."""
    bad = replicates.filter(F.col("a").isNull() | F.col("b").isNull()).count()
    if bad:
        raise Refused(f"a metric is undefined on {bad} resamples")
    return replicates


def percentile_interval(value, low: float = 0.025, high: float = 0.975) -> Column:
    """Exact percentiles with linear interpolation, as an array of two."""
    return F.percentile(value, [low, high])


def bootstrap_intervals(replicates: DataFrame, names=("model", "baseline", "difference")) -> DataFrame:
    """(metric, scorer, low, high) from the replicates."""
    cells = F.array(*[F.struct(F.lit(name).alias("scorer"), F.col(c).alias("value"))
                      for name, c in zip(names, ("a", "b", "difference"))])
    return (replicates.select("metric", F.explode(cells).alias("c")).select("metric", "c.scorer", "c.value")
            .groupBy("metric", "scorer").agg(percentile_interval("value").alias("q"))
            .select("metric", "scorer", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")))


_SIDES = (("x", 1), ("y", 2))


def _gamma_attempt(rows: DataFrame) -> DataFrame:
    """One squeeze-and-reject try for the Gamma draws ``gx`` and ``gy`` of shapes ``a`` and ``b`` that are still null."""
    kept = rows.columns
    uses = {f"u{s}{i}": F.lit(4096 * stream).cast("long") + (F.col("attempt") * 3 + F.lit(i) if i else F.lit(0)) for s, stream in _SIDES for i in range(4)}
    rows = rng.with_units(rows, "counter", uses)
    sides = tuple(zip("xy", "ab"))
    # A shape below one is raised by one, and the draw scaled back.
    rows = rng.bind(rows, **{f"d{s}": F.when(F.col(p) < 1, F.col(p) + F.lit(1.0)).otherwise(F.col(p)) - F.lit(1.0 / 3.0) for s, p in sides},
                    **{f"z{s}": F.sqrt(F.lit(-2.0) * F.log(F.col(f"u{s}1"))) * F.cos(F.lit(2.0 * math.pi) * F.col(f"u{s}2")) for s, _ in sides})
    rows = rng.bind(rows, **{f"w{s}": F.lit(1.0) + F.col(f"z{s}") / F.sqrt(F.lit(9.0) * F.col(f"d{s}")) for s, _ in sides})
    rows = rng.bind(rows, **{f"v{s}": F.col(f"w{s}") * F.col(f"w{s}") * F.col(f"w{s}") for s, _ in sides})

    def tried(s: str, shape: str) -> Column:
        d, z, v = F.col(f"d{s}"), F.col(f"z{s}"), F.col(f"v{s}")
        ok = (v > 0) & (F.log(F.col(f"u{s}3")) < F.lit(0.5) * z * z + d - d * v + d * F.log(v))
        back = F.when(F.col(shape) < 1, F.pow(F.col(f"u{s}0"), F.lit(1.0) / F.col(shape))).otherwise(F.lit(1.0))
        return F.coalesce(F.col(f"g{s}"), F.when(ok, d * v * back))
    rows = rng.bind(rows, **{f"t{s}": tried(s, p) for s, p in sides})
    return rows.select(*[c for c in kept if c not in ("gx", "gy")], F.col("tx").alias("gx"), F.col("ty").alias("gy"))


def beta_draws(rows: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda drawn: drawn) -> DataFrame:
    """``keep`` of the rows with ``p``, one Beta(a, b) draw each and a function of ``counter``, ``a`` and ``b``.

    Draws that are rejected, one row in some twenty, are written out and tried again until none is left.
    """
    none = F.lit(None).cast("double")
    rows = rows.withColumns({"a": F.col("a").cast("double"), "b": F.col("b").cast("double"), "gx": none, "gy": none})
    rows, done = rows.withColumn("attempt", F.lit(0).cast("long")), []
    while True:
        rows = _gamma_attempt(rows)
        both = F.col("gx").isNotNull() & F.col("gy").isNotNull()
        done.append(keep(rows.filter(both).withColumn("p", F.col("gx") / (F.col("gx") + F.col("gy"))).drop("gx", "gy", "a", "b", "counter", "attempt")))
        rows = scratch.table(rows.filter(~both).withColumn("attempt", F.col("attempt") + 1), "rejected-draws")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)


#: A uniform of ``rng.with_units`` is at least 2^-32, so its logarithm at least ``-_LOG`` and no normal beyond ``_FAR``.
_LOG = 32 * math.log(2.0)
_FAR = math.sqrt(2 * _LOG)
_SLACK = 1e-9


def gamma_range(rows: DataFrame, shape: str, least: str, most: str) -> DataFrame:
    """Bounds of every draw ``_gamma_attempt`` can accept for ``shape``, in whichever try.

    A draw is d w^3. w is at least 1 - _FAR / sqrt(9 d); and acceptance asks d g(w) > log(u) >= -_LOG of a growing function
    g(w) = 9/2 (1 - w)^2 + 1 - w^3 + 3 ln w, which solved for its logarithm gives a bound that each step tightens.
    """
    kept, d, one = rows.columns, F.col("__d"), F.lit(1.0)
    rows = rng.bind(rows, __d=F.when(F.col(shape) < 1, F.col(shape) + one).otherwise(F.col(shape)) - F.lit(1.0 / 3.0), __w0=F.lit(0.0))
    for i in range(3):
        w = F.col(f"__w{i}")
        rows = rng.bind(rows, **{f"__w{i + 1}": F.exp((F.lit(-_LOG) / d - F.lit(4.5) * (one - w) * (one - w) - one + w * w * w) / F.lit(3.0))})
    low = F.col("__w3")
    far = F.lit(_FAR) / F.sqrt(F.lit(9.0) * d)
    back = F.when(F.col(shape) < 1, F.pow(F.lit(2.0 ** -32), one / F.col(shape))).otherwise(one)
    return rows.select(*kept, (d * F.pow(F.greatest(low, one - far), F.lit(3.0)) * back * F.lit(1 - _SLACK)).alias(least),
                       (d * F.pow(one + far, F.lit(3.0)) * F.lit(1 + _SLACK)).alias(most))


def _beyond(least_x: Column, most_y: Column, bound: Column) -> Column:
    """Is the rate of x / (x + y) beyond ``bound`` for every x from ``least_x`` up and y up to ``most_y``, rounding allowed for?"""
    p = least_x / (least_x + most_y) * F.lit(1 - _SLACK)
    return rates.rate_unchecked(p, "rounds", "k") > bound * F.lit(1 + _SLACK) + F.lit(1e-14)


def near_draws(items: DataFrame, bounds: list[float]) -> DataFrame:
    """(draw, bound, score_p, rounds, k, a, b, counter): every draw of ``items`` but those beyond the bound of their draw.

    The first try for the first Gamma draw, where it is accepted, decides nearly all draws. It is tried here on arrays with a
    margin for their rounding; a draw it leaves open is made by ``beta_draws`` like any other.
    """
    names = ["draw", "bound", "score_p", "rounds", "k", "a", "b", "counter"]
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields} | {"draw": "int", "bound": "double"}

    def run(batches):
        bound, draw = np.array(bounds), np.arange(len(bounds))
        limit = bound * (1 + _SLACK) + 1e-13
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at:at + 64]
                column = lambda c, kind=np.float64: part[c].to_numpy(kind)[:, None]
                counter = column("counter", np.int64) + draw * rng.STRIDE
                u1, u2, u3 = rng.units(counter, [4096 + i for i in (1, 2, 3)])   # the first of ``_gamma_attempt``
                a, folds = column("a"), column("rounds") * column("k")
                d = a - 1 / 3
                z = np.sqrt(-2 * np.log(u1)) * np.cos(2 * math.pi * u2)
                v = (1 + z / np.sqrt(9 * d)) ** 3
                ok = (v > 0) & (a >= 1) & (folds >= 1)
                v = np.where(ok, v, 1.0)
                ok &= np.log(u3) < 0.5 * z * z + d - d * v + d * np.log(v) - _SLACK
                # 1 - (1 - p)^(1 / folds) > limit wherever p > folds * limit.
                ok &= d * v / (d * v + column("most_y")) * (1 - _SLACK) > folds * limit
                item, which = np.nonzero(~ok)
                yield part.iloc[item].assign(draw=which.astype(np.int32), bound=bound[which], counter=counter[item, which])[names]
    return items.mapInPandas(run, ", ".join(f"{n} {types[n]}" for n in names))


def label_noise_draws(df: DataFrame, key: str = "code_id", *, n_draws: int = LABEL_NOISE_DRAWS,
                      seed: int = LABEL_NOISE_SEED, k: int = RECALL_K, top_n: int = RECALL_TOP_N) -> DataFrame:
    """(draw, recall): the observed order scored against labels redrawn from their own noise.

    Each draw needs only its ``top_n`` best rates and their ties. The ``top_n``-th best of any few items bounds that of
    all from above, so the items with the best observed rates are drawn first. An item none of whose draws can come
    within its bound, in whatever try, is not drawn; of the others, most leave after the first try of their first Gamma draw.
    """
    base = df.select(key, "failures", "shots", "rounds", "k", F.col("rank_value").cast("double").alias("rank_value"))
    base = ranks.with_top_probability(base, [], "rank_value", k, "score_p")
    base = base.withColumns({"counter": rng.random_int(F.lit(seed), F.col(key)), "a": F.col("failures") + F.lit(0.5),
                             "b": F.col("shots") - F.col("failures") + F.lit(0.5)})
    base = gamma_range(gamma_range(base, "a", "least_x", "most_x"), "b", "least_y", "most_y").drop("most_x", "least_y")
    base = scratch.table(base, "noise-items")

    def within(items: DataFrame, bounds: list[float]) -> DataFrame:
        """The draws of ``items`` at most as large as the bound of their draw; one bound per draw, whatever the number of items."""
        least = _beyond(F.col("least_x"), F.col("most_y"), F.lit(max(bounds)))
        items = scratch.table(items.filter(~F.coalesce(least, F.lit(False))), "noise-reaching")
        tasks = max(1, -(-items.count() * n_draws // (8 * _DRAWS_PER_TASK)))
        near = scratch.table(near_draws(items.repartition(tasks, key), bounds), "noise-near")
        return beta_draws(near, lambda drawn: drawn.select("draw", "bound", "score_p", rates.rate_unchecked("p", "rounds", "k").alias("rate")).filter("rate <= bound"))

    bounds = [math.inf] * n_draws
    # The more items, the more of the best are drawn first; no more than a task sorts with ease.
    few = within(base.orderBy("rank_value", key).limit(max(4 * top_n, min(base.count() >> 8, _FEW))), bounds)
    best = F.coalesce(F.get(F.sort_array(F.collect_list("rate")), F.lit(top_n - 1)), F.lit(math.inf))
    for draw, bound in few.groupBy("draw").agg(best).collect():   # one row per draw
        bounds[draw] = bound
    best = within(base, bounds).withColumn("r", F.rank().over(Window.partitionBy("draw").orderBy("rate"))).filter(F.col("r") <= top_n)
    ties = best.groupBy("draw", "rate", "r").agg(F.count(F.lit(1)).alias("tie"), F.sum("score_p").alias("p"))
    hit = F.col("p") * ranks.top_share(top_n, F.col("r") - 1, F.col("tie"))
    return ties.groupBy("draw").agg((F.sum(hit) / top_n).alias("recall"))


def label_noise_ceiling(df: DataFrame, key: str = "code_id", *, n_draws: int = LABEL_NOISE_DRAWS,
                        seed: int = LABEL_NOISE_SEED, k: int = RECALL_K, top_n: int = RECALL_TOP_N) -> DataFrame:
    """One row: mean and 5th and 95th percentiles over the draws."""
    draws = label_noise_draws(df, key, n_draws=n_draws, seed=seed, k=k, top_n=top_n)
    return (draws.agg(F.avg("recall").alias("mean"), F.percentile("recall", [0.05, 0.95]).alias("q"))
            .select(F.lit(f"recall_at_{k}_of_top_{top_n}_label_noise_ceiling").alias("metric"), "mean",
                    F.col("q")[0].alias("p05"), F.col("q")[1].alias("p95"), F.lit(n_draws).alias("n_draws")))
