"""Ranks, row numbers, running totals and nearest neighbours without a single-task window.

Every order here is cut into ranges of the ordered value first, so the rows of one group, or of the whole table, are
spread over many tasks. A window then runs inside one (group, range), and the totals of the ranges before it, at most
a few thousand rows per group, are added as an offset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import scratch
from ..constants import BROADCAST_ROWS, HOT_KEY_ROWS, ROWS_PER_BUCKET

_MAX_RANGES = 1024
_RUN_CHUNK = 4096


class Ranges:
    """Cut points of a numeric column: rows at equal values always fall in the same range."""

    def __init__(self, bounds: Sequence[float], rows: int):
        self.bounds, self.rows = list(bounds), rows

    @classmethod
    def of(cls, df: DataFrame, value: str, rows_per_range: int = ROWS_PER_BUCKET) -> "Ranges":
        return cls.of_all(df, [value], rows_per_range)[0]

    @classmethod
    def of_all(cls, df: DataFrame, values: Sequence[str], rows_per_range: int = ROWS_PER_BUCKET) -> "list[Ranges]":
        """Approximate quantiles of several columns in one pass; how the rows are cut changes only the balance, never a result."""
        probs = ", ".join(f"{i / _MAX_RANGES}D" for i in range(1, _MAX_RANGES))
        both = [(F.count(f"v{i}").alias(f"n{i}"), F.expr(f"percentile_approx(v{i}, array({probs}), 10000)").alias(f"q{i}")) for i in range(len(values))]
        row = df.select(*[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]).agg(*[c for pair in both for c in pair]).head()
        return [cls._cut(row[f"n{i}"], row[f"q{i}"] or [], rows_per_range) for i in range(len(values))]

    @classmethod
    def _cut(cls, n: int, q: Sequence[float], rows_per_range: int) -> "Ranges":
        want = min(_MAX_RANGES, max(4, math.ceil(n / rows_per_range)))
        step = _MAX_RANGES / want
        picked = [q[int(i * step) - 1] for i in range(1, want)] if q else []
        return cls(sorted({float(x) for x in picked if math.isfinite(x)}), n)

    def assign(self, df: DataFrame, value: str, out: str) -> DataFrame:
        """Add the range number of ``value``: a JVM-side binary search over the cut points."""
        if not self.bounds:
            return df.withColumn(out, F.lit(0))
        tmp, raw = f"__{out}_in", f"__{out}_out"
        cut = Bucketizer(splits=[-math.inf, *self.bounds, math.inf], inputCol=tmp, outputCol=raw)
        return (cut.transform(df.withColumn(tmp, F.col(value).cast("double")))
                .withColumn(out, F.col(raw).cast("int")).drop(tmp, raw))


def value_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None,
                ranges: Ranges | None = None) -> DataFrame:
    """One row per (group, distinct value): ``below`` = weight strictly below it, ``tie`` = its own weight.

    The average-tie rank of every row at that value is ``below + (tie + 1) / 2``; its chance to be among the m
    smallest is ``(m - below) / tie`` cut to [0, 1]. A value held by a third of all rows is one row here.
    """
    by = list(by)
    ranges = ranges or Ranges.of(df, value)
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    values = ranges.assign(df.groupBy(*by, value).agg(amount.alias("tie")), value, "__range")
    totals = values.groupBy(*by, "__range").agg(F.sum("tie").alias("__total"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (values.join(offsets, [*by, "__range"])
            .withColumn("below", F.col("__offset") + F.coalesce(F.sum("tie").over(inside), F.lit(0)))
            .select(*by, value, "below", "tie"))


def join_ranks(rows: DataFrame, ranks: DataFrame, on: Sequence[str], total_rows: int) -> DataFrame:
    """Rows with their value's ``below`` and ``tie``.

    When the table is large enough for one value to overload a join task, the few values above the hot threshold (at
    most ``total_rows / threshold``) are broadcast and the rest joined by shuffle, so no task gets a hot value's rows.
    """
    on = list(on)
    threshold = max(HOT_KEY_ROWS, total_rows // 1000)
    if total_rows <= threshold:
        return rows.join(ranks, on)
    ranks = scratch.table(ranks, "ranks")
    hot = ranks.filter(F.col("tie") > threshold)
    cold = ranks.filter(F.col("tie") <= threshold)
    return (rows.join(F.broadcast(hot), on)
            .unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)))


def average_rank(below="below", tie="tie") -> Column:
    return F.col(below) + (F.col(tie) + F.lit(1.0)) / F.lit(2.0)


def top_share(m: int, below: Column, tie: Column) -> Column:
    """Chance of being among the ``m`` smallest, ties at the cut-off sharing the remaining slots."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(m) - below).cast("double") / tie))


def with_average_rank(df: DataFrame, by: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Every row with its average-tie rank in its group."""
    ranges = Ranges.of(df, value)
    ranks = value_ranks(df, by, value, ranges=ranges)
    return (join_ranks(df, ranks, [*by, value], ranges.rows)
            .withColumn(out, average_rank()).drop("below", "tie"))


def with_average_ranks(df: DataFrame, wanted: Sequence[tuple[Sequence[str], str, str]]) -> DataFrame:
    """Several (group, value, out) ranks: every rank table comes from one base, all cut points from one pass over it."""
    cuts = Ranges.of_all(df, [value for _, value, _ in wanted])
    tables = [value_ranks(df, by, value, ranges=cut) for (by, value, _), cut in zip(wanted, cuts)]
    out = df
    for i, ((by, value, name), table, cut) in enumerate(zip(wanted, tables, cuts)):
        out = join_ranks(out, table, [*by, value], cut.rows).withColumn(name, average_rank()).drop("below", "tie")
        out = out if i == len(wanted) - 1 else scratch.table(out, "ranked")
    return out


def with_top_probability(df: DataFrame, by: Sequence[str], value: str, m: int, out: str = "top_p") -> DataFrame:
    ranges = Ranges.of(df, value)
    ranks = value_ranks(df, by, value, ranges=ranges)
    return (join_ranks(df, ranks, [*by, value], ranges.rows)
            .withColumn(out, top_share(m, F.col("below"), F.col("tie"))).drop("below", "tie"))


def tasks_for(rows: int, task_rows: int = ROWS_PER_BUCKET) -> int:
    """Tasks for that many rows. A count of its own keeps a shuffle's tasks at that size; the planner's target is in compressed bytes."""
    return max(1, -(-rows // task_rows))


def row_index(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "row_idx", task_rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Zero-based position of every row in its group under a total order.

    Rows are range-partitioned on (group, order), so a hot group spans many tasks, and numbered inside each partition.
    The numbered table is written out: the positions then never change if a task is run again. Partition offsets and
    group starts are one row per partition and per group.
    """
    by = list(by)
    keys = [F.col(c).asc() for c in by] + list(order)
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = scratch.table(spread.withColumn("__pos", F.monotonically_increasing_id()), "row-index")
    part, local = F.shiftright("__pos", 33), F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.withColumn("__part", part).withColumn("__local", local)
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One row per partition of the sort, so the side is bounded by the partition count.
    placed = numbered.join(F.broadcast(offsets), "__part").withColumn("__global", F.col("__before") + F.col("__local"))
    if by:
        # A group's start is looked up per (partition, group), so a hot group's rows stay spread over its partitions.
        # Joins normalize floating keys and so shuffle again; as text they stay where they were placed.
        tasks, kinds = tasks_for(numbered.count(), task_rows), dict(df.dtypes)
        keys = {f"__by{i}": (F.col(c) + F.lit(0.0)).cast("string") if kinds[c] in ("float", "double") else F.col(c) for i, c in enumerate(by)}
        placed = placed.withColumns(keys).repartition(tasks, "__part", *keys)
        first = placed.groupBy("__part", *keys).agg(F.min("__global").alias("__first"))
        starts = first.select("__part", *keys, F.min("__first").over(Window.partitionBy(*keys)).alias("__start"))
        placed = placed.join(scratch.shuffled(starts.repartition(tasks, "__part", *keys)), ["__part", *keys]).withColumn(out, F.col("__global") - F.col("__start"))
    else:
        placed = placed.withColumn(out, F.col("__global"))
    return placed.select(*df.columns, out)


def running_sums(df: DataFrame, by: Sequence[str], index: str, sums: dict[str, str]) -> DataFrame:
    """Running totals through each row, by an integer index that grows by one.

    The index is cut into fixed chunks: a window inside each (group, chunk), plus the totals of the chunks before it.
    """
    by = list(by)
    cut = df.withColumn("__chunk", F.floor(F.col(index) / _RUN_CHUNK))
    inside = Window.partitionBy(*by, "__chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "__chunk").agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    offsets = totals.select(*by, "__chunk", *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}")
                                              for o in sums])
    out = cut.join(offsets, [*by, "__chunk"])
    return out.select(*df.columns, *[(F.col(f"__o_{o}") + F.sum(c).over(inside)).alias(o) for o, c in sums.items()])


def enclosing_points(values: DataFrame, points: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """For each (group, value): the greatest point at or below it and the least at or above it, null past the ends.

    An as-of join in both directions over distinct values. Points and values are cut into the same ranges; a window
    looks inside a range, and each range's extremes, carried over a few thousand rows per group, cover the others.
    """
    by = list(by)
    v = values.select(*by, value).distinct().withColumn("__point", F.lit(None).cast("double"))
    p = points.select(*by, value).distinct().withColumn("__point", F.col(value).cast("double"))
    both = v.withColumn("__is_value", F.lit(True)).unionByName(p.withColumn("__is_value", F.lit(False)))
    both = Ranges.of(both, value).assign(both, value, "__range")
    ends = both.groupBy(*by, "__range").agg(F.min("__point").alias("__lo"), F.max("__point").alias("__hi"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy("__range").rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(*by, "__range", F.max("__hi").over(earlier).alias("__prev"),
                          F.min("__lo").over(later).alias("__next"))
    down = Window.partitionBy(*by, "__range").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*by, "__range").orderBy(value).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return (both.join(carried, [*by, "__range"])
            .withColumn("point_below", F.coalesce(F.max("__point").over(down), F.col("__prev")))
            .withColumn("point_above", F.coalesce(F.min("__point").over(up), F.col("__next")))
            .filter("__is_value").select(*by, value, "point_below", "point_above"))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side only when its counted size is small; otherwise leave the join to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
