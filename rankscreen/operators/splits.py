"""Group-safe folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import Refused
from . import guards, ranks


def _deal(histogram: list[tuple[int, int]], n_splits: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, from, to, folds in turn): how groups, largest first, go to the lightest fold, ties to the smaller fold.

    ``histogram`` is (size, groups of that size), largest first. Groups of one size are dealt in whole rounds while no
    idle fold becomes the lightest one, so the work depends on the number of sizes and folds, not on that of groups.
    """
    loads, plan = [0] * n_splits, []
    for size, groups in histogram:
        done = 0
        while done < groups:
            low = min(loads)
            turn = sorted((f for f in range(n_splits) if loads[f] < low + size), key=lambda f: (loads[f], f))
            idle = [loads[f] for f in range(n_splits) if loads[f] >= low + size]
            rounds = (groups - done) // len(turn)
            if idle:
                rounds = min(rounds, (min(idle) - loads[turn[-1]] - 1) // size)
            if rounds > 0:
                plan.append((size, done, done + rounds * len(turn), turn))
                done += rounds * len(turn)
                for f in turn:
                    loads[f] += rounds * size
            else:
                plan.append((size, done, done + 1, turn[:1]))
                done += 1
                loads[turn[0]] += size
    return plan


def assign_folds(df: DataFrame, n_splits: int | None = None, group: str = "construction_program_id") -> DataFrame:
    """(group, fold): every row of a group in one fold, folds of balanced size, deterministic.

    Groups go largest first to the lightest fold, ties by group key; without ``n_splits`` each group is its own fold.
    The driver sees the number of groups of each size: at most sqrt(2 N) rows for N rows in all.
    """
    guards.enforce(guards.counts(df, guards.group_key(df, group)))
    order = [F.col("n").desc(), F.col(group).asc()]
    sizes = ranks.row_index(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), order, out="pos")
    histogram = [(r["n"], r["groups"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("n")).collect()]
    n_groups = sum(groups for _, groups in histogram)
    n_splits = n_groups if n_splits is None else n_splits
    if n_splits < 2 or n_groups < n_splits:
        raise Refused(f"{n_groups} groups cannot make {n_splits} folds")
    if n_splits == n_groups:
        return sizes.select(group, F.col("pos").cast("int").alias("fold"))
    first, before = {}, 0
    for size, groups in histogram:
        first[size], before = before, before + groups
    rows = [(size, first[size] + lo, first[size] + hi, turn) for size, lo, hi, turn in _deal(histogram, n_splits)]
    plan = df.sparkSession.createDataFrame(rows, "n long, lo long, hi long, turn array<int>")
    dealt = sizes.join(plan, "n").filter((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
    return dealt.select(group, F.element_at("turn", (F.pmod(F.col("pos") - F.col("lo"), F.size("turn")) + 1).cast("int")).alias("fold"))


def with_folds(df: DataFrame, n_splits: int | None = None, group: str = "construction_program_id") -> DataFrame:
    folds = assign_folds(df, n_splits, group)
    return df.join(folds, group)


def leaking_groups(df: DataFrame, fold: str = "fold", group: str = "construction_program_id") -> DataFrame:
    """Groups found on both sides of any split; none may be."""
    return df.groupBy(group).agg(F.countDistinct(fold).alias("n_folds")).filter("n_folds > 1")
