"""Merging flip mechanisms that have the same symptom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import ranks


def odd_targets(targets: Column) -> Column:
    """The targets that occur an odd number of times, sorted: what a flip shows."""
    once = F.array_sort(F.array_distinct(targets))
    return F.filter(once, lambda x: F.size(F.filter(targets, lambda y: y == x)) % 2 == 1)


def symptoms(long: DataFrame, idx: str = "idx", target: str = "target") -> DataFrame:
    """Mechanisms given one row per (mechanism, target): parity is counted before any list is built."""
    odd = long.groupBy(idx, target).agg((F.count(F.lit(1)) % 2).alias("__odd"))
    return odd.groupBy(idx).agg(F.array_sort(F.collect_set(F.when(F.col("__odd") == 1, F.col(target)))).alias("symptom"))


def merge(mechanisms: DataFrame, idx: str = "idx", p: str = "p") -> DataFrame:
    """One row per symptom: the chance that an odd number of its independent flips happen, in order of appearance.

    Combining two flips as p(1-q) + q(1-p) multiplies the factors 1 - 2p, so the whole fold is one product.
    """
    merged = mechanisms.groupBy("symptom").agg(
        ((F.lit(1.0) - F.product(F.lit(1.0) - 2 * F.col(p))) / 2).alias("p"),
        F.min(idx).alias("first_idx"), F.count(F.lit(1)).alias("n_merged"))
    return ranks.row_index(merged, [F.col("first_idx").asc()], out="column")
