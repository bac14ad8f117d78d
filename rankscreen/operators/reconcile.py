"""Joins and set operations between the measurement, feature and prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import scratch
from ..constants import PHI_SCORE, SHARED_COLUMNS
from . import guards


#: Hex digits of a row hash that name its group at the bottom of a table digest.
DIGEST_PREFIX = 5


def join_one_to_one(left: DataFrame, right: DataFrame, key: str = "code_id",
                    shared: Sequence[str] = SHARED_COLUMNS, close: Sequence[str] = (PHI_SCORE,), *,
                    check: bool = True, names=("left", "right")) -> DataFrame:
    """Left's columns and right's, one row per key; the shared columns are kept once, from the right.

    With ``check`` it refuses repeated keys, unequal key sets and disagreeing shared columns before joining.
    """
    if check:
        guards.enforce(guards.all_of(guards.unique_key(left, key), guards.unique_key(right, key)))
        guards.require_equal_keys(left, right, key, names)
        if shared or close:
            guards.enforce(guards.shared_columns(left, right, key, shared, close))
    return left.drop(*shared, *close).join(scratch.shuffled(right), key)


def remaining(plan: DataFrame, *done: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Planned work that no done, result or failed list holds."""
    for d in done:
        plan = plan.join(d, on, "left_anti")
    return plan


def grid(items: DataFrame, **settings: Sequence) -> DataFrame:
    """Every item under every combination of a few setting values: rates, caps, budgets.

    The settings are configuration lists, so each is exploded in place and no table is crossed with another.
    """
    for name, values in settings.items():
        items = items.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return items


def lookup_or(left: DataFrame, measured: DataFrame, on: str, value: str, fallback: Column, out: str) -> DataFrame:
    """The measured value where there is one, else the fallback expression over the left columns."""
    found = measured.select(on, F.col(value).alias("__found"))
    return left.join(found, on, "left").withColumn(out, F.coalesce("__found", fallback)).drop("__found")


def union_sources(sources: Mapping[str, DataFrame], key: str | None = None, *, check: bool = True) -> DataFrame:
    """Rows of several origins with the origin's name; with a key, an item in two origins is refused."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("origin", F.lit(name))
        out = df if out is None else out.unionByName(df)
    if key is not None and check:
        guards.enforce(guards.unique_key(out, key))
    return out


def difference(a: DataFrame, b: DataFrame, names=("only_left", "only_right")) -> DataFrame:
    """Symmetric difference of two sets of rows, with the side each row is on."""
    columns = a.columns
    sides = a.select(*columns, F.lit(1).alias("__s")).unionByName(b.select(*columns, F.lit(2).alias("__s")))
    side = sides.groupBy(*columns).agg(F.bit_or("__s").alias("__s")).filter(F.col("__s") != 3)
    return side.withColumn("side", F.when(F.col("__s") == 1, names[0]).otherwise(names[1])).drop("__s")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def table_digest(df: DataFrame, columns: Sequence[str], prefix: int = DIGEST_PREFIX) -> DataFrame:
    """Order-free sha256 of a table's content as a tree over row hashes, without sorting the table in one place.

    Rows hash to 64 hex digits; equal rows collapse to one leaf with a count. Leaves meet by their first ``prefix``
    digits, and each level above joins the 16 groups that share one digit fewer, so no group outgrows its branch.
    ``prefix`` is part of the digest's definition and the same for every table: a million groups by default.
    """
    from ..functions.identity import row_digest
    leaves = df.select(row_digest(*columns).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    level = leaves.select(F.substring("h", 1, prefix).alias("g"), F.concat("h", F.lit(":"), "n").alias("d"))
    for digits in range(prefix, -1, -1):
        joined = F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("d"))), 256)
        level = level.groupBy(F.substring("g", 1, digits).alias("g")).agg(joined.alias("d"))
        if digits:
            level = level.select("g", F.concat("g", F.lit(":"), "d").alias("d"))
    return level.select(F.col("d").alias("digest"))
