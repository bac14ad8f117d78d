"""Refusals. A guard counts what breaks a rule, in as few passes as possible; ``enforce`` raises before results are used.

Guard tables have the columns (guard, violations) and one row per guard, so what reaches the driver is bounded by the
number of guards. Row-local rules are also available as expressions that raise inside the plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .. import scratch
from ..constants import PHI_SCORE, SHARED_COLUMNS
from ..errors import Refused


def counts(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One pass over ``df``: each check is an aggregate giving its number of violations."""
    row = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(f"__{i}") for i, c in enumerate(checks.values())])
    cells = F.array(*[F.struct(F.lit(name).alias("guard"), F.col(f"__{i}").alias("violations"))
                      for i, name in enumerate(checks)])
    return row.select(F.explode(cells).alias("c")).select("c.guard", "c.violations")


def enforce(table: DataFrame) -> None:
    """Raise ``Refused`` naming every broken guard."""
    broken = table.filter(F.col("violations") > 0).collect()
    if broken:
        raise Refused("; ".join(f"{r['guard']}: {r['violations']}" for r in broken))


def all_of(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


# Aggregates for ``counts``.

def nulls(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def more_than_one_value(column: str) -> Column:
    """1 when there are two values or more, or none at all; min against max needs no set of values."""
    lo, hi = F.min(column), F.max(column)
    return F.when(lo.isNull() | (lo != hi), F.lit(1)).otherwise(F.lit(0))


def other_than(column: str, expected) -> Column:
    return F.count_if(~F.col(column).eqNullSafe(F.lit(expected)))


def not_finite(column: str) -> Column:
    c = F.col(column).cast("double")
    return F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def wrong_row_count(expected: int) -> Column:
    return F.abs(F.count(F.lit(1)) - F.lit(expected))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def censoring_shape(censored="censored", rate="true_ler", bound="true_ler_ub") -> dict[str, Column]:
    """A censored row has no rate and a finite bound, an uncensored row a finite rate; the flag is never null."""
    flag, r, b = F.col(censored), F.col(rate).cast("double"), F.col(bound).cast("double")
    return {
        "censored flag is null": F.count_if(flag.isNull()),
        "censored row has a rate": F.count_if(flag & r.isNotNull()),
        "censored row has no finite bound": F.count_if(flag & ~_finite(b)),
        "uncensored row has no finite rate": F.count_if(~flag & ~_finite(r)),
    }


def single_protocol(column: str = "protocol_hash") -> dict[str, Column]:
    return {f"{column} is null": nulls(column), f"{column} has not exactly one value": more_than_one_value(column)}


def bound_provenance(exact: str = "d_exact", upper: str = "d_upper") -> dict[str, Column]:
    e, u = F.col(exact), F.col(upper)
    return {"no bound at all": F.count_if(e.isNull() & u.isNull()), "exact above its upper bound": F.count_if(e > u)}


def group_key(df: DataFrame, column: str) -> dict[str, Column]:
    """A split needs its group column on every row; splitting by row is never a fallback."""
    if column not in df.columns:
        raise Refused(f"no {column!r} column to group on; the table has {df.columns}")
    return {f"{column} is null": nulls(column)}


# Guards that need their own shuffle.

def repeated_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their counts; map-side counts keep a hot key cheap."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def unique_key(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return counts(repeated_keys(df, key), {f"{key} is repeated": F.count(F.lit(1))})


def key_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key with the sides it is on: 1 left only, 2 right only, 3 both. One shuffle, combined before it."""
    sides = left.select(F.col(key), F.lit(1).alias("__s")).unionByName(right.select(F.col(key), F.lit(2).alias("__s")))
    return sides.groupBy(key).agg(F.bit_or("__s").alias("side"))


def equal_keys(left: DataFrame, right: DataFrame, key: str, names=("left", "right")) -> DataFrame:
    return counts(key_sides(left, right, key), {
        f"{key} only in {names[0]}": F.count_if(F.col("side") == 1),
        f"{key} only in {names[1]}": F.count_if(F.col("side") == 2)})


def require_equal_keys(left: DataFrame, right: DataFrame, key: str, names=("left", "right")) -> None:
    """As ``equal_keys``, raising with three examples of each side's strays."""
    sides = key_sides(left, right, key)
    strays = {s: sides.filter(F.col("side") == s) for s in (1, 2)}
    found = {s: [r[0] for r in d.select(key).orderBy(key).limit(3).collect()] for s, d in strays.items()}
    if found[1] or found[2]:
        n = {s: d.count() for s, d in strays.items()}
        raise Refused(f"{key} sets differ: {n[1]} only in {names[0]} (e.g. {found[1]}), "
                      f"{n[2]} only in {names[1]} (e.g. {found[2]})")


def shared_columns(left: DataFrame, right: DataFrame, key: str, equal: Sequence[str] = SHARED_COLUMNS,
                   close: Sequence[str] = (PHI_SCORE,), rtol: float = 1e-12) -> DataFrame:
    """Rows whose shared columns disagree between two tables: integers exactly, doubles within ``rtol``."""
    l = left.select(key, *[F.col(c).alias(f"__l_{c}") for c in (*equal, *close)])
    r = right.select(key, *[F.col(c).alias(f"__r_{c}") for c in (*equal, *close)])
    checks = {f"{c} differs": F.count_if(~F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}"))) for c in equal}
    for c in close:
        a, b = F.col(f"__l_{c}"), F.col(f"__r_{c}")
        near = F.abs(a - b) <= F.lit(rtol) * F.abs(b)
        checks[f"{c} differs"] = F.count_if(~F.coalesce(near, a.isNull() & b.isNull()))
    return counts(l.join(scratch.shuffled(r), key), checks)


def declared_values(stored: DataFrame, derived: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Stored attributes against recomputed ones."""
    return shared_columns(stored, derived, key, columns, close=())


def exclusion_problems(population: DataFrame, finished: DataFrame, excluded: DataFrame, key: str = "code_id") -> DataFrame:
    """Reasons not to assemble: a listed item outside the population or with a result, an unlisted item unfinished."""
    bits = [population.select(key, F.lit(1).alias("__s")), finished.select(key, F.lit(2).alias("__s")),
            excluded.select(key, F.lit(4).alias("__s"))]
    sides = reduce(DataFrame.unionByName, bits).groupBy(key).agg(F.bit_or("__s").alias("s"))

    def has(bit):
        return F.col("s").bitwiseAND(F.lit(bit)) > 0

    return counts(sides, {
        "excluded item is not in the population": F.count_if(has(4) & ~has(1)),
        "excluded item has a result": F.count_if(has(4) & has(2)),
        "item is unfinished": F.count_if(has(1) & ~has(2) & ~has(4))})


def settings_differences(recorded: DataFrame, current: DataFrame, keys: Sequence[str], by: Sequence[str] = (),
                         ignore: Sequence[str] = ()) -> DataFrame:
    """Settings that differ between two tables of one row (per group): (group, key, recorded, current)."""
    keys = [k for k in keys if k not in ignore]

    def long(df, name):
        cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias(name)) for k in keys])
        return df.select(*by, F.explode(cells).alias("c")).select(*by, "c.key", f"c.{name}")

    joined = long(recorded, "recorded").join(long(current, "current"), [*by, "key"], "full")
    return joined.filter(~F.col("recorded").eqNullSafe(F.col("current")))


# Shards.

def shard_problems(shards: DataFrame, item: str = "item", *, batch_size: int, max_shots: int,
                   min_failures: int) -> DataFrame:
    """Every shard that breaks its item's sequence, with the first reason.

    Expects ``batch_index, batch_shots, batch_failures, shots, failures`` (the last two are the stored running totals).
    """
    from . import ranks
    totals = ranks.running_sums(shards, [item], "batch_index", {"__shots": "batch_shots", "__fails": "batch_failures"})
    n = shards.groupBy(item).agg(F.count(F.lit(1)).alias("__n"), F.countDistinct("batch_index").alias("__distinct"),
                                 F.min("batch_index").alias("__first"), F.max("batch_index").alias("__last"))
    gap = (F.col("__first") != 0) | (F.col("__last") != F.col("__n") - 1) | (F.col("__distinct") != F.col("__n"))
    prior_shots, prior_fails = F.col("__shots") - F.col("batch_shots"), F.col("__fails") - F.col("batch_failures")
    problem = (F.when(gap, "index gap or repeat")
               .when((prior_shots >= max_shots) | (prior_fails >= min_failures), "past the stopping point")
               .when(F.col("batch_shots") != batch_size, "batch size")
               .when((F.col("shots") != F.col("__shots")) | (F.col("failures") != F.col("__fails")), "running totals"))
    return totals.join(n, item).withColumn("problem", problem).filter("problem is not null").select(
        item, "batch_index", "problem")


def first_mixed_field(df: DataFrame, item: str, fields: Sequence[str]) -> DataFrame:
    """Items whose rows disagree on a field, and the first such field; a null beside a value is a disagreement."""
    aggs, mixed = [], []
    for i, f in enumerate(fields):
        aggs += [F.min(f).alias(f"__lo{i}"), F.max(f).alias(f"__hi{i}"), F.count(f).alias(f"__c{i}")]
        some_null = (F.col(f"__c{i}") > 0) & (F.col(f"__c{i}") < F.col("__n"))
        mixed.append(F.when((F.col(f"__lo{i}") != F.col(f"__hi{i}")) | some_null, F.lit(f)))
    return (df.groupBy(item).agg(F.count(F.lit(1)).alias("__n"), *aggs)
            .withColumn("field", F.coalesce(*mixed)).filter("field is not null").select(item, "field"))


def result_problems(results: DataFrame, consolidated: DataFrame, item: str = "item", *, max_shots: int,
                    min_failures: int) -> DataFrame:
    """Results that do not follow from their shards, with the reason."""
    last = consolidated.select(item, F.col("shots").alias("__shots"), F.col("failures").alias("__fails"))
    implied = F.when(F.col("failures") >= min_failures, "min_failures").otherwise("max_shots")
    problem = (F.when(F.col("__shots").isNull(), "no shards")
               .when((F.col("shots") != F.col("__shots")) | (F.col("failures") != F.col("__fails")), "totals")
               .when((F.col("stopped_by") != implied)
                     | ((implied == "max_shots") & (F.col("shots") != max_shots)), "stop reason"))
    return results.join(last, item, "left").withColumn("problem", problem).filter("problem is not null").select(
        item, "problem")


# Schemas.

def exact_columns(df: DataFrame, schema: T.StructType) -> None:
    """Refuse any other column list, order or type; nullability is not part of the contract of a Parquet scan."""
    got, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    if got != want:
        raise Refused(f"columns are {[n for n, _ in got]}, expected {[n for n, _ in want]} with their types")


def column_policy(df: DataFrame, forbidden_prefix: str) -> None:
    bad = [c for c in df.columns if c.startswith(forbidden_prefix)]
    if bad:
        raise Refused(f"columns {bad} may not be in this table")


def incidence(df: DataFrame, value: str, item: str = "item", side: str = "side", qubit: str = "qub") -> DataFrame:
    """A 0/1 incidence input: integer typed, only 0 and 1, and as many qubits on one side as on the other.

    ``df`` holds one row per cell (zeros included), so the widths are counted from what is stored.
    """
    kind = df.schema[value].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise Refused(f"{value} is {kind.simpleString()}, not an integer type")
    cells = counts(df, {"value is not 0 or 1": F.count_if(~F.coalesce(F.col(value).isin(0, 1), F.lit(False)))})
    widths = df.groupBy(item, side).agg((F.max(qubit) + 1).alias("w")).groupBy(item).agg(
        F.min("w").alias("lo"), F.max("w").alias("hi"))
    return cells.unionByName(counts(widths, {"sides differ in width": F.count_if(F.col("lo") != F.col("hi"))}))
