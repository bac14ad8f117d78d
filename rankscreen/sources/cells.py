"""Nested calibration documents and session summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import Refused
from ..schemas import CELL_DDL, SESSION_DDL


def read_cells(spark: SparkSession, path: str, *, multi_line: bool = True, glob: str = "*.json") -> DataFrame:
    return (spark.read.schema(CELL_DDL).option("multiLine", multi_line).option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True).json(path))


def foreign_cells(cells: DataFrame, plan: DataFrame, decoders: Sequence[str]) -> DataFrame:
    """Cells that do not belong to the run: unmarked, off the planned (p, item) grid, or with other decoders."""
    want = F.array_sort(F.array(*[F.lit(d) for d in decoders]))
    shaped = ~F.coalesce(F.col("calibration"), F.lit(False)) | (
        (F.col("status") == "completed") & ~F.array_sort(F.map_keys("decoders")).eqNullSafe(want))
    keyed = cells.withColumn("code_id", F.col("code.code_id"))
    off_grid = keyed.join(plan.select("p", "code_id").distinct().withColumn("__planned", F.lit(True)), ["p", "code_id"], "left")
    return off_grid.filter(shaped | F.col("__planned").isNull()).select("p", "code_id")


def require_own_cells(cells: DataFrame, plan: DataFrame, decoders: Sequence[str]) -> None:
    bad = foreign_cells(cells, plan, decoders).limit(3).collect()
    if bad:
        raise Refused(f"cells that do not belong to this run: {[tuple(r) for r in bad]}")


def flatten(cells: DataFrame) -> DataFrame:
    """Completed cells as rows per (p, item, decoder). A decoder's own count stands before that of the document."""
    done = cells.filter("status = 'completed'")
    return (done.select("p", "code", "rounds", "shots", "stopped_by", F.explode("decoders").alias("decoder", "d"))
            .select("p", "decoder", "code.code_id", "code.name", "code.construction_program_id", "code.n", "code.k",
                    "code.d_upper", "rounds", F.coalesce("d.shots", "shots").alias("shots"),
                    F.coalesce("d.stopped_by", "stopped_by").alias("stopped_by"), "d.failures", "d.censored", "d.ler", "d.ler_ci_low",
                    "d.ler_ci_high", "d.decode_seconds", "d.ms_per_shot", "d.bp_converged", "d.bp_convergence_fraction"))


PAIR_COUNTS = ("both_fail", "only_a", "only_b", "neither", "p_value")


def flatten_pairs(cells: DataFrame) -> DataFrame:
    """Completed cells as rows per (p, item, pairing): the 2x2 table of two decoders on the same trials, and its p-value."""
    done = cells.filter("status = 'completed'").select("p", F.col("code.code_id").alias("code_id"), F.explode("paired").alias("pairing", "t"))
    return done.select("p", "code_id", "pairing", *[F.col("t")[c].cast("double" if c == "p_value" else "long").alias(c) for c in PAIR_COUNTS])


def unfinished(cells: DataFrame) -> DataFrame:
    return cells.filter("status != 'completed'").select("p", "status", "code.code_id", "code.name")


def nest(tally: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Flat (p, item, decoder) rows back to one document per (p, item); a run has a short, fixed list of decoders.

    Counts and stop reasons stay with each decoder; the document names them only where all of its decoders agree.
    ``pairs`` has the rows of ``flatten_pairs``.
    """
    fields = ["shots", "stopped_by", "failures", "censored", "ler", "ler_ci_low", "ler_ci_high", "decode_seconds", "ms_per_shot",
              "bp_converged", "bp_convergence_fraction"]
    entry: Column = F.struct(F.col("decoder"), F.struct(*fields).alias("d"))
    code = F.struct("code_id", F.col("code_id").alias("name"), "construction_program_id", "n", "k", "d_upper")
    docs = tally.groupBy("p", "code_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("decoders"), F.first(code).alias("code"),
        F.max("rounds").alias("rounds"), *[F.when(F.min(c) == F.max(c), F.max(c)).alias(c) for c in ("shots", "stopped_by")])
    kind = "map<string,map<string,double>>"
    if pairs is None:
        docs = docs.withColumn("paired", F.create_map().cast(kind))
    else:
        table = F.create_map(*[x for c in PAIR_COUNTS for x in (F.lit(c), F.col(c).cast("double"))])
        per = pairs.groupBy("p", "code_id").agg(F.map_from_entries(F.collect_list(F.struct("pairing", table.alias("t")))).alias("paired"))
        docs = docs.join(per, ["p", "code_id"], "left").withColumn("paired", F.coalesce("paired", F.create_map().cast(kind)))
    return docs.select(F.lit(True).alias("calibration"), F.lit("completed").alias("status"), "p", "code", "rounds", "shots",
                       "stopped_by", "decoders", "paired")


def read_sessions(spark: SparkSession, directory: str, *, multi_line: bool = True, glob: str = "session_*.json") -> DataFrame:
    """Session summaries in order."""
    return (spark.read.schema(SESSION_DDL).option("multiLine", multi_line).option("pathGlobFilter", glob)
            .json(directory).orderBy("session"))
