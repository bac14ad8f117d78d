"""From a population and its batch shards to the measurement table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .. import scratch
from ..constants import MAX_SHOTS, MIN_FAILURES, PROVENANCE_FIELDS, RUN_FIELDS, SCHEMA_VERSION, SHOT_BATCH
from ..errors import Refused
from ..functions import identity, rates
from ..operators import guards
from ..schemas import MEASUREMENTS


def population_table(params: DataFrame) -> DataFrame:
    """Identity and sizes per admissible item from ``construction_program_id, l, m, a_exps, b_exps, k, d_upper``."""
    n = F.lit(2) * F.col("l") * F.col("m")
    rows = params.withColumn("params_json", identity.canonical_params())
    return rows.withColumns({"code_id": identity.content_id("construction_program_id", "params_json"), "n": n,
                             "n_d_upper": n * F.col("d_upper")})


def check_shards(shards: DataFrame, *, batch_size: int, max_shots: int, min_failures: int) -> None:
    """Refuse broken sequences, mixed runs and mixed provenance."""
    problems = guards.shard_problems(shards, batch_size=batch_size, max_shots=max_shots, min_failures=min_failures)
    bad = problems.limit(3).collect()
    if bad:
        raise Refused(f"shards out of sequence: {[tuple(r) for r in bad]}")
    mixed = guards.first_mixed_field(shards, "item", [*RUN_FIELDS, *PROVENANCE_FIELDS]).limit(3).collect()
    if mixed:
        raise Refused(f"one item's batches come from one run and one provenance: {[tuple(r) for r in mixed]}")


def measurement_rows(population: DataFrame, shards: DataFrame, *, p: float, decoder_version: Column | str,
                     max_shots: int = MAX_SHOTS, min_failures: int = MIN_FAILURES, created_at: Column | str | None = None) -> DataFrame:
    """One row per finished item, in the measurement layout.

    ``shards`` have ``item`` (the code id), batch counts, running totals and provenance. One shuffle by item
    consolidates them; identity, seed, label and provenance checks are expressions on the joined row.
    """
    consolidated = shards.groupBy(F.col("item").alias("code_id")).agg(
        F.max("shots").alias("shots"), F.max("failures").alias("failures"),
        F.sum("batch_decode_seconds").alias("decode_seconds"), F.max("seed").alias("__seed"),
        *[F.max(f).alias(f) for f in PROVENANCE_FIELDS])
    # An item that failed every trial has no rate: it is a row error, and ``assemble`` then refuses it as unfinished.
    done = consolidated.filter(((F.col("failures") >= min_failures) | (F.col("shots") >= max_shots))
                               & (F.col("failures") < F.col("shots")))
    version = F.lit(decoder_version) if isinstance(decoder_version, str) else decoder_version
    created = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'") \
        if created_at is None else (F.lit(created_at) if isinstance(created_at, str) else created_at)
    rows = population.join(done, "code_id").withColumn("protocol_hash", identity.protocol_hash(F.lit(p), version))
    seed = identity.sampling_seed("code_id", "protocol_hash")
    ok_commit = F.when(identity.commit_ok("commit_sha"), F.col("commit_sha")).otherwise(
        F.raise_error(F.lit("a row needs a real commit id")))
    rows = rows.withColumns({
        "family": identity.family("construction_program_id"), "rounds": F.col("d_upper"), "commit_sha": ok_commit,
        "sampling_seed": F.when(F.col("__seed") == seed, seed).otherwise(F.raise_error(F.lit("shards of another seed")))})
    rows = rows.withColumns(rates.label_columns(min_failures=min_failures, max_shots=max_shots))
    return rows.withColumns({
        "seed": F.lit(0).cast("long"), "d_exact": F.lit(None).cast("int"), "phi_from_d_upper": rates.phi(),
        "n_ancilla": F.col("n"), "n_total": 2 * F.col("n"), "p": rates.stored_p(F.lit(p)),
        "schema_version": F.lit(SCHEMA_VERSION), "created_at": created}).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in MEASUREMENTS])


def assemble(population: DataFrame, shards: DataFrame, excluded: DataFrame | Mapping[str, str] | None = None, *, p: float,
             decoder_version: str, batch_size: int = SHOT_BATCH, max_shots: int = MAX_SHOTS,
             min_failures: int = MIN_FAILURES, created_at: str | None = None) -> DataFrame:
    """Checked measurement table of the population minus the excluded items; refuses before returning anything.

    ``excluded`` is a table (code_id, reason), however long, or a short mapping.
    """
    spark = population.sparkSession
    population = scratch.table(population, "population")
    shards = scratch.table(shards, "shards")
    check_shards(shards, batch_size=batch_size, max_shots=max_shots, min_failures=min_failures)
    if not isinstance(excluded, DataFrame):
        excluded = spark.createDataFrame(list((excluded or {}).items()), "code_id string, reason string")
    left_out = scratch.table(excluded.select("code_id", "reason"), "excluded")
    guards.enforce(guards.all_of(guards.unique_key(left_out, "code_id"), guards.counts(left_out, {"reason is null": guards.nulls("reason")})))
    rows = measurement_rows(population, shards, p=p, decoder_version=decoder_version, max_shots=max_shots,
                            min_failures=min_failures, created_at=created_at)
    rows = scratch.table(rows, "measurements")
    guards.enforce(guards.exclusion_problems(population.select("code_id"), rows.select("code_id"), left_out.select("code_id")))
    expected = population.count() - left_out.count()
    guards.enforce(guards.all_of(
        guards.counts(rows, {**guards.single_protocol(), "row count": guards.wrong_row_count(expected)}),
        guards.unique_key(rows, "code_id")))
    return rows
