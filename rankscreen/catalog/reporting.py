"""Queries: sources and sinks, assembly, evaluation reports, calibration summaries, folds and models, streams."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .. import scratch
from ..functions import identity, rates
from ..operators import model, ranks, splits, trials
from ..plans import assembly, calibration, evaluation, views
from ..schemas import METRICS
from ..sources import cells as cell_source
from ..sources import inventory, shards, tables
from ..streaming import shards as stream
from . import projecting
from .core import query, rounded
from .measuring import _B as _BATCHES, _CAP as _SHOT_CAP, _MIN as _SHOT_MIN
from .resampling import _B as _REPS, _REPLICATES, _SEED

_M = views.measurements_sql()

LINEITEM = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()), T.StructField("l_suppkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_quantity", T.DoubleType()),
    T.StructField("l_extendedprice", T.DoubleType()), T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType()), T.StructField("l_linestatus", T.StringType())])


@query("fixed_schema_scan", "S1", """
SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1""")
def fixed_schema_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/lineitem.parquet"
    schema = T.StructType([*LINEITEM.fields, spark.read.parquet(path).schema["l_shipdate"]])
    return (tables.read_table(spark, path, schema).filter("l_discount >= 0.05").groupBy("l_linestatus")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))


@query("single_column_total", "S2", "SELECT sum(l_quantity) AS l_quantity FROM lineitem")
def single_column_total(spark: SparkSession, sf: str) -> DataFrame:
    return tables.column_total(spark, f"{sf}/lineitem.parquet", "l_quantity")


@query("compact_shard_table", "S3 S6 R1", f"""WITH {_BATCHES}
SELECT item, count(*) AS n_batches, CAST(sum(batch_shots) AS BIGINT) AS shots, round(sum(batch_decode_seconds), 6) AS seconds FROM batches GROUP BY item""")
def compact_shard_table(spark: SparkSession, sf: str) -> DataFrame:
    b = views.batches(spark, sf)
    path = scratch.new_path(spark, "compact")
    shards.compact(b, path, 16)
    back = shards.read_compact(spark, path, b.schema)
    out = back.groupBy("item").agg(F.count(F.lit(1)).alias("n_batches"), F.sum("batch_shots").alias("shots"),
                                   F.sum("batch_decode_seconds").alias("seconds"))
    return rounded(out, "seconds", digits=6)


@query("table_inventory", "S9")
def table_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.inventory(spark, sf, "*.parquet")


@query("marked_rows", "S10", """
SELECT conv_id, turn FROM conversations WHERE role = 'user'""")
def marked_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = views.read(spark, sf, "conversations").withColumn("calibration", F.col("role") == "user")
    return tables.marked_rows(c).select("conv_id", "turn")


@query("exclusion_metadata", "S6 S7 F9", f"""WITH {_M}
SELECT code_id, round(rank_value, 9) AS rank_value, 'p_size 50' AS reason FROM meas WHERE p_size = 50""")
def exclusion_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left out of a written table, read back from the excluded side table."""
    m = views.measurements(spark, sf).select("code_id", "p_size", "rank_value")
    path = scratch.new_path(spark, "kept")
    kept = tables.with_exclusions(m.filter("p_size != 50"), "code_id", {"p_size": "50"})
    kept.write.parquet(path)
    rule = tables.exclusions(spark.read.parquet(path), "code_id")
    left_out = m.join(spark.read.parquet(path).select("code_id"), "code_id", "left_anti")
    reason = F.concat_ws(" ", *[F.lit(x) for pair in rule.items() for x in pair])
    return rounded(left_out.select("code_id", "rank_value", reason.alias("reason")), "rank_value")


@query("evaluation_metrics", "M9 M1 M2 M3 M4 M5", f"""WITH {_REPLICATES},
sub AS (SELECT 'all' AS subset, * FROM meas UNION ALL SELECT 'excluded', * FROM meas WHERE NOT censored),
long AS (SELECT subset, 'model' AS scorer, -price_score AS s, rank_value AS t FROM sub UNION ALL SELECT subset, 'baseline', -phi_from_d_upper, rank_value FROM sub),
st AS (SELECT subset, scorer, rank() OVER (PARTITION BY subset, scorer ORDER BY t) - 1 AS tb, count(*) OVER (PARTITION BY subset, scorer, t) AS tt,
              rank() OVER (PARTITION BY subset, scorer ORDER BY s) - 1 AS sb, count(*) OVER (PARTITION BY subset, scorer, s) AS ss FROM long),
val AS (SELECT subset, scorer, 'spearman' AS metric, corr(tb + (tt + 1) / 2.0, sb + (ss + 1) / 2.0) AS v, count(*) AS n FROM st GROUP BY 1, 2
        UNION ALL SELECT subset, scorer, 'recall_at_30_of_top_10', sum(least(1.0, greatest(0.0, (10 - tb)::DOUBLE / tt)) * least(1.0, greatest(0.0, (30 - sb)::DOUBLE / ss))) / 10, count(*) FROM st GROUP BY 1, 2),
pt AS (SELECT metric, scorer, max(v) FILTER (subset = 'all') AS estimate, max(n) FILTER (subset = 'all') - max(n) FILTER (subset = 'excluded') AS n_censored,
              max(v) FILTER (subset = 'excluded') AS excl_censored FROM val GROUP BY 1, 2),
l AS (SELECT metric, 'model' AS scorer, a AS v FROM reps UNION ALL SELECT metric, 'baseline', b FROM reps UNION ALL SELECT metric, 'difference', a - b FROM reps),
iv AS (SELECT metric, scorer, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM l GROUP BY 1, 2),
al AS (SELECT * FROM pt UNION ALL SELECT metric, 'difference', max(estimate) FILTER (scorer = 'model') - max(estimate) FILTER (scorer = 'baseline'), NULL, NULL FROM pt GROUP BY metric)
SELECT al.metric, al.scorer, round(estimate, 9) AS estimate, round(low, 9) AS low, round(high, 9) AS high, CAST(n_censored AS BIGINT) AS n_censored, round(excl_censored, 9) AS excl_censored
FROM al JOIN iv ON iv.metric = al.metric AND iv.scorer = al.scorer""")
def evaluation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    table = evaluation.metric_table(views.measurements(spark, sf), "price_score", "phi_from_d_upper", n_resamples=_REPS, seed=_SEED)
    return rounded(table, "estimate", "low", "high", "excl_censored")


@query("evaluation_text_report", "S8 M9 M6")
def evaluation_text_report(spark: SparkSession, sf: str) -> DataFrame:
    m = scratch.table(views.measurements(spark, sf), "labelled")
    table = evaluation.metric_table(m, "price_score", "phi_from_d_upper", n_resamples=_REPS, seed=_SEED)
    path = scratch.new_path(spark, "report")
    tables.write_text(evaluation.report_lines(evaluation.with_noise_ceiling(table, m)), path)
    return spark.read.text(path)


def _evaluation(spark, sf):
    m = views.measurements(spark, sf)
    features = m.select("code_id", "n", "k", "d_upper", "phi_from_d_upper", "p_retailprice",
                        F.when(F.col("p_size") > 5, F.col("p_size")).alias("girth_x"))
    return evaluation.evaluate(m, features, expected_rows=m.count(), predictions_path=scratch.new_path(spark, "predictions"),
                               feature_columns=["n", "k", "d_upper", "phi_from_d_upper", "p_retailprice", "girth_x"])


@query("evaluation_document", "M9 M1 M2 M3 M4 M5 M6 L1 L2 L3 S6 S8 J1 F1 F2 F5 F7 F22")
def evaluation_document(spark: SparkSession, sf: str) -> DataFrame:
    """The whole evaluation, guards on: join, out-of-fold model, intervals, ceiling, and the document as read back."""
    path = scratch.new_path(spark, "evaluation")
    evaluation.write_report(_evaluation(spark, sf), path)
    return spark.read.schema(METRICS).json(f"{path}/metrics")


@query("program_report_lines", "S8 A1", f"""WITH {_M}
SELECT rpad(construction_program_id, 12, ' ') || printf('%6d items %5d censored %8.4f rate', count(*), count(*) FILTER (censored), avg(censored::INT::DOUBLE)) AS line
FROM meas GROUP BY construction_program_id""")
def program_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    per = evaluation.program_counts(views.measurements(spark, sf))
    text = F.format_string("%6d items %5d censored %8.4f rate", "n_items", "n_censored", "censoring_rate")
    return per.select(F.concat(F.rpad("construction_program_id", 12, " "), text).alias("line"))


@query("program_counts", "A1", f"""WITH {_M}
SELECT construction_program_id, count(*) AS n_items, count(*) FILTER (censored) AS n_censored, round(avg(censored::INT::DOUBLE), 9) AS censoring_rate,
       count(DISTINCT family) AS n_families FROM meas GROUP BY 1""")
def program_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.program_counts(views.measurements(spark, sf)), "censoring_rate")


# Assembly: line items of a part are its trials, five to a batch.

_P_RATE, _VERSION, _CREATED, _ASM_MIN, _ASM_CAP = 0.002, "2.0.0", "2026-01-01T00:00:00+00:00", 6, 20


def _assembly_population(spark, sf):
    pop = views.population(spark, sf).withColumn("construction_program_id", F.concat(F.lit("bb_v1_p"), "p_partkey"))
    return assembly.population_table(pop.select("p_partkey", "construction_program_id", "l", "m", "a_exps", "b_exps", "k", "d_upper"))


def _assembly_shards(spark, sf, population):
    li = views.read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity")
    t = ranks.row_index(li, [F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")], ["l_partkey"], "trial")
    b = (t.withColumn("batch_index", F.floor(F.col("trial") / 5).cast("long")).groupBy("l_partkey", "batch_index")
         .agg(F.count(F.lit(1)).alias("batch_shots"), F.count_if(F.col("l_returnflag") == "R").alias("batch_failures"),
              F.sum("l_quantity").alias("batch_decode_seconds")))
    ids = population.select("p_partkey", F.col("code_id").alias("item"))
    b = b.join(ids, b["l_partkey"] == ids["p_partkey"]).drop("p_partkey", "l_partkey")
    kept = trials.stop_batches(b, min_failures=_ASM_MIN, max_shots=_ASM_CAP)
    protocol = identity.protocol_hash(F.lit(_P_RATE), F.lit(_VERSION))
    return kept.withColumns({"seed": identity.sampling_seed("item", protocol), "batch_size": F.lit(5), "max_shots": F.lit(_ASM_CAP),
                             "commit_sha": F.sha1(F.lit("a")), "stim_version": F.lit("1.0"), "cpu_class": F.lit("x")})


_HASH_LIT = ("sha256('{\"decoder_params\":{\"bp_method\":\"minimum_sum\",\"decoder\":\"BpOsdDecoder\","
             "\"dem_to_matrix\":\"dem_undecomposed_merge_by_symptom_v1\",\"library\":\"ldpc\",\"max_iter\":30,"
             "\"ms_scaling_factor\":0.625,\"osd_method\":\"osd_cs\",\"osd_order\":10,\"schedule\":\"parallel\"},"
             "\"decoder_version\":\"2.0.0\",\"memory_basis\":\"Z\",\"noise_model\":\"uniform_depolarizing_v1\",\"p\":0.002,"
             "\"rounds_rule\":\"r = d_upper\",\"scheduling\":\"bb_monomial_matching_xz_phased_v2\",\"schema_version\":1}')")


def _assembly_sql():
    from .measuring import _rate, wilson_sql
    lo, hi = wilson_sql()
    return f"""{views.POPULATION_SQL},
tr AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS trial FROM lineitem),
ba AS (SELECT l_partkey, trial // 5 AS bi, count(*) AS bs, count(*) FILTER (l_returnflag = 'R') AS bf, sum(l_quantity) AS sec FROM tr GROUP BY 1, 2),
rn AS (SELECT *, sum(bs) OVER w AS cs, sum(bf) OVER w AS cf FROM ba WINDOW w AS (PARTITION BY l_partkey ORDER BY bi)),
kp AS (SELECT * FROM rn WHERE cs - bs < {_ASM_CAP} AND cf - bf < {_ASM_MIN}),
co AS (SELECT l_partkey, CAST(max(cs) AS BIGINT) AS shots, CAST(max(cf) AS BIGINT) AS failures, sum(sec) AS decode_seconds FROM kp GROUP BY 1 HAVING max(cf) >= {_ASM_MIN} OR max(cs) >= {_ASM_CAP}),
jo AS (SELECT pop.* EXCLUDE (rounds), d_upper AS rounds, shots, failures, decode_seconds, 'bb_v1_p' || p_partkey AS prog, {_HASH_LIT} AS ph FROM pop JOIN co ON p_partkey = l_partkey),
id AS (SELECT *, prog || '-' || substr(sha256(params_json), 1, 12) AS code_id, {lo} AS w_lo, {hi} AS w_hi FROM jo)
SELECT code_id, prog AS construction_program_id, 'BB' AS family, params_json, n, k, d_upper, round(k * d_upper * d_upper / n::DOUBLE, 9) AS phi_from_d_upper,
       n AS n_ancilla, 2 * n AS n_total, ph AS protocol_hash,
       CAST(('0x' || substr(sha256(code_id || '|' || ph), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT) AS sampling_seed,
       0.002::DOUBLE AS p, rounds, shots, failures, round(CASE WHEN failures >= {_ASM_MIN} THEN {_rate('(failures/shots::DOUBLE)')} END, 9) AS true_ler,
       round({_rate('w_hi')}, 9) AS true_ler_ub, round({_rate('w_lo')}, 9) AS true_ler_ci_low, failures < {_ASM_MIN} AS censored, decode_seconds, '{_CREATED}' AS created_at
FROM id WHERE failures < shots"""


@query("assembled_measurements", "A4 A3 P4 P7 P9 P10 P12 P21", f"WITH {_assembly_sql()}")
def assembled_measurements(spark: SparkSession, sf: str) -> DataFrame:
    population = scratch.table(_assembly_population(spark, sf), "population")
    rows = assembly.measurement_rows(population, _assembly_shards(spark, sf, population), p=_P_RATE, decoder_version=_VERSION,
                                     max_shots=_ASM_CAP, min_failures=_ASM_MIN, created_at=_CREATED)
    rows = rows.drop("seed", "d_exact", "commit_sha", "stim_version", "cpu_class", "true_ler_ci_high", "schema_version")
    return rounded(rows, "phi_from_d_upper", "true_ler", "true_ler_ub", "true_ler_ci_low")


@query("guarded_assembly", "A4 F9 F12 F13 F14 F15 F16 S7", f"""WITH {views.POPULATION_SQL},
tr AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS trial FROM lineitem),
ba AS (SELECT l_partkey, trial // 5 AS bi, count(*) AS bs, count(*) FILTER (l_returnflag = 'R') AS bf FROM tr GROUP BY 1, 2),
rn AS (SELECT *, sum(bs) OVER w AS cs, sum(bf) OVER w AS cf FROM ba WINDOW w AS (PARTITION BY l_partkey ORDER BY bi)),
co AS (SELECT l_partkey, max(cs) AS shots, max(cf) AS failures, min(bs) AS least FROM rn WHERE cs - bs < {_ASM_CAP} AND cf - bf < {_ASM_MIN} GROUP BY 1),
re AS (SELECT 'bb_v1_p' || p_partkey || '-' || substr(sha256(params_json), 1, 12) AS code_id, shots, failures,
              CASE WHEN shots IS NULL THEN 'no trials' WHEN least < 5 THEN 'a short batch' WHEN shots < {_ASM_CAP} AND failures < {_ASM_MIN} THEN 'unfinished'
                   WHEN failures = shots THEN 'every trial failed' END AS reason FROM pop LEFT JOIN co ON l_partkey = p_partkey)
SELECT code_id, reason, CAST(CASE WHEN reason IS NULL THEN shots END AS BIGINT) AS shots, CAST(CASE WHEN reason IS NULL THEN failures END AS BIGINT) AS failures FROM re""")
def guarded_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Every item of the population: its assembled counts after all guards, or why the side table of exclusions lists it."""
    population = scratch.table(_assembly_population(spark, sf), "population")
    batches = scratch.table(_assembly_shards(spark, sf, population), "assembly-shards")
    per = batches.groupBy(F.col("item").alias("code_id")).agg(
        F.max("shots").alias("shots"), F.max("failures").alias("failures"), F.min("batch_shots").alias("least"))
    reason = (F.when(F.col("shots").isNull(), "no trials").when(F.col("least") < 5, "a short batch")
              .when((F.col("shots") < _ASM_CAP) & (F.col("failures") < _ASM_MIN), "unfinished")
              .when(F.col("failures") == F.col("shots"), "every trial failed"))
    judged = population.select("code_id").join(per, "code_id", "left").select("code_id", reason.alias("reason"))
    path = scratch.new_path(spark, "exclusions")
    judged.filter("reason IS NOT NULL").write.parquet(path)
    excluded = spark.read.parquet(path)
    own = batches.join(excluded.select(F.col("code_id").alias("item")), "item", "left_anti")
    rows = assembly.assemble(population, own, excluded, p=_P_RATE, decoder_version=_VERSION, batch_size=5, max_shots=_ASM_CAP,
                             min_failures=_ASM_MIN, created_at=_CREATED)
    none = F.lit(None).cast("long")
    return rows.select("code_id", F.lit(None).cast("string").alias("reason"), "shots", "failures").unionByName(
        excluded.select("code_id", "reason", none.alias("shots"), none.alias("failures")))


# Calibration documents written as nested JSON and read back.

def _cell_pairs(spark, sf):
    """The k-th trials of both decoders of a cell, paired: the 2x2 table per (p, item)."""
    li = views.read(spark, sf, "lineitem")
    order = [F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    numbered = ranks.row_index(li.select("l_tax", "l_suppkey", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"),
                               order, ["l_tax", "l_suppkey", "l_linestatus"], "trial")
    long = numbered.select(F.col("l_tax").alias("p"), F.col("l_suppkey").cast("string").alias("code_id"), "trial",
                           F.col("l_linestatus").alias("treatment"), (F.col("l_returnflag") == "R").alias("failed"))
    long = long.repartition(ranks.tasks_for(li.count()), "p", "code_id", "trial")
    table = trials.contingency(trials.pair_treatments(long, ["F", "O"], ["p", "code_id", "trial"]), ["p", "code_id"], "F", "O")
    return table.select("p", "code_id", F.lit("F|O").alias("pairing"), "both_fail", "only_a", "only_b",
                        F.col("neither_fails").alias("neither"), F.col("mcnemar_exact_p").alias("p_value"))


def _documents(spark, sf):
    flat = projecting.cells(spark, sf)
    stop = trials.stop_reason(F.col("failures"), F.col("shots"), 5, 40)
    docs = cell_source.nest(flat.withColumn("stopped_by", stop), _cell_pairs(spark, sf))
    path = scratch.new_path(spark, "cells")
    tables.write_json(docs, path)
    return cell_source.read_cells(spark, path, multi_line=False)


@query("calibration_cell_table", "S4 M11 T7 P16 P17", f"""WITH {projecting._CELLS},
w AS (SELECT p, code_id, decoder, shots, failures, ler, decode_seconds FROM cl),
e AS (SELECT *, CASE WHEN failures > 0 THEN CAST(ceil(5 * shots / failures::DOUBLE) AS BIGINT) END AS shots_estimate,
        CASE WHEN failures > 0 THEN ceil(5 * shots / failures::DOUBLE) > 40 WHEN ceil(5.0 / least(1.0, (3.8414588206941227/(2.0*shots))/(1.0 + 3.8414588206941227/shots) + (1.959963984540054*sqrt(3.8414588206941227/(4.0*shots*shots)))/(1.0 + 3.8414588206941227/shots))) > 40 THEN true END AS exceeds_max_shots
      FROM w),
x AS (SELECT *, CASE WHEN shots_estimate IS NULL OR coalesce(exceeds_max_shots, false) THEN 40 ELSE least(CAST(ceil(shots_estimate / 8.0::DOUBLE) AS BIGINT) * 8, 40) END AS rs FROM e)
SELECT p, code_id, decoder, failures, round(ler, 9) AS ler, shots_estimate, exceeds_max_shots, round(rs * decode_seconds / shots / 3600, 9) AS core_hours FROM x""")
def calibration_cell_table(spark: SparkSession, sf: str) -> DataFrame:
    flat = cell_source.flatten(_documents(spark, sf))
    out = calibration.cell_table(flat, max_shots=40, shot_batch=8, min_failures=5)
    return rounded(out.select("p", "code_id", "decoder", "failures", "ler", "shots_estimate", "exceeds_max_shots", "core_hours"), "ler", "core_hours")


@query("calibration_pairs", "M11 A9 P25 S4", """
WITH n AS (SELECT l_tax AS p, CAST(l_suppkey AS VARCHAR) AS code_id, l_linestatus AS d, l_returnflag = 'R' AS f,
                  row_number() OVER (PARTITION BY l_tax, l_suppkey, l_linestatus ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS t FROM lineitem),
c AS (SELECT a.p, a.code_id, count_if(a.f AND b.f) AS both_fail, count_if(a.f AND NOT b.f) AS only_a, count_if(NOT a.f AND b.f) AS only_b,
             count_if(NOT a.f AND NOT b.f) AS neither FROM n a JOIN n b ON a.p = b.p AND a.code_id = b.code_id AND a.t = b.t AND a.d = 'F' AND b.d = 'O' GROUP BY 1, 2),
s AS (SELECT p, code_id, sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) AS s
      FROM (SELECT *, unnest(range(CAST(least(only_a, only_b) + 1 AS BIGINT))) AS i FROM c) GROUP BY 1, 2)
SELECT c.p, c.code_id, 'F|O' AS pairing, CAST(both_fail AS BIGINT) AS both_fail, CAST(only_a AS BIGINT) AS only_a, CAST(only_b AS BIGINT) AS only_b,
       CAST(neither AS BIGINT) AS neither, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * s) END + 1e-11, 9) AS p_value
FROM c JOIN s ON c.p = s.p AND c.code_id = s.code_id""")
def calibration_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairings of every cell, after a round trip through nested JSON documents."""
    # Exact values often end in a 5 at the tenth place; a small shift keeps rounding from hanging on the last bit.
    return rounded(cell_source.flatten_pairs(_documents(spark, sf)).withColumn("p_value", F.col("p_value") + 1e-11), "p_value")


@query("foreign_cells", "S4", f"""WITH {projecting._CELLS}, d AS (SELECT p, code_id, count(*) AS n FROM cl GROUP BY 1, 2)
SELECT p, code_id FROM d WHERE n < 2 OR p > 0.06""")
def foreign_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells off the planned grid, or without both decoders."""
    docs = _documents(spark, sf)
    plan = docs.filter("p <= 0.06").select("p", F.col("code.code_id").alias("code_id"))
    return cell_source.foreign_cells(docs, plan, ["F", "O"])


@query("calibration_status_counts", "M11 A10", f"""WITH {projecting._CELLS},
r AS (SELECT CASE WHEN failures >= 5 THEN 'min_failures' WHEN shots >= 40 THEN 'max_shots' ELSE 'running' END AS s FROM cl)
SELECT x AS stopped_by, (SELECT count(*) FROM r WHERE s = x) AS n FROM (SELECT unnest(['min_failures', 'max_shots', 'wall_clock', 'killed', 'died']) AS x)""")
def calibration_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.summarize(_documents(spark, sf), projecting.population(spark, sf), small="1", large="7", max_shots=40,
                                 shot_batch=8, min_failures=5).status_counts


@query("calibration_projection", "M11 M10 U3", f"WITH {projecting._proj('pp')} {projecting._sum()} FROM pj GROUP BY p, decoder, max_shots")
def calibration_projection(spark: SparkSession, sf: str) -> DataFrame:
    out = calibration.summarize(_documents(spark, sf), projecting.population(spark, sf), small="1", large="7", max_shots=40,
                                shot_batch=8, min_failures=5).projection
    return projecting._round_summary(out)


@query("session_deaths", "S5 A6", """
SELECT CAST(user_id AS VARCHAR) AS code_id, count(*) AS n_deaths FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2""")
def session_deaths(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as a session document, written as JSON and read back; an error is a death in it."""
    e = views.read(spark, sf, "events")
    death = F.struct(F.col("user_id").cast("string").alias("code_id"), F.lit(1).alias("exitcode"))
    died = F.when(F.col("event_type") == "error", F.array(death)).otherwise(F.array().cast("array<struct<code_id:string,exitcode:int>>"))
    path = scratch.new_path(spark, "sessions")
    tables.write_json(e.select(F.col("event_id").alias("session"), F.col("event_type").alias("kind"), died.alias("died")), path)
    sessions = cell_source.read_sessions(spark, path, multi_line=False, glob="*.json")
    return trials.deaths_by_item(sessions.withColumn("died", F.col("died.code_id")))


@query("undefined_values", "P26", """
SELECT l_suppkey, round(CASE WHEN stddev_pop(l_tax) = 0 THEN NULL ELSE (max(l_tax) - avg(l_tax)) / stddev_pop(l_tax) END, 9) AS spread
FROM lineitem WHERE l_quantity = 50 GROUP BY 1""")
def undefined_values(spark: SparkSession, sf: str) -> DataFrame:
    """The largest tax in standard deviations: undefined, and so null, for a supplier whose taxes are all the same."""
    per = views.read(spark, sf, "lineitem").filter("l_quantity = 50").groupBy("l_suppkey").agg(
        (F.max("l_tax") - F.avg("l_tax")).alias("over"), F.stddev_pop("l_tax").alias("s"))
    ratio = F.when(F.col("s") == 0, F.lit(float("nan"))).otherwise(F.try_divide("over", "s"))
    return rounded(per.select("l_suppkey", rates.null_if_nan(ratio.alias("r")).alias("spread")), "spread")


# Folds and models.

@query("grouped_folds", "L1", f"""WITH RECURSIVE {_M},
g AS (SELECT construction_program_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, construction_program_id) AS pos FROM meas GROUP BY 1),
s AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS grp, NULL::INTEGER AS fold UNION ALL
      SELECT g.pos, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END), g.construction_program_id,
             CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER) FROM s JOIN g ON g.pos = s.i + 1)
SELECT grp AS construction_program_id, fold FROM s WHERE i > 0""")
def grouped_folds(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_folds(views.measurements(spark, sf), 5)


@query("leave_one_group_out", "L1", f"""WITH {_M}
SELECT construction_program_id, CAST(row_number() OVER (ORDER BY count(*) DESC, construction_program_id) - 1 AS INTEGER) AS fold FROM meas GROUP BY 1""")
def leave_one_group_out(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_folds(views.measurements(spark, sf))


@query("leaking_groups", "L4", """
SELECT l_suppkey AS construction_program_id, count(DISTINCT l_linenumber % 3) AS n_folds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber % 3) > 1""")
def leaking_groups(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("construction_program_id"),
                                                  F.pmod("l_linenumber", F.lit(3)).alias("fold"))
    return splits.leaking_groups(li)


@query("feature_matrix", "L2", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, CASE WHEN l_discount > 0.02 THEN l_discount END AS gap, CASE WHEN l_discount > 0.02 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS gap__missing FROM lineitem""")
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("gap"))
    return model.feature_matrix(li, ["l_quantity", "gap"], ["gap"])


@query("out_of_fold_predictions", "L3")
def out_of_fold_predictions(spark: SparkSession, sf: str) -> DataFrame:
    m = views.measurements(spark, sf).withColumn("girth_x", F.when(F.col("p_size") > 5, F.col("p_size")))
    return model.out_of_fold_predictions(m, ["n", "k", "d_upper", "phi_from_d_upper", "p_retailprice", "girth_x"])


_STUMPS, _STUMP_RATE, _STUMP_ROWS, _STUMP_FEATURES = 4, 0.3, 10, ("n", "k", "d_upper", "rounds")


def _stump_sql(i: int) -> str:
    """One more tree of one split for every fold: its residual sums per value, its best split, and the state after it."""
    values = " UNION ALL ".join(f"SELECT f, {j} AS j, {c} AS v, y - p AS r FROM s{i} WHERE train AND own <> f" for j, c in enumerate(_STUMP_FEATURES))
    pick = " ".join(f"WHEN {j} THEN {c}" for j, c in enumerate(_STUMP_FEATURES))
    return f"""
u{i} AS (SELECT f, j, v, sum(r) AS r, count(*) AS n FROM ({values}) GROUP BY 1, 2, 3),
h{i} AS (SELECT f, j, v, sum(r) OVER w AS rl, sum(n) OVER w AS nl, sum(r) OVER g AS rt, sum(n) OVER g AS nt FROM u{i}
         WINDOW w AS (PARTITION BY f, j ORDER BY v), g AS (PARTITION BY f, j)),
g{i} AS (SELECT *, round(rl * rl / nl + (rt - rl) * (rt - rl) / (nt - nl) - rt * rt / nt, 9) AS gain FROM h{i} WHERE nl >= {_STUMP_ROWS} AND nt - nl >= {_STUMP_ROWS}),
b{i} AS (SELECT * FROM g{i} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY f ORDER BY gain DESC, j, v) = 1),
s{i + 1} AS (SELECT s.f, s.code_id, s.own, s.train, s.y, s.n, s.k, s.d_upper, s.rounds,
                    s.p + {_STUMP_RATE} * coalesce(CASE WHEN CASE b.j {pick} END <= b.v THEN b.rl / b.nl ELSE (b.rt - b.rl) / (b.nt - b.nl) END, 0) AS p
             FROM s{i} s LEFT JOIN b{i} b ON b.f = s.f)"""


@query("boosted_stumps", "L3 L1", f"""WITH {_M},
fo AS (SELECT construction_program_id AS c, row_number() OVER (ORDER BY count(*) DESC, construction_program_id) - 1 AS own FROM meas GROUP BY 1),
it AS (SELECT code_id, own, NOT censored AS train, log10(true_ler) AS y, n, k, d_upper, rounds FROM meas JOIN fo ON c = construction_program_id),
s0 AS (SELECT f.own AS f, it.*, b.p FROM fo f CROSS JOIN it JOIN (SELECT f.own AS f, avg(y) AS p FROM fo f JOIN it ON it.own <> f.own AND train GROUP BY 1) b ON b.f = f.own),
{", ".join(_stump_sql(i) for i in range(_STUMPS))}
SELECT code_id, CAST(own AS INTEGER) AS fold, round(p, 9) AS pred_log10_ler FROM s{_STUMPS} WHERE own = f""")
def boosted_stumps(spark: SparkSession, sf: str) -> DataFrame:
    """Four trees of one split in every fold, leave-one-group-out: small enough for SQL to grow them too."""
    out = model.out_of_fold_predictions(views.measurements(spark, sf), _STUMP_FEATURES, params={
        "maxIter": _STUMPS, "maxDepth": 1, "stepSize": _STUMP_RATE, "minInstancesPerNode": _STUMP_ROWS})
    return rounded(out.drop("model_version"), "pred_log10_ler")


# Streams.

def _stream_source(spark, sf, rows):
    """The rows in files of their own, read back a few files to a micro-batch."""
    folder = scratch.new_path(spark, "stream-source")
    rows.repartition(6, F.xxhash64("item", "batch_index")).write.parquet(folder)
    return stream.read_stream(spark, folder, rows.schema, max_files=2)


def _string_batches(spark, sf):
    return views.batches(spark, sf).withColumn("item", F.col("item").cast("string"))


def _stopped_stream(spark, sf, batches=None):
    path, done = scratch.new_path(spark, "stream-out"), scratch.new_path(spark, "stream-checkpoint")
    rows = _stream_source(spark, sf, _string_batches(spark, sf) if batches is None else batches)
    stream.to_table(stream.stop_items(rows, batch_size=views.VIEW_BATCH, max_shots=_SHOT_CAP, min_failures=_SHOT_MIN), path, done).awaitTermination()
    return path


@query("streaming_stopping", "R1 R2 R3 W6", f"""WITH {_BATCHES},
run AS (SELECT *, sum(batch_shots) OVER w AS shots, sum(batch_failures) OVER w AS failures FROM batches WINDOW w AS (PARTITION BY item ORDER BY batch_index))
SELECT CAST(item AS VARCHAR) AS item, batch_index, CAST(shots AS BIGINT) AS shots, CAST(failures AS BIGINT) AS failures,
       CASE WHEN failures >= {_SHOT_MIN} THEN 'min_failures' WHEN shots >= {_SHOT_CAP} THEN 'max_shots' ELSE 'running' END AS stopped_by
FROM run WHERE failures - batch_failures < {_SHOT_MIN} AND shots - batch_shots < {_SHOT_CAP}""")
def streaming_stopping(spark: SparkSession, sf: str) -> DataFrame:
    path = _stopped_stream(spark, sf)
    return spark.read.parquet(f"{path}/kept").select("item", "batch_index", "shots", "failures", "stopped_by")


@query("streaming_refusals", "R2", f"""WITH {_BATCHES},
run AS (SELECT *, sum(batch_shots) OVER w AS shots, sum(batch_failures) OVER w AS failures FROM batches WINDOW w AS (PARTITION BY item ORDER BY batch_index))
SELECT CAST(item AS VARCHAR) AS item, batch_index, 'past_stop' AS status
FROM run WHERE failures - batch_failures >= {_SHOT_MIN} OR shots - batch_shots >= {_SHOT_CAP}""")
def streaming_refusals(spark: SparkSession, sf: str) -> DataFrame:
    path = _stopped_stream(spark, sf)
    return spark.read.parquet(f"{path}/refused").select("item", "batch_index", "status")


@query("streaming_provenance", "R2 R5 F14", f"""WITH {_BATCHES},
run AS (SELECT *, sum(batch_shots) OVER w AS shots, sum(batch_failures) OVER w AS failures, item % 5 = 0 AS mixed FROM batches WINDOW w AS (PARTITION BY item ORDER BY batch_index)),
st AS (SELECT *, failures - batch_failures >= {_SHOT_MIN} OR shots - batch_shots >= {_SHOT_CAP} AS late FROM run),
fo AS (SELECT item FROM st WHERE mixed AND batch_index = 3 AND NOT late)
SELECT CAST(st.item AS VARCHAR) AS item, batch_index,
       CASE WHEN fo.item IS NOT NULL AND batch_index = 3 THEN 'foreign' WHEN late OR (fo.item IS NOT NULL AND batch_index > 3) THEN 'past_stop' END AS status
FROM st LEFT JOIN fo ON fo.item = st.item WHERE late OR (fo.item IS NOT NULL AND batch_index >= 3)""")
def streaming_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """From its fourth batch on, every fifth item comes from another machine: that batch is quarantined, the rest refused."""
    other = (F.pmod(F.col("item").cast("long"), F.lit(5)) == 0) & (F.col("batch_index") >= 3)
    path = _stopped_stream(spark, sf, _string_batches(spark, sf).withColumn("cpu_class", F.when(other, "b").otherwise("a")))
    return spark.read.parquet(f"{path}/refused").select("item", "batch_index", "status")


@query("streaming_distinct_events", "R1 R4", """
SELECT user_id AS item, count(*) AS n FROM events GROUP BY 1""")
def streaming_distinct_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event arrives twice; each is stored once."""
    events = views.read(spark, sf, "events")
    twice = scratch.table(events.unionByName(events).select(F.col("user_id").alias("item"), F.col("event_id").alias("batch_index"), "ts"), "twice")
    rows = spark.readStream.schema(twice.schema).parquet(twice.inputFiles()[0].rsplit("/", 1)[0])
    path, done = scratch.new_path(spark, "distinct"), scratch.new_path(spark, "distinct-checkpoint")
    stream.ingest(stream.without_repeats(rows, "ts", "3650 days"), path, done).awaitTermination()
    return spark.read.parquet(path).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("streaming_snapshot", "R6 A5", f"""WITH {_BATCHES},
t AS (SELECT item, sum(batch_shots) AS s, sum(batch_failures) AS f FROM batches GROUP BY 1),
st AS (SELECT CASE WHEN f >= {_SHOT_MIN} OR s >= {_SHOT_CAP} THEN 'done' ELSE 'partial' END AS state FROM t)
SELECT s AS state, (SELECT count(*) FROM st WHERE state = s) AS n FROM (SELECT unnest(['done', 'partial', 'not_started', 'failed', 'row_error']) AS s)""")
def streaming_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    source = scratch.table(_string_batches(spark, sf), "stream-batches")
    rows = _stream_source(spark, sf, source)
    path, done = scratch.new_path(spark, "snapshots"), scratch.new_path(spark, "snapshot-checkpoint")
    people = source.select(F.col("item").alias("code_id")).distinct()
    stopped = stream.stop_items(rows, batch_size=views.VIEW_BATCH, max_shots=_SHOT_CAP, min_failures=_SHOT_MIN)
    stream.snapshots(stopped, people, path, done).awaitTermination()
    taken = spark.read.parquet(f"{path}/snapshots")
    return taken.filter(F.col("batch_id") == taken.agg(F.max("batch_id").alias("b")).select("b").scalar()).select("state", "n")


@query("streaming_snapshot_series", "R6 A5", f"""WITH {_BATCHES},
t AS (SELECT item, sum(batch_shots) AS s, sum(batch_failures) AS f FROM batches GROUP BY 1),
st AS (SELECT CASE WHEN f >= {_SHOT_MIN} OR s >= {_SHOT_CAP} THEN 'done' ELSE 'partial' END AS state, item % 3 AS part FROM t)
SELECT b.b AS batch_id, x.s AS state, (SELECT count(*) FROM st WHERE (part <= b.b AND state = x.s) OR (part > b.b AND x.s = 'not_started')) AS n
FROM (SELECT unnest(CAST([0, 1, 2] AS BIGINT[])) AS b) b, (SELECT unnest(['done', 'partial', 'not_started', 'failed', 'row_error']) AS s) x""")
def streaming_snapshot_series(spark: SparkSession, sf: str) -> DataFrame:
    """Thirds of the items arrive one after the other; the counts after each of the three triggers."""
    source = scratch.table(_string_batches(spark, sf), "stream-batches")
    folder = scratch.new_path(spark, "stream-source")
    part = F.pmod(F.col("item").cast("long"), F.lit(3))
    for i in range(3):
        source.filter(part == i).coalesce(1).write.mode("append").parquet(folder)
    rows = stream.read_stream(spark, folder, source.schema, max_files=1)
    path, done = scratch.new_path(spark, "snapshots"), scratch.new_path(spark, "snapshot-checkpoint")
    people = source.select(F.col("item").alias("code_id")).distinct()
    stopped = stream.stop_items(rows, batch_size=views.VIEW_BATCH, max_shots=_SHOT_CAP, min_failures=_SHOT_MIN)
    stream.snapshots(stopped, people, path, done, members_only=True).awaitTermination()
    return spark.read.parquet(f"{path}/snapshots").select(F.col("batch_id").cast("long").alias("batch_id"), "state", "n")


@query("streaming_unique_batches", "R1 R4", f"""WITH {_BATCHES}
SELECT CAST(item AS VARCHAR) AS item, CAST(batch_index AS BIGINT) AS batch_index, CAST(batch_shots AS BIGINT) AS batch_shots FROM batches""")
def streaming_unique_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Every shard arrives again in a later trigger, whatever its time; the state holds runs of indices, no watermark."""
    source = scratch.table(_string_batches(spark, sf), "stream-batches")
    folder = scratch.new_path(spark, "stream-source")
    for _ in range(2):
        source.coalesce(1).write.mode("append").parquet(folder)
    path, done = scratch.new_path(spark, "unique"), scratch.new_path(spark, "unique-checkpoint")
    once = stream.each_batch_once(stream.read_stream(spark, folder, source.schema, max_files=1))
    stream.ingest(once, path, done).awaitTermination()
    return spark.read.schema(source.schema).parquet(path).select(
        "item", F.col("batch_index").cast("long").alias("batch_index"), F.col("batch_shots").cast("long").alias("batch_shots"))


@query("streaming_gaps", "R2 R3", f"""WITH {_BATCHES},
run AS (SELECT *, sum(batch_shots) OVER w AS shots, sum(batch_failures) OVER w AS failures FROM batches WINDOW w AS (PARTITION BY item ORDER BY batch_index)),
ends AS (SELECT item, max(batch_index) AS last, max(CASE WHEN failures - batch_failures < {_SHOT_MIN} AND shots - batch_shots < {_SHOT_CAP} THEN batch_index END) AS stop
         FROM run GROUP BY 1)
SELECT CAST(item AS VARCHAR) AS item, CAST(2 AS BIGINT) AS batch_index, 'gap' AS status FROM ends WHERE item % 5 = 0 AND last > 2 AND stop >= 2""")
def streaming_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The third batch of every fifth item is lost: an item that still waits for it reports the missing index."""
    source = scratch.table(_string_batches(spark, sf), "stream-batches")
    lost = (F.pmod(F.col("item").cast("long"), F.lit(5)) == 0) & (F.col("batch_index") == 2)
    folder = scratch.new_path(spark, "stream-source")
    source.filter(~lost).coalesce(1).write.parquet(folder)
    # A later shard of no item of the table: its trigger comes after the patience is over.
    source.limit(1).withColumn("item", F.lit("later")).coalesce(1).write.mode("append").parquet(folder)
    path, done = scratch.new_path(spark, "gaps"), scratch.new_path(spark, "gap-checkpoint")
    rows = stream.read_stream(spark, folder, source.schema, max_files=1)
    waiting = stream.stop_items(rows, batch_size=views.VIEW_BATCH, max_shots=_SHOT_CAP, min_failures=_SHOT_MIN, gap_minutes=0.0001)
    # A stream with processing-time timeouts never runs out of triggers without data; this one ends after those with data.
    option = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(option, "true")
    spark.conf.set(option, "false")
    try:
        running = stream.to_table(waiting, path, done)
    finally:
        spark.conf.set(option, before)
    running.awaitTermination()
    gaps = spark.read.parquet(f"{path}/refused").filter("status = 'gap' and item != 'later'")
    return gaps.select("item", "batch_index", "status").distinct()
