"""Queries: trials, batches, stopping, guards on shards, paired tallies."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rates
from ..operators import guards, trials
from ..plans import views
from .core import query, rounded

_MIN, _CAP = 10, 60
_B = views.BATCHES_SQL
_STOP = f"""{_B},
run AS (SELECT *, sum(batch_shots) OVER w AS shots, sum(batch_failures) OVER w AS failures FROM batches
        WINDOW w AS (PARTITION BY item ORDER BY batch_index)),
kept AS (SELECT * FROM run WHERE failures - batch_failures < {_MIN} AND shots - batch_shots < {_CAP}),
cons AS (SELECT item, CAST(max(shots) AS BIGINT) AS shots, CAST(max(failures) AS BIGINT) AS failures, count(*) AS n_batches,
                CAST(sum(batch_osd_invocations) AS BIGINT) AS osd_invocations, sum(batch_decode_seconds) AS decode_seconds,
                CASE WHEN max(failures) >= {_MIN} THEN 'min_failures' WHEN max(shots) >= {_CAP} THEN 'max_shots' ELSE 'running' END AS stopped_by
         FROM kept GROUP BY item)"""


def _stopped(spark, sf):
    return trials.stop_batches(views.batches(spark, sf), min_failures=_MIN, max_shots=_CAP)


def _consolidated(spark, sf):
    return trials.consolidate(_stopped(spark, sf), min_failures=_MIN, max_shots=_CAP)


@query("sequential_stopping", "W6", f"""WITH {_STOP}
SELECT item, batch_index, batch_shots, batch_failures, CAST(shots AS BIGINT) AS shots, CAST(failures AS BIGINT) AS failures FROM kept""")
def sequential_stopping(spark: SparkSession, sf: str) -> DataFrame:
    return _stopped(spark, sf).select("item", "batch_index", "batch_shots", "batch_failures", "shots", "failures")


@query("consolidated_items", "A3", f"""WITH {_STOP}
SELECT item, shots, failures, n_batches, osd_invocations, round(decode_seconds, 6) AS decode_seconds, stopped_by FROM cons""")
def consolidated_items(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_consolidated(spark, sf), "decode_seconds", digits=6)


@query("counts_by_stop_reason", "A10", f"""WITH {_STOP}
SELECT s AS stopped_by, (SELECT count(*) FROM cons WHERE stopped_by = s) AS n
FROM (SELECT unnest(['min_failures', 'max_shots', 'wall_clock', 'running']) AS s)""")
def counts_by_stop_reason(spark: SparkSession, sf: str) -> DataFrame:
    return trials.zero_filled_counts(_consolidated(spark, sf), "stopped_by",
                                     ["min_failures", "max_shots", "wall_clock", "running"])


@query("shard_sequence_problems", "F12", f"""WITH {_B},
run AS (SELECT *, sum(batch_shots) OVER w AS shots, sum(batch_failures) OVER w AS failures FROM batches
        WINDOW w AS (PARTITION BY item ORDER BY batch_index))
SELECT item, batch_index, CASE WHEN shots - batch_shots >= {_CAP} OR failures - batch_failures >= {_MIN} THEN 'past the stopping point'
       ELSE 'batch size' END AS problem
FROM run WHERE shots - batch_shots >= {_CAP} OR failures - batch_failures >= {_MIN} OR batch_shots <> {views.VIEW_BATCH}""")
def shard_sequence_problems(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ranks
    shards = ranks.running_sums(views.batches(spark, sf), ["item"], "batch_index",
                                {"shots": "batch_shots", "failures": "batch_failures"})
    return guards.shard_problems(shards, batch_size=views.VIEW_BATCH, max_shots=_CAP, min_failures=_MIN)


@query("mixed_provenance", "F13 F14", """
WITH g AS (SELECT user_id AS item, min(event_type) <> max(event_type) AS a, min(props) <> max(props) AS b FROM events GROUP BY 1)
SELECT item, CASE WHEN a THEN 'event_type' ELSE 'props' END AS field FROM g WHERE a OR b""")
def mixed_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return guards.first_mixed_field(views.read(spark, sf, "events").withColumnRenamed("user_id", "item"), "item",
                                    ["event_type", "props"])


@query("result_consistency", "F15", f"""WITH {_STOP},
res AS (SELECT user_id AS item, count(*) AS shots, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1),
res2 AS (SELECT *, CASE WHEN failures >= {_MIN} THEN 'min_failures' ELSE 'max_shots' END AS stopped_by FROM res)
SELECT r.item, CASE WHEN r.shots <> c.shots OR r.failures <> c.failures THEN 'totals' ELSE 'stop reason' END AS problem
FROM res2 r JOIN cons c ON r.item = c.item
WHERE r.shots <> c.shots OR r.failures <> c.failures OR (r.failures < {_MIN} AND r.shots <> {_CAP})""")
def result_consistency(spark: SparkSession, sf: str) -> DataFrame:
    results = (views.read(spark, sf, "events").groupBy(F.col("user_id").alias("item"))
               .agg(F.count(F.lit(1)).alias("shots"), F.count_if(F.col("event_type") == "error").alias("failures"))
               .withColumn("stopped_by", F.when(F.col("failures") >= _MIN, "min_failures").otherwise("max_shots")))
    return guards.result_problems(results, _consolidated(spark, sf), max_shots=_CAP, min_failures=_MIN)


@query("failing_trials", "A2", """
WITH t AS (SELECT l_suppkey AS item, l_orderkey AS trial, bool_or((l_returnflag = 'R') <> (l_linestatus = 'F')) AS failed
           FROM lineitem GROUP BY 1, 2)
SELECT item, count(*) AS shots, CAST(count_if(failed) AS BIGINT) AS failures FROM t GROUP BY item""")
def failing_trials(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem")
    return trials.trial_failures(li.select(
        F.col("l_suppkey").alias("item"), F.col("l_orderkey").alias("trial"),
        (F.col("l_returnflag") == "R").alias("predicted"), (F.col("l_linestatus") == "F").alias("actual")))


@query("packed_failing_trials", "A2", """
SELECT l_suppkey AS item, count(*) AS shots,
       CAST(count_if(bit_count(xor(l_orderkey, l_partkey) & 7) > 0) AS BIGINT) AS failures FROM lineitem GROUP BY 1""")
def packed_failing_trials(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("item")).agg(
        F.count(F.lit(1)).alias("shots"),
        F.count_if(trials.packed_failure("l_orderkey", "l_partkey", 3)).alias("failures"))


@query("paired_stopping", "W14", f"""WITH {_B},
f AS (SELECT user_id AS item, trial, event_type = 'error' AS a, value > 15 AS b FROM trials),
c AS (SELECT *, sum(a::INT) OVER w - a::INT AS pa, sum(b::INT) OVER w - b::INT AS pb FROM f
      WINDOW w AS (PARTITION BY item ORDER BY trial)),
k AS (SELECT * FROM c WHERE least(pa, pb) < 4 AND trial < 45)
SELECT item, count(*) AS shots, CAST(count_if(a) AS BIGINT) AS failures_a, CAST(count_if(b) AS BIGINT) AS failures_b,
       CASE WHEN least(count_if(a), count_if(b)) >= 4 THEN 'min_failures' WHEN count(*) >= 45 THEN 'max_shots' ELSE 'running' END AS stopped_by
FROM k GROUP BY item""")
def paired_stopping(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trials(spark, sf).select(F.col("user_id").alias("item"), "trial",
                                       (F.col("event_type") == "error").alias("a"), (F.col("value") > 15).alias("b"))
    kept = trials.stop_paired(t, ["a", "b"], min_failures=4, max_shots=45)
    return trials.paired_stop_summary(kept, ["a", "b"], min_failures=4, max_shots=45)


@query("paired_contingency", "J8 A9 P25", f"""WITH {views.PAIRED_SQL},
c AS (SELECT item, count_if(fail_a AND NOT fail_b) AS only_a, count_if(NOT fail_a AND fail_b) AS only_b,
             count_if(fail_a AND fail_b) AS both_fail, count_if(NOT fail_a AND NOT fail_b) AS neither_fails FROM paired GROUP BY 1),
tail AS (SELECT item, sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1)
                              - (only_a + only_b) * ln(2))) AS s
         FROM (SELECT *, unnest(range(CAST(least(only_a, only_b) + 1 AS BIGINT))) AS i FROM c) GROUP BY item)
SELECT c.item, CAST(only_a AS BIGINT) AS only_a, CAST(only_b AS BIGINT) AS only_b, CAST(both_fail AS BIGINT) AS both_fail,
       CAST(neither_fails AS BIGINT) AS neither_fails,
       round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * s) END, 9) AS mcnemar_exact_p
FROM c JOIN tail ON c.item = tail.item""")
def paired_contingency(spark: SparkSession, sf: str) -> DataFrame:
    p = views.paired(spark, sf)
    cells = F.array(F.struct(F.lit("fail_a").alias("treatment"), F.col("fail_a").alias("failed")),
                    F.struct(F.lit("fail_b").alias("treatment"), F.col("fail_b").alias("failed")))
    long = p.select("item", "trial", F.explode(cells).alias("c")).select("item", "trial", "c.treatment", "c.failed")
    paired = trials.pair_treatments(long, ["fail_a", "fail_b"], ["item", "trial"])
    return rounded(trials.contingency(paired, ["item"]), "mcnemar_exact_p")


def cell_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as trials: rate = tax, item = supplier, treatment = line status."""
    li = views.read(spark, sf, "lineitem")
    return li.select(
        F.col("l_tax").alias("p"), F.col("l_suppkey").cast("string").alias("code_id"), F.col("l_linestatus").alias("decoder"),
        (F.col("l_returnflag") == "R").alias("failed"), (F.col("l_quantity") / 1000).alias("seconds"),
        (F.col("l_discount") > 0.05).alias("converged"),
        (F.lit(1) + F.pmod("l_suppkey", F.lit(8))).cast("int").alias("rounds"),
        (F.lit(1) + F.pmod("l_suppkey", F.lit(6))).cast("int").alias("k"))


def tally_cells(spark: SparkSession, sf: str) -> DataFrame:
    return trials.tally(cell_trials(spark, sf), ["p", "code_id", "decoder"], min_failures=5)


def _rate(p):
    return f"CASE WHEN {p} = 0 THEN 0.0 ELSE 1.0 - pow(1.0 - {p}, 1.0/(rounds*k)) END"


Z = 1.959963984540054


def wilson_sql(f="failures", n="shots"):
    p, d = f"({f}/{n}::DOUBLE)", f"(1.0 + {Z*Z}/{n})"
    c, h = f"({p} + {Z*Z}/(2.0*{n}))", f"({Z} * sqrt({p}*(1-{p})/{n} + {Z*Z}/(4.0*{n}*{n})))"
    return f"greatest(0.0, {c}/{d} - {h}/{d})", f"least(1.0, {c}/{d} + {h}/{d})"


_LO, _HI = wilson_sql()
TALLY_SQL = f"""
cell0 AS (SELECT l_tax AS p, CAST(l_suppkey AS VARCHAR) AS code_id, l_linestatus AS decoder, count(*) AS shots,
                 CAST(count_if(l_returnflag = 'R') AS BIGINT) AS failures, sum(l_quantity / 1000) AS decode_seconds,
                 CAST(count_if(l_discount > 0.05) AS BIGINT) AS bp_converged,
                 CAST(1 + max(l_suppkey) % 8 AS INTEGER) AS rounds, CAST(1 + max(l_suppkey) % 6 AS INTEGER) AS k
          FROM lineitem GROUP BY 1, 2, 3),
cell1 AS (SELECT *, {_LO} AS w_lo, {_HI} AS w_hi, failures = shots AS all_shots_failed FROM cell0),
cells AS (SELECT *, NOT all_shots_failed AND failures < 5 AS censored,
                 CASE WHEN NOT all_shots_failed AND failures >= 5 THEN {_rate('(failures/shots::DOUBLE)')} END AS ler,
                 CASE WHEN NOT all_shots_failed THEN {_rate('w_lo')} END AS ler_ci_low,
                 CASE WHEN NOT all_shots_failed THEN {_rate('w_hi')} END AS ler_ci_high,
                 1000.0 * decode_seconds / shots AS ms_per_shot, bp_converged / shots::DOUBLE AS bp_convergence_fraction
          FROM cell1)"""


@query("treatment_tally", "A8 P5", f"""WITH {TALLY_SQL}
SELECT p, code_id, decoder, shots, failures, bp_converged, rounds, k, censored, all_shots_failed, round(decode_seconds, 6) AS decode_seconds,
       round(ler, 9) AS ler, round(ler_ci_low, 9) AS ler_ci_low, round(ler_ci_high, 9) AS ler_ci_high,
       round(ms_per_shot, 6) AS ms_per_shot, round(bp_convergence_fraction, 9) AS bp_convergence_fraction FROM cells""")
def treatment_tally(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(tally_cells(spark, sf), "ler", "ler_ci_low", "ler_ci_high", "bp_convergence_fraction"),
                   "decode_seconds", "ms_per_shot", digits=6)


@query("tolerant_labels", "P5", f"""
WITH t AS (SELECT o_orderkey AS item, count(l_orderkey) AS shots, count(*) FILTER (WHERE l_returnflag = 'R') AS failures,
                  CAST(1 + o_orderkey % 8 AS INTEGER) AS rounds, CAST(1 + o_orderkey % 6 AS INTEGER) AS k
           FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
u AS (SELECT *, CASE WHEN shots > 0 THEN {_LO} END AS w_lo, CASE WHEN shots > 0 THEN {_HI} END AS w_hi,
             shots > 0 AND shots = failures AS all_shots_failed FROM t)
SELECT item, shots, failures, all_shots_failed, shots = 0 OR (NOT all_shots_failed AND failures < 2) AS censored,
       round(CASE WHEN shots > 0 AND NOT all_shots_failed AND failures >= 2 THEN {_rate('(failures/shots::DOUBLE)')} END, 9) AS ler,
       round(CASE WHEN shots > 0 AND NOT all_shots_failed THEN {_rate('w_lo')} END, 9) AS ler_ci_low,
       round(CASE WHEN shots > 0 AND NOT all_shots_failed THEN {_rate('w_hi')} END, 9) AS ler_ci_high FROM u""")
def tolerant_labels(spark: SparkSession, sf: str) -> DataFrame:
    # Trials are summed per order before the join, so a hot order is one row when it meets the order list.
    per = (views.read(spark, sf, "lineitem").groupBy("l_orderkey")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("f")))
    o = views.read(spark, sf, "orders").select("o_orderkey").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    t = o.select(F.col("o_orderkey").alias("item"), F.coalesce("n", F.lit(0)).alias("shots"),
                 F.coalesce("f", F.lit(0)).alias("failures"),
                 (F.lit(1) + F.pmod("o_orderkey", F.lit(8))).cast("int").alias("rounds"),
                 (F.lit(1) + F.pmod("o_orderkey", F.lit(6))).cast("int").alias("k"))
    out = t.withColumns(rates.tolerant_label_columns(min_failures=2)).drop("rounds", "k")
    return rounded(out, "ler", "ler_ci_low", "ler_ci_high")


@query("batch_digests", "A19", f"""WITH {_B}
SELECT user_id AS item, CAST(trial // 5 AS BIGINT) AS batch_index,
       sha256(string_agg(event_id || ',' || event_type, ';' ORDER BY trial)) AS batch_sha256 FROM trials GROUP BY 1, 2""")
def batch_digests(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trials(spark, sf).withColumnRenamed("user_id", "item")
    return trials.batch_digests(t, ["item"], "trial", ["event_id", "event_type"], views.VIEW_BATCH)


@query("batch_digest_mismatches", "A19", f"""WITH {_B},
a AS (SELECT user_id AS item, CAST(trial // 5 AS BIGINT) AS batch_index,
       sha256(string_agg(event_id || ',' || event_type, ';' ORDER BY trial)) AS recorded FROM trials GROUP BY 1, 2),
b AS (SELECT user_id AS item, CAST(trial // 5 AS BIGINT) AS batch_index,
       sha256(string_agg(event_id || ',' || CASE WHEN event_type = 'error' THEN 'click' ELSE event_type END, ';' ORDER BY trial)) AS drawn FROM trials GROUP BY 1, 2)
SELECT a.item, a.batch_index, recorded, drawn FROM a JOIN b ON a.item = b.item AND a.batch_index = b.batch_index WHERE recorded <> drawn""")
def batch_digest_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trials(spark, sf).withColumnRenamed("user_id", "item")
    again = t.withColumn("event_type", F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type")))
    a = trials.batch_digests(t, ["item"], "trial", ["event_id", "event_type"], views.VIEW_BATCH)
    b = trials.batch_digests(again, ["item"], "trial", ["event_id", "event_type"], views.VIEW_BATCH)
    return trials.digest_mismatches(a, b, ["item"])


@query("item_states", "A5 A6", """
WITH sh AS (SELECT l_partkey AS k, count(*) AS n_shards FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
res AS (SELECT l_partkey AS k, bool_and(l_quantity > 1) AS ok FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.06 GROUP BY 1),
dd AS (SELECT l_partkey AS k, count(*) AS n_deaths FROM lineitem WHERE l_tax > 0.07 AND l_returnflag = 'N' GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS code_id, p_brand, coalesce(n_shards, 0) AS n_shards, coalesce(n_deaths, 0) AS n_deaths,
       CASE WHEN ok THEN 'done' WHEN ok IS NOT NULL THEN 'row_error' WHEN coalesce(n_deaths, 0) >= 2 THEN 'failed'
            WHEN coalesce(n_shards, 0) > 0 THEN 'partial' ELSE 'not_started' END AS state
FROM part LEFT JOIN sh ON sh.k = p_partkey LEFT JOIN res ON res.k = p_partkey LEFT JOIN dd ON dd.k = p_partkey""")
def item_states(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem").withColumn("code_id", F.col("l_partkey").cast("string"))
    population = views.read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("code_id"), "p_brand")
    results = li.filter((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.06)).select(
        "code_id", (F.col("l_quantity") > 1).alias("row_ok"))
    shards = li.filter(F.col("l_returnflag") == "A").select("code_id")
    deaths = li.filter((F.col("l_tax") > 0.07) & (F.col("l_returnflag") == "N")).select("code_id")
    return trials.classify(population, results, shards, deaths)


@query("item_state_counts", "A5 A10", """
WITH sh AS (SELECT l_partkey AS k, count(*) AS n_shards FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
res AS (SELECT l_partkey AS k, bool_and(l_quantity > 1) AS ok FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.06 GROUP BY 1),
dd AS (SELECT l_partkey AS k, count(*) AS n_deaths FROM lineitem WHERE l_tax > 0.07 AND l_returnflag = 'N' GROUP BY 1),
st AS (SELECT p_brand, CASE WHEN ok THEN 'done' WHEN ok IS NOT NULL THEN 'row_error' WHEN coalesce(n_deaths, 0) >= 2 THEN 'failed'
            WHEN coalesce(n_shards, 0) > 0 THEN 'partial' ELSE 'not_started' END AS state
FROM part LEFT JOIN sh ON sh.k = p_partkey LEFT JOIN res ON res.k = p_partkey LEFT JOIN dd ON dd.k = p_partkey)
SELECT p_brand, s AS state, CAST(count_if(state = s) AS BIGINT) AS n
FROM st, (SELECT unnest(['done', 'partial', 'not_started', 'failed', 'row_error']) AS s) GROUP BY 1, 2""")
def item_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    return trials.zero_filled_counts(item_states(spark, sf), "state", trials.STATES, ["p_brand"])


@query("deaths_by_item", "A6", """
SELECT l_partkey AS code_id, count(*) AS n_deaths FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 2""")
def deaths_by_item(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem")
    sessions = li.select(F.when(F.col("l_returnflag") == "R", F.array("l_partkey"))
                         .otherwise(F.array().cast("array<bigint>")).alias("died"))
    return trials.deaths_by_item(sessions)


@query("shots_needed", "P16 P17", f"""WITH {views.measurements_sql()},
w AS (SELECT *, {_LO} AS lo, {_HI} AS hi FROM meas),
e AS (SELECT code_id, shots, failures, CASE WHEN failures > 0 THEN CAST(ceil(60 * shots / failures::DOUBLE) AS BIGINT) END AS shots_estimate,
             CAST(ceil(60.0 / hi) AS BIGINT) AS shots_range_low, CASE WHEN lo > 0 THEN CAST(ceil(60.0 / lo) AS BIGINT) END AS shots_range_high FROM w),
x AS (SELECT *, CASE WHEN failures > 0 THEN shots_estimate > 200 WHEN shots_range_low > 200 THEN true END AS exceeds_max_shots FROM e)
SELECT *, CASE WHEN shots_estimate IS NULL OR coalesce(exceeds_max_shots, false) THEN 200::BIGINT
               ELSE least(CAST(ceil(shots_estimate / 16.0::DOUBLE) AS BIGINT) * 16, 200) END AS run_shots,
       CASE WHEN shots_estimate IS NULL OR coalesce(exceeds_max_shots, false) THEN 200::BIGINT ELSE least(shots_estimate, 200) END AS run_shots_unbatched
FROM x""")
def shots_needed(spark: SparkSession, sf: str) -> DataFrame:
    m = views.measurements(spark, sf).select("code_id", "shots", "failures")
    return (m.withColumns(rates.shots_needed_columns(max_shots=200, min_failures=60))
            .withColumns(rates.run_shots_columns(max_shots=200, shot_batch=16)))


@query("interval_separation", "P18", f"""WITH {TALLY_SQL}
SELECT a.p, a.code_id, a.ler_ci_high < b.ler_ci_low OR b.ler_ci_high < a.ler_ci_low AS intervals_separate
FROM cells a JOIN cells b ON a.p = b.p AND a.code_id = b.code_id AND a.decoder = 'F' AND b.decoder = 'O'""")
def interval_separation(spark: SparkSession, sf: str) -> DataFrame:
    cells = tally_cells(spark, sf)
    bounds = F.struct("ler_ci_low", "ler_ci_high")
    wide = cells.groupBy("p", "code_id").agg(F.max(F.when(F.col("decoder") == "F", bounds)).alias("a"),
                                             F.max(F.when(F.col("decoder") == "O", bounds)).alias("b"))
    out = rates.separated("a.ler_ci_low", "a.ler_ci_high", "b.ler_ci_low", "b.ler_ci_high")
    return wide.filter("a is not null and b is not null").select("p", "code_id", out.alias("intervals_separate"))
