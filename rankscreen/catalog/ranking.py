"""Queries: labels, ranks and ranking metrics."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rates
from ..operators import metrics, ranks
from ..plans import views
from .core import query, rounded

_M = views.measurements_sql()

_PAIR_SQL = """
sub AS (SELECT 'all' AS subset, * FROM meas UNION ALL SELECT 'excluded', * FROM meas WHERE NOT censored),
long AS (SELECT subset, code_id, 'price_score' AS scorer, -price_score AS s, rank_value AS t FROM sub
         UNION ALL SELECT subset, code_id, 'size_score', -size_score, rank_value FROM sub
         UNION ALL SELECT subset, code_id, 'phi_from_d_upper', -phi_from_d_upper, rank_value FROM sub),
st AS (SELECT subset, scorer, t, s,
              rank() OVER (PARTITION BY subset, scorer ORDER BY t) - 1 AS tb, count(*) OVER (PARTITION BY subset, scorer, t) AS tt,
              rank() OVER (PARTITION BY subset, scorer ORDER BY s) - 1 AS sb, count(*) OVER (PARTITION BY subset, scorer, s) AS ss,
              count(*) OVER (PARTITION BY subset, scorer) AS n FROM long),
val AS (SELECT subset, scorer, 'spearman' AS metric, corr(tb + (tt + 1) / 2.0, sb + (ss + 1) / 2.0) AS v, count(*) AS n
        FROM st GROUP BY 1, 2
        UNION ALL
        SELECT subset, scorer, 'recall_at_30_of_top_10',
               CASE WHEN count(*) >= 30 THEN sum(least(1.0, greatest(0.0, (10 - tb)::DOUBLE / tt)) * least(1.0, greatest(0.0, (30 - sb)::DOUBLE / ss))) / 10 END,
               count(*) FROM st GROUP BY 1, 2)
"""

RANKING_REPORT_SQL = f"""
WITH {_M}, {_PAIR_SQL}
SELECT metric, scorer, round(max(v) FILTER (subset = 'all'), 9) AS estimate,
       CAST(max(n) FILTER (subset = 'all') - coalesce(max(n) FILTER (subset = 'excluded'), 0) AS BIGINT) AS n_censored,
       round(max(v) FILTER (subset = 'excluded'), 9) AS excl_censored
FROM val GROUP BY metric, scorer"""


@query("ranking_report", "M1 M2 M3 M8 W1 W2 P13 U1 U2", RANKING_REPORT_SQL)
def ranking_report(spark: SparkSession, sf: str) -> DataFrame:
    m = views.measurements(spark, sf)
    report = metrics.score_report(m, ["price_score", "size_score", "phi_from_d_upper"])
    return rounded(report, "estimate", "excl_censored")


@query("label_measurements", "P1 P2 P3 P4 P12 P13 P15", f"""
WITH {_M}
SELECT code_id, shots, failures, censored, round(true_ler, 9) AS true_ler, round(true_ler_ub, 9) AS true_ler_ub,
       round(true_ler_ci_low, 9) AS true_ler_ci_low, round(true_ler_ci_high, 9) AS true_ler_ci_high,
       round(rank_value, 9) AS rank_value, round(phi_from_d_upper, 9) AS phi_from_d_upper,
       round(log10(true_ler), 9) AS target
FROM meas""")
def label_measurements(spark: SparkSession, sf: str) -> DataFrame:
    m = views.measurements(spark, sf).withColumn("target", rates.log_target())
    return rounded(m.select("code_id", "shots", "failures", "censored", "true_ler", "true_ler_ub", "true_ler_ci_low",
                            "true_ler_ci_high", "rank_value", "phi_from_d_upper", "target"),
                   "true_ler", "true_ler_ub", "true_ler_ci_low", "true_ler_ci_high", "rank_value",
                   "phi_from_d_upper", "target")


@query("size_scaling_by_program", "M7", f"""
WITH {_M},
pt AS (SELECT construction_program_id AS g, d_upper AS d, true_ler AS t FROM meas WHERE NOT censored),
rk AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY d) + (count(*) OVER (PARTITION BY g, d) - 1) / 2.0 AS rd,
              rank() OVER (PARTITION BY g ORDER BY t) + (count(*) OVER (PARTITION BY g, t) - 1) / 2.0 AS rt FROM pt),
rho AS (SELECT g, corr(rd, rt) AS v FROM rk GROUP BY g),
c AS (SELECT construction_program_id, count(*) AS n_items, count_if(censored) AS n_censored,
             count(DISTINCT d_upper) FILTER (NOT censored) AS distinct_sizes FROM meas GROUP BY 1)
SELECT construction_program_id, n_items, CAST(n_censored AS BIGINT) AS n_censored, distinct_sizes,
       CASE WHEN distinct_sizes >= 2 THEN 'left to the reader' ELSE 'no reading' END AS reading,
       CASE WHEN distinct_sizes >= 2 AND NOT isnan(v) THEN round(v, 9) END AS spearman_size_vs_rate
FROM c LEFT JOIN rho ON g = construction_program_id""")
def size_scaling_by_program(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.size_scaling(views.measurements(spark, sf)), "spearman_size_vs_rate")


@query("average_tie_ranks", "W1", """
SELECT l_orderkey, l_linenumber,
       CAST(rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS DOUBLE) AS overall_rank,
       CAST(rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice)
            + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS DOUBLE) AS supplier_rank
FROM lineitem""")
def average_tie_ranks(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    out = ranks.with_average_ranks(li, [([], "l_quantity", "overall_rank"), (["l_suppkey"], "l_extendedprice", "supplier_rank")])
    return out.select("l_orderkey", "l_linenumber", "overall_rank", "supplier_rank")


@query("top_m_probability", "W2", """
WITH b AS (SELECT *, rank() OVER (ORDER BY p_size) - 1 AS below, count(*) OVER (PARTITION BY p_size) AS tie FROM part)
SELECT p_partkey, round(least(1.0, greatest(0.0, (100 - below)::DOUBLE / tie)), 9) AS top_p FROM b""")
def top_m_probability(spark: SparkSession, sf: str) -> DataFrame:
    part = views.read(spark, sf, "part").select("p_partkey", "p_size")
    return rounded(ranks.with_top_probability(part, [], "p_size", 100).select("p_partkey", "top_p"), "top_p")
