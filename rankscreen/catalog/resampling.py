"""Queries: bootstrap intervals and the label-noise ceiling."""

from pyspark.sql import DataFrame, SparkSession

from ..functions import rng
from ..operators import resample
from ..plans import views
from .core import query, rounded

_B, _SEED = 1000, 20261001
_M = views.measurements_sql()

_REPLICATES = f"""{_M},
it AS (SELECT row_number() OVER (ORDER BY code_id) - 1 AS i, rank_value AS t, -price_score AS a, -phi_from_d_upper AS b FROM meas),
nn AS (SELECT count(*) AS n FROM it),
dr AS (SELECT rep, CAST(('0x' || substr(md5('{_SEED}|' || rep || '|' || slot), 1, 15)) AS BIGINT) % n AS i
       FROM nn, (SELECT unnest(range({_B})) AS rep), (SELECT unnest(range((SELECT n FROM nn))) AS slot)),
w AS (SELECT rep, i, count(*) AS w FROM dr GROUP BY 1, 2),
j AS (SELECT rep, w, t, a, b FROM w JOIN it ON it.i = w.i),
s AS (SELECT *, sum(w) OVER (PARTITION BY rep, t) AS tt, sum(w) OVER (PARTITION BY rep, a) AS ta, sum(w) OVER (PARTITION BY rep, b) AS tb,
        sum(w) OVER (PARTITION BY rep ORDER BY t RANGE UNBOUNDED PRECEDING) AS ct, sum(w) OVER (PARTITION BY rep ORDER BY a RANGE UNBOUNDED PRECEDING) AS ca,
        sum(w) OVER (PARTITION BY rep ORDER BY b RANGE UNBOUNDED PRECEDING) AS cb FROM j),
u AS (SELECT rep, w, ct - tt AS bt, tt, ca - ta AS ba, ta, cb - tb AS bb, tb, unnest(range(w::BIGINT)) AS copy FROM s),
reps AS (SELECT rep, 'spearman' AS metric, corr(bt + (tt + 1) / 2.0, ba + (ta + 1) / 2.0) AS a, corr(bt + (tt + 1) / 2.0, bb + (tb + 1) / 2.0) AS b FROM u GROUP BY rep
         UNION ALL SELECT rep, 'recall_at_30_of_top_10',
           sum(least(1.0, greatest(0.0, (10 - bt)::DOUBLE / tt)) * least(1.0, greatest(0.0, (30 - ba)::DOUBLE / ta))) / 10,
           sum(least(1.0, greatest(0.0, (10 - bt)::DOUBLE / tt)) * least(1.0, greatest(0.0, (30 - bb)::DOUBLE / tb))) / 10 FROM u GROUP BY rep)"""


def _replicates(spark, sf):
    return resample.bootstrap_replicates(views.measurements(spark, sf), "price_score", "phi_from_d_upper",
                                         n_resamples=_B, seed=_SEED)


@query("bootstrap_replicates", "M4 U1", f"""WITH {_REPLICATES}
SELECT rep, metric, round(a, 9) AS a, round(b, 9) AS b, round(a - b, 9) AS difference FROM reps""")
def bootstrap_replicates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_replicates(spark, sf), "a", "b", "difference")


@query("bootstrap_intervals", "M4 M5", f"""WITH {_REPLICATES},
l AS (SELECT metric, 'model' AS scorer, a AS v FROM reps UNION ALL SELECT metric, 'baseline', b FROM reps UNION ALL SELECT metric, 'difference', a - b FROM reps)
SELECT metric, scorer, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM l GROUP BY 1, 2""")
def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.bootstrap_intervals(_replicates(spark, sf)), "low", "high")


_NOISE_SEED, _TRIES = 20261002, 9


def _try_sql(i: int) -> str:
    """One try of both Gamma draws: the rows it takes, their uniforms, and the draws where it accepts."""
    uses = {f"u{s}{j}": f"{4096 * stream}" + (f" + {3 * i + j}" if j else "") for s, stream in (("x", 1), ("y", 2)) for j in range(4)}
    source = "dr" if i == 0 else f"r{i}"
    rest = "" if i == 0 else f"r{i} AS (SELECT * FROM g{i - 1} WHERE gx IS NULL OR gy IS NULL), "

    def tried(s, p):
        d, z, v = f"d{s}", f"z{s}", f"v{s}"
        ok = f"{v} > 0 AND ln(u{s}3) < 0.5 * {z} * {z} + {d} - {d} * {v} + {d} * CASE WHEN {v} > 0 THEN ln({v}) ELSE 0 END"
        return f"coalesce(g{s}, CASE WHEN {ok} THEN {d} * {v} * CASE WHEN {p} < 1 THEN pow(u{s}0, 1.0 / {p}) ELSE 1.0 END END) AS g{s}"
    pairs = tuple(zip("xy", "ab"))
    dz = ", ".join(f"CASE WHEN {p} < 1 THEN {p} + 1.0 ELSE {p} END - (1.0::DOUBLE / 3.0) AS d{s}, sqrt(-2.0 * ln(u{s}1)) * cos(2.0 * pi() * u{s}2) AS z{s}" for s, p in pairs)
    v = ", ".join(f"(1.0 + z{s} / sqrt(9.0 * d{s})) * (1.0 + z{s} / sqrt(9.0 * d{s})) * (1.0 + z{s} / sqrt(9.0 * d{s})) AS v{s}" for s, _ in pairs)
    return f"""{rest}{rng.units_sql(source, f"u{i}", "cn", uses)},
z{i} AS (SELECT *, {dz} FROM u{i}), v{i} AS (SELECT *, {v} FROM z{i}),
g{i} AS (SELECT draw, score_p, rounds, k, cn, a, b, {", ".join(tried(s, p) for s, p in pairs)} FROM v{i})"""


@query("label_noise_ceiling", "M6", f"""WITH {_M},
it AS (SELECT *, least(1.0, greatest(0.0, (30 - (rank() OVER (ORDER BY rank_value) - 1))::DOUBLE / count(*) OVER (PARTITION BY rank_value))) AS score_p FROM meas),
dr AS (SELECT draw, score_p, rounds, k, CAST(('0x' || substr(md5('{_NOISE_SEED}|' || code_id), 1, 15)) AS BIGINT) + draw * {rng.STRIDE} AS cn,
              failures + 0.5::DOUBLE AS a, shots - failures + 0.5::DOUBLE AS b, NULL::DOUBLE AS gx, NULL::DOUBLE AS gy
       FROM it, (SELECT unnest(range({_B})) AS draw)),
{", ".join(_try_sql(i) for i in range(_TRIES))},
al AS ({" UNION ALL ".join(f"SELECT draw, score_p, rounds, k, gx / (gx + gy) AS p FROM g{i} WHERE gx IS NOT NULL AND gy IS NOT NULL" for i in range(_TRIES))}),
ra AS (SELECT draw, score_p, 1.0 - pow(1.0 - p, 1.0::DOUBLE / (rounds * k)) AS rate FROM al),
rk AS (SELECT draw, score_p, rank() OVER (PARTITION BY draw ORDER BY rate) - 1 AS below, count(*) OVER (PARTITION BY draw, rate) AS tie FROM ra),
rc AS (SELECT draw, sum(score_p * least(1.0, (10 - below)::DOUBLE / tie)) / 10 AS recall FROM rk WHERE below < 10 GROUP BY draw)
SELECT 'recall_at_30_of_top_10_label_noise_ceiling' AS metric, round(avg(recall), 9) AS mean, round(quantile_cont(recall, 0.05), 9) AS p05,
       round(quantile_cont(recall, 0.95), 9) AS p95, {_B} AS n_draws FROM rc""")
def label_noise_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.label_noise_ceiling(views.measurements(spark, sf), n_draws=_B, seed=_NOISE_SEED), "mean", "p05", "p95")
