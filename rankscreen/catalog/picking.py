"""Queries: orderings, listings, bounded picks and seeded samples."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rng
from ..operators import sampling
from ..plans import views
from .core import query, rounded

_M = views.measurements_sql()
_BUDGET, _SEED = 72, 7


def _rand(*parts):
    key = " || '|' || ".join(parts)
    return f"CAST(('0x' || substr(md5({key}), 1, 15)) AS BIGINT)"


@query("size_listing", "W3", f"""WITH {_M}
SELECT construction_program_id, code_id, d_upper, n, censored, row_number() OVER (PARTITION BY construction_program_id ORDER BY d_upper, n, code_id) - 1 AS position,
       round(CASE WHEN NOT censored THEN true_ler END, 9) AS true_ler, round(CASE WHEN NOT censored THEN true_ler_ci_low END, 9) AS true_ler_ci_low,
       round(true_ler_ub, 9) AS true_ler_ub FROM meas""")
def size_listing(spark: SparkSession, sf: str) -> DataFrame:
    m = views.measurements(spark, sf).select("construction_program_id", "code_id", "d_upper", "n", "censored", "true_ler",
                                             "true_ler_ci_low", "true_ler_ub")
    out = sampling.listing(m, "construction_program_id", ["d_upper", "n", "code_id"], ["true_ler", "true_ler_ci_low"])
    return rounded(out, "true_ler", "true_ler_ci_low", "true_ler_ub")


def _pop(spark, sf):
    return views.measurements(spark, sf).select(
        "code_id", "construction_program_id", "n", "d_upper", (F.col("n") * F.col("d_upper")).alias("n_d_upper"), "shots",
        "failures", "rank_value", (F.col("failures") / F.col("shots")).alias("failure_fraction"))


@query("longest_first", "W7", f"""WITH {_M}
SELECT code_id, n * d_upper AS n_d_upper, row_number() OVER (ORDER BY n * d_upper DESC, code_id) - 1 AS position FROM meas""")
def longest_first(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.longest_first(_pop(spark, sf).select("code_id", "n_d_upper"))


@query("evenly_spaced_probe", "W4", f"""WITH {_M},
o AS (SELECT code_id, n * d_upper AS n_d_upper, row_number() OVER (ORDER BY n * d_upper DESC, code_id) - 1 AS position, count(*) OVER () AS nn FROM meas),
t AS (SELECT DISTINCT (2 * i * (nn - 1) + 11) // 22 AS position FROM (SELECT DISTINCT nn FROM o), (SELECT unnest(range(12)) AS i))
SELECT code_id, n_d_upper, position FROM o WHERE position IN (SELECT position FROM t)""")
def evenly_spaced_probe(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.evenly_spaced(_pop(spark, sf).select("code_id", "n_d_upper"), 12)


@query("top_third_by_size", "W5", f"""WITH {_M},
o AS (SELECT code_id, d_upper, n, row_number() OVER (ORDER BY d_upper DESC, n DESC, code_id) AS rn, count(*) OVER () AS nn FROM meas)
SELECT code_id, d_upper, n FROM o WHERE rn <= ceil(nn / 3.0)""")
def top_third_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.top_third_by_size(_pop(spark, sf).select("code_id", "d_upper", "n"))


@query("best_items", "W9", f"""WITH {_M}
SELECT code_id, round(rank_value, 9) AS rank_value FROM (SELECT * FROM meas ORDER BY meas.rank_value, code_id LIMIT 10)""")
def best_items(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sampling.best_items(_pop(spark, sf).select("code_id", "rank_value"), 10), "rank_value")


@query("lowest_failure_third", "W10", f"""WITH {_M},
o AS (SELECT code_id, failures / shots::DOUBLE AS failure_fraction, row_number() OVER (ORDER BY failures / shots::DOUBLE, code_id) AS rn, count(*) OVER () AS nn FROM meas)
SELECT code_id, round(failure_fraction, 9) AS failure_fraction FROM o WHERE rn <= ceil(nn / 3.0)""")
def lowest_failure_third(spark: SparkSession, sf: str) -> DataFrame:
    out = sampling.lowest_failing(_pop(spark, sf).select("code_id", "failure_fraction"), third_only=True)
    return rounded(out, "failure_fraction")


@query("spanning_selection", "W8", f"""WITH RECURSIVE {_M},
lim AS (SELECT min(d_upper) AS lo, max(d_upper) AS hi FROM meas),
picks AS (SELECT 0 AS i, []::VARCHAR[] AS ids UNION ALL
          SELECT i + 1, list_append(ids, min_by(code_id, (abs(d_upper - (lo + (hi - lo) * i / 5.0)), n, code_id)))
          FROM picks, meas, lim WHERE i < 6 AND NOT list_contains(ids, code_id) GROUP BY i, ids)
SELECT code_id, d_upper, n, CAST(list_position(ids, code_id) - 1 AS INTEGER) AS pick FROM meas, picks WHERE i = 6 AND list_contains(ids, code_id)""")
def spanning_selection(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.spanning(_pop(spark, sf).select("code_id", "d_upper", "n"), 6)


def _templates(spark, sf):
    part = views.read(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("template"), F.col("p_brand").alias("construction_program_id"))


def _candidates(spark, sf):
    return _judged(sampling.candidate_grid(_templates(spark, sf), _BUDGET))


def _judged(grid):
    at = [F.col("template"), F.col("l"), F.col("m")]
    grid = grid.withColumns({"k": rng.random_below(7, F.lit("k"), *at).cast("int"),
                             "d_upper": (F.lit(1) + rng.random_below(9, F.lit("d"), *at)).cast("int")})
    return grid.withColumn("cause", sampling.rejection_cause())


_CAND = f"""
ls AS (SELECT unnest(range(2, {_BUDGET} // 4 + 1)) AS l),
g0 AS (SELECT p_partkey AS template, p_brand AS construction_program_id, l, unnest(range(2, {_BUDGET} // (2 * l) + 1)) AS m FROM part, ls),
g1 AS (SELECT *, 1.0::DOUBLE / (({_BUDGET} // 4 - 1) * ({_BUDGET} // (2 * l) - 1)) AS weight,
              CAST({_rand("'k'", "template", "l", "m")} % 7 AS INTEGER) AS k, CAST(1 + {_rand("'d'", "template", "l", "m")} % 9 AS INTEGER) AS d_upper FROM g0),
cand AS (SELECT *, CASE WHEN k < 1 THEN 'k<1' WHEN d_upper < 3 THEN 'd_upper<3' END AS cause FROM g1)"""


@query("candidate_grid", "G2 F11", f"""WITH {_CAND}
SELECT template, CAST(l AS INTEGER) AS l, CAST(m AS INTEGER) AS m, round(weight, 12) AS weight, k, d_upper, cause FROM cand""")
def candidate_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_candidates(spark, sf).drop("construction_program_id"), "weight", digits=12)


@query("admission_counts", "F11 A7", f"""WITH {_CAND}
SELECT construction_program_id, count(*) FILTER (cause IS NULL) AS accepted, count(*) FILTER (cause = 'k<1') AS rejected_k,
       count(*) FILTER (cause = 'd_upper<3') AS rejected_d FROM cand GROUP BY 1""")
def admission_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.admission_counts(_candidates(spark, sf), _templates(spark, sf))


_WALK = f"""{_CAND},
w AS (SELECT *, -ln(({_rand(f"'{_SEED}'", "construction_program_id", "template", "l", "m")} + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE) / weight AS walk_key FROM cand)"""


@query("weighted_walk", "W11", f"""WITH {_WALK}
SELECT construction_program_id, template, CAST(l AS INTEGER) AS l, CAST(m AS INTEGER) AS m,
       row_number() OVER (PARTITION BY construction_program_id ORDER BY walk_key, template, l, m) - 1 AS walk_position FROM w""")
def weighted_walk(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ranks
    key = ["template", "l", "m"]
    w = sampling.weighted_order(_candidates(spark, sf), "construction_program_id", key, _SEED)
    w = w.select("construction_program_id", *key, "walk_key")
    return ranks.row_index(w, [F.col("walk_key").asc(), *[F.col(c).asc() for c in key]], ["construction_program_id"],
                           "walk_position").drop("walk_key")


# Nine tenths of what is admissible, and one: small strata run out, and both splits leave a remainder.
_COUNT = "(SELECT c FROM wanted)"
_BALANCED = f"""{_WALK},
wanted AS (SELECT count(*) FILTER (cause IS NULL) * 9 // 10 + 1 AS c FROM w),
cap AS (SELECT construction_program_id, count(*) FILTER (cause IS NULL) AS capacity,
               {_rand(f"'{_SEED}'", "'quota'", "construction_program_id")} AS h FROM w GROUP BY 1),
lv AS (SELECT lvl FROM (SELECT unnest(range({_COUNT} + 1)) AS lvl), cap GROUP BY lvl HAVING sum(least(capacity, lvl)) <= {_COUNT} ORDER BY lvl DESC LIMIT 1),
q0 AS (SELECT *, row_number() OVER (ORDER BY h, construction_program_id) - 1 AS first_rank, count(*) OVER () AS n_strata FROM cap),
op AS (SELECT construction_program_id, row_number() OVER (ORDER BY h, construction_program_id) - 1 AS open_rank FROM cap, lv WHERE capacity > lvl),
ex AS (SELECT {_COUNT} - sum(least(capacity, lvl)) AS extra FROM cap, lv),
quo AS (SELECT q0.construction_program_id, capacity, CAST({_COUNT} // n_strata + CASE WHEN first_rank < {_COUNT} % n_strata THEN 1 ELSE 0 END AS BIGINT) AS first_quota,
               CAST(least(capacity, lvl) + CASE WHEN open_rank < extra THEN 1 ELSE 0 END AS BIGINT) AS quota, lvl
        FROM q0 LEFT JOIN op ON op.construction_program_id = q0.construction_program_id, lv, ex),
acc AS (SELECT *, row_number() OVER (PARTITION BY construction_program_id ORDER BY walk_key, template, l, m) AS rn FROM w WHERE cause IS NULL),
pk AS (SELECT a.* FROM acc a JOIN quo q ON a.construction_program_id = q.construction_program_id AND rn <= quota)"""


def _balanced(spark, sf):
    candidates = _candidates(spark, sf)
    wanted = candidates.filter("cause is null").count() * 9 // 10 + 1
    return sampling.balanced_sample(candidates, _templates(spark, sf), "construction_program_id", ["template", "l", "m"], wanted, _SEED)


@query("balanced_sample", "W12", f"""WITH {_BALANCED}
SELECT construction_program_id, template, CAST(l AS INTEGER) AS l, CAST(m AS INTEGER) AS m,
       {_rand(f"'{_SEED}'", "'shuffle'", "construction_program_id", "template", "l", "m")} AS order_key FROM pk""")
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    picks, _ = _balanced(spark, sf)
    return picks.select("construction_program_id", "template", "l", "m", "order_key")


@query("balanced_sample_report", "W12 A7", f"""WITH {_BALANCED},
la AS (SELECT construction_program_id, max(walk_key) AS lk FROM pk GROUP BY 1),
e AS (SELECT *, capacity < greatest(first_quota, quota) OR (quota = capacity AND capacity < lvl) AS exhausted FROM quo),
s AS (SELECT w.construction_program_id, w.cause FROM w JOIN e ON e.construction_program_id = w.construction_program_id
      LEFT JOIN la ON la.construction_program_id = w.construction_program_id WHERE exhausted OR walk_key <= lk),
c AS (SELECT construction_program_id, count(*) AS attempts, count(*) FILTER (cause = 'k<1') AS rejected_k,
             count(*) FILTER (cause = 'd_upper<3') AS rejected_d FROM s GROUP BY 1)
SELECT e.construction_program_id, first_quota, quota, exhausted, coalesce(attempts, 0) AS attempts, coalesce(rejected_k, 0) AS rejected_k,
       coalesce(rejected_d, 0) AS rejected_d FROM e LEFT JOIN c ON c.construction_program_id = e.construction_program_id""")
def balanced_sample_report(spark: SparkSession, sf: str) -> DataFrame:
    _, report = _balanced(spark, sf)
    return report


@query("uniform_draws", "W13", f"""WITH {_CAND},
t AS (SELECT template, row_number() OVER (ORDER BY template) - 1 AS ti, count(*) OVER () AS nt FROM (SELECT DISTINCT template FROM cand)),
a AS (SELECT attempt, {_rand("'11'", "'t'", "attempt")} % (SELECT count(*) FROM t) AS ti, 2 + {_rand("'11'", "'l'", "attempt")} % ({_BUDGET} // 4 - 1) AS l
      FROM (SELECT unnest(range((SELECT 20 * count(*) + 1000 FROM part))) AS attempt)),
b AS (SELECT attempt, ti, l, 2 + {_rand("'11'", "'m'", "attempt")} % ({_BUDGET} // (2 * l) - 1) AS m FROM a),
c AS (SELECT attempt, cand.template, b.l, b.m, row_number() OVER (ORDER BY attempt) - 1 AS draw FROM b JOIN t ON t.ti = b.ti
      JOIN cand ON cand.template = t.template AND cand.l = b.l AND cand.m = b.m AND cause IS NULL)
SELECT attempt, draw, template, CAST(l AS INTEGER) AS l, CAST(m AS INTEGER) AS m FROM c WHERE draw < (SELECT count(*) FROM part)""")
def uniform_draws(spark: SparkSession, sf: str) -> DataFrame:
    count = views.read(spark, sf, "part").count()
    return sampling.uniform_draws(_templates(spark, sf), lambda drawn: _judged(drawn).filter("cause is null"), "template", count, _BUDGET, 11)
