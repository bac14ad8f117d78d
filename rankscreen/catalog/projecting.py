"""Queries: cost projection from calibration cells."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import projection
from ..plans import views
from .core import query, rounded
from .measuring import TALLY_SQL, tally_cells

_CAP, _BATCH, _MIN = 40, 8, 5


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration cells per supplier, with a size and a program."""
    key = F.col("code_id").cast("long")
    return tally_cells(spark, sf).withColumns({
        "n": (F.lit(12) + F.lit(2) * F.pmod(key, F.lit(29))).cast("int"),
        "d_upper": (F.lit(3) + F.lit(2) * F.pmod(key, F.lit(5))).cast("int"),
        "construction_program_id": F.concat(F.lit("program-"), F.pmod(key, F.lit(25)))})


def population(spark: SparkSession, sf: str) -> DataFrame:
    part = views.read(spark, sf, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("code_id"), F.col("p_brand").alias("construction_program_id"),
        (F.lit(12) + F.lit(2) * F.pmod("p_partkey", F.lit(31))).cast("int").alias("n"),
        (F.lit(3) + F.pmod("p_size", F.lit(9))).cast("int").alias("d_upper"))


_CELLS = f"""{TALLY_SQL},
cl AS (SELECT *, CAST(12 + 2 * (code_id::BIGINT % 29) AS INTEGER) AS n, CAST(3 + 2 * (code_id::BIGINT % 5) AS INTEGER) AS d_upper,
              'program-' || (code_id::BIGINT % 25) AS construction_program_id FROM cells)"""
_POP = """pp AS (SELECT CAST(p_partkey AS VARCHAR) AS code_id, p_brand AS construction_program_id, CAST(12 + 2 * (p_partkey % 31) AS INTEGER) AS n,
              CAST(3 + p_size % 9 AS INTEGER) AS d_upper FROM part)"""
_FIT = """fitp AS (SELECT p, decoder, ln(n * rounds) AS x, decode_seconds / shots AS s, n * rounds AS size FROM cl WHERE shots > 0),
fit AS (SELECT p, decoder, CASE WHEN min(size) <> max(size) AND min(s) > 0 THEN regr_intercept(ln(s), x) ELSE ln(greatest(avg(s), 1e-12)) END AS a,
               CASE WHEN min(size) <> max(size) AND min(s) > 0 THEN regr_slope(ln(s), x) ELSE 0.0 END AS b, count(*) AS fit_codes FROM fitp GROUP BY 1, 2)"""


def _proj(pop, by="", caps=f"[{_CAP}]"):
    b = f"{by}, " if by else ""
    bq = f"z.{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""{_CELLS}, {_POP}, {_FIT},
rkd AS (SELECT *, row_number() OVER ({part}ORDER BY d_upper DESC, n DESC, code_id) AS rn, count(*) OVER ({part}) AS nn FROM {pop}),
sz AS (SELECT {b}d_upper, n, count(*) AS items, count(*) FILTER (rn <= ceil(nn / 3.0)) AS top_items FROM rkd GROUP BY ALL),
dz AS (SELECT DISTINCT d_upper, n FROM sz),
don AS (SELECT c.p, c.decoder, dz.d_upper, dz.n, min_by(c.code_id, (abs(c.d_upper - dz.d_upper), abs(c.n - dz.n), c.code_id)) AS donor
        FROM dz, cl c WHERE shots > 0 GROUP BY 1, 2, 3, 4),
caps AS (SELECT unnest({caps}::BIGINT[]) AS max_shots),
pj0 AS (SELECT {bq}z.d_upper, z.n, z.items, z.top_items, d.p, d.decoder, d.donor, c.shots AS ds, c.failures AS df, fit.a, fit.b, fit.fit_codes, caps.max_shots,
               exp(fit.a + fit.b * ln(z.n * z.d_upper)) AS sps, least(1.0, ((c.failures/c.shots::DOUBLE) + 3.8414588206941227/(2.0*c.shots))/(1.0 + 3.8414588206941227/c.shots)
                 + (1.959963984540054 * sqrt((c.failures/c.shots::DOUBLE)*(1-c.failures/c.shots::DOUBLE)/c.shots + 3.8414588206941227/(4.0*c.shots*c.shots)))/(1.0 + 3.8414588206941227/c.shots)) AS hi
        FROM sz z JOIN don d ON d.d_upper = z.d_upper AND d.n = z.n JOIN cl c ON c.p = d.p AND c.decoder = d.decoder AND c.code_id = d.donor
        JOIN fit ON fit.p = d.p AND fit.decoder = d.decoder, caps),
pj1 AS (SELECT *, CASE WHEN df > 0 THEN CAST(ceil({_MIN} * ds / df::DOUBLE) AS BIGINT) END AS est, CAST(ceil({_MIN} / hi) AS BIGINT) AS rlo FROM pj0),
pj2 AS (SELECT *, CASE WHEN df > 0 THEN est > max_shots WHEN rlo > max_shots THEN true END AS exc FROM pj1),
pj AS (SELECT *, CASE WHEN est IS NULL OR coalesce(exc, false) THEN max_shots ELSE least(CAST(ceil(est / {_BATCH}.0::DOUBLE) AS BIGINT) * {_BATCH}, max_shots) END AS rs,
              CASE WHEN est IS NULL OR coalesce(exc, false) THEN max_shots ELSE least(est, max_shots) END AS ru FROM pj2)"""


def _sum(by=""):
    b = f"{by}, " if by else ""

    def three(w, name):
        return (f"CAST(sum(CASE WHEN exc THEN {w} ELSE 0 END) AS BIGINT) AS {name}_censored, CAST(sum(CASE WHEN NOT exc THEN {w} ELSE 0 END) AS BIGINT) AS {name}_not_censored, "
                f"CAST(sum(CASE WHEN exc IS NULL THEN {w} ELSE 0 END) AS BIGINT) AS {name}_unknown, "
                f"round(sum(CASE WHEN exc THEN {w} ELSE 0 END) / sum({w})::DOUBLE, 9) AS {name}_censored_fraction")
    return f"""SELECT {b}p, decoder, max_shots, CAST(sum(items) AS BIGINT) AS population_codes, round(sum(items * rs * sps / 3600), 6) AS core_hours,
round(sum(items * ru * sps / 3600), 6) AS core_hours_unbatched, round(max(rs * sps / 3600), 9) AS max_code_core_hours, {three('items', 'all')}, {three('top_items', 'top')},
CAST(sum(top_items) AS BIGINT) AS top_codes, min(d_upper) FILTER (top_items > 0) AS top_d_upper_min, round(max(a), 9) AS a, round(max(b), 9) AS b, max(fit_codes) AS fit_codes"""


def _round_summary(df):
    df = rounded(df, "core_hours", "core_hours_unbatched", digits=6)
    return rounded(df, "max_code_core_hours", "all_censored_fraction", "top_censored_fraction", "a", "b")


_OPT = {"shot_batch": _BATCH, "min_failures": _MIN}


@query("power_law_fit", "A14 P19", f"""WITH {views.FIT_SQL}
SELECT lang, round(regr_intercept(ln(seconds), ln(size)), 9) AS a, round(regr_slope(ln(seconds), ln(size)), 9) AS b, count(*) AS fit_codes,
       round(exp(regr_intercept(ln(seconds), ln(size)) + regr_slope(ln(seconds), ln(size)) * ln(1000)), 6) AS at_1000 FROM fit GROUP BY lang""")
def power_law_fit(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import rates
    fit = projection.power_law_fit(views.fit_points(spark, sf), ["lang"])
    out = fit.withColumn("at_1000", rates.power_law("a", "b", F.lit(1000.0)))
    return rounded(rounded(out, "a", "b"), "at_1000", digits=6)


@query("nearest_donors", "J5", f"""WITH {_CELLS}, {_POP}
SELECT c.p, c.decoder, z.d_upper, z.n, min_by(c.code_id, (abs(c.d_upper - z.d_upper), abs(c.n - z.n), c.code_id)) AS donor
FROM (SELECT DISTINCT d_upper, n FROM pp) z, cl c WHERE shots > 0 GROUP BY 1, 2, 3, 4""")
def nearest_donors(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    sizes = projection._with_cell_groups(population(spark, sf).select("d_upper", "n").distinct(), c)
    return projection.nearest_donor(sizes, c)


@query("fit_brackets", "J6 M10", f"""WITH {_CELLS}, {_POP},
f AS (SELECT p, decoder, n * rounds::DOUBLE AS size, code_id AS name FROM cl WHERE shots > 0),
nm AS (SELECT p, decoder, size, min(name) AS f, max(name) AS l FROM f GROUP BY 1, 2, 3),
en AS (SELECT p, decoder, min_by(name, (size, name)) AS lo, max_by(name, (size, name)) AS hi FROM f GROUP BY 1, 2),
v AS (SELECT n * d_upper::DOUBLE AS size, count(*) AS items FROM pp GROUP BY 1),
b AS (SELECT en.p, en.decoder, v.size, items, lo, hi, (SELECT max(size) FROM nm WHERE nm.p = en.p AND nm.decoder = en.decoder AND nm.size <= v.size) AS pb,
             (SELECT min(size) FROM nm WHERE nm.p = en.p AND nm.decoder = en.decoder AND nm.size >= v.size) AS pa FROM v, en)
SELECT b.p, b.decoder, CASE WHEN pb IS NULL THEN 'below ' || lo WHEN pa IS NULL THEN 'above ' || hi WHEN x.l = y.f THEN x.l ELSE x.l || ' .. ' || y.f END AS bracket,
       CAST(sum(items) AS BIGINT) AS items
FROM b LEFT JOIN nm x ON x.p = b.p AND x.decoder = b.decoder AND x.size = pb LEFT JOIN nm y ON y.p = b.p AND y.decoder = b.decoder AND y.size = pa GROUP BY 1, 2, 3""")
def fit_brackets(spark: SparkSession, sf: str) -> DataFrame:
    return projection.bracket_counts(population(spark, sf), cells(spark, sf))


@query("population_projection", "M10 A11 A12 A14 J5 U3", f"WITH {_proj('pp')} {_sum()} FROM pj GROUP BY 1, 2, 3")
def population_projection(spark: SparkSession, sf: str) -> DataFrame:
    return _round_summary(projection.project_population(population(spark, sf), cells(spark, sf), caps=[_CAP], **_OPT))


@query("projected_items", "M10 J5", f"""WITH {_proj('pp')}
SELECT pp.code_id, pj.p, pj.decoder, donor, round(sps, 9) AS seconds_per_shot, exc AS exceeds_max_shots, rs AS run_shots FROM pp JOIN pj ON pj.d_upper = pp.d_upper AND pj.n = pp.n""")
def projected_items(spark: SparkSession, sf: str) -> DataFrame:
    out = projection.project_items(population(spark, sf), cells(spark, sf), caps=[_CAP], **_OPT)
    return rounded(out.select("code_id", "p", "decoder", "donor", "seconds_per_shot", "exceeds_max_shots", "run_shots"), "seconds_per_shot")


@query("outside_fit_range", "M10", f"""WITH {_CELLS}, {_POP},
e AS (SELECT p, decoder, min(n * rounds) AS lo, max(n * rounds) AS hi FROM cl WHERE shots > 0 GROUP BY 1, 2)
SELECT p, decoder, code_id, n * d_upper::DOUBLE AS n_d_upper FROM pp, e WHERE n * d_upper < lo OR n * d_upper > hi""")
def outside_fit_range(spark: SparkSession, sf: str) -> DataFrame:
    return projection.outside_fit(population(spark, sf), cells(spark, sf))


@query("reprojection_grid", "M13 J4 P24", f"""WITH {_proj('(SELECT *, unnest([24, 48, 72]) AS budget FROM pp) WHERE n <= budget', 'budget', '[20, 40, 80]')}
{_sum('budget')}, round(greatest(sum(items * rs * sps / 3600) / 4.0, max(rs * sps / 3600)), 6) AS wall_hours FROM pj GROUP BY budget, p, decoder, max_shots""")
def reprojection_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = projection.reprojection_grid(population(spark, sf), cells(spark, sf), [24, 48, 72], [20, 40, 80], 4, **_OPT)
    return rounded(_round_summary(out), "wall_hours", digits=6)


@query("named_pair", "J9", f"""WITH {_CELLS}
SELECT s.p, s.decoder, s.failures AS small_failures, s.shots AS small_shots, l.failures AS large_failures, l.shots AS large_shots,
       round(s.ler, 9) AS small_ler, round(s.ler_ci_low, 9) AS small_ler_ci_low, round(s.ler_ci_high, 9) AS small_ler_ci_high,
       round(l.ler, 9) AS large_ler, round(l.ler_ci_low, 9) AS large_ler_ci_low, round(l.ler_ci_high, 9) AS large_ler_ci_high,
       s.ler_ci_high < l.ler_ci_low OR l.ler_ci_high < s.ler_ci_low AS intervals_separate
FROM cl s JOIN cl l ON s.p = l.p AND s.decoder = l.decoder AND s.code_id = '1' AND l.code_id = '7'""")
def named_pair(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(projection.named_pair(cells(spark, sf), "1", "7"),
                   *[f"{s}_{c}" for s in ("small", "large") for c in ("ler", "ler_ci_low", "ler_ci_high")])


_READ = """rd AS (SELECT p, construction_program_id, count(*) AS n_items, min_by(ler_ci_low, (n, code_id)) AS sl, max_by(ler_ci_high, (n, code_id)) AS lh,
                 bool_and(ler_ci_low > p) AS every_interval_above_p FROM cl WHERE decoder = 'O' GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("threshold_readings", "A15", f"""WITH {_CELLS}, {_READ}
SELECT p, construction_program_id, n_items, lh < sl AS larger_separately_lower, every_interval_above_p, NOT (lh < sl) AND every_interval_above_p AS above_threshold FROM rd""")
def threshold_readings(spark: SparkSession, sf: str) -> DataFrame:
    return projection.threshold_readings(cells(spark, sf).filter("decoder = 'O'"))


@query("population_composition", "A20", f"""WITH {_CELLS}, {_POP}, {_READ},
b AS (SELECT *, unnest([24, 48, 72]) AS budget FROM pp), k AS (SELECT * FROM b WHERE n <= budget),
t AS (SELECT budget, count(*) AS codes, min(d_upper) AS d_upper_min, max(d_upper) AS d_upper_max FROM k GROUP BY 1),
s AS (SELECT budget, p, count(*) FILTER (NOT (lh < sl) AND every_interval_above_p) AS fl, count(*) AS rd
      FROM k JOIN rd ON 'program-' || (CAST(replace(k.construction_program_id, 'Brand#', '') AS BIGINT) % 25) = rd.construction_program_id GROUP BY 1, 2)
SELECT t.budget, p, codes, d_upper_min, d_upper_max, round(fl / codes::DOUBLE, 9) AS fraction_flagged, round((codes - rd) / codes::DOUBLE, 9) AS fraction_without_reading
FROM t JOIN s ON s.budget = t.budget""")
def population_composition(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import reconcile
    number = F.regexp_extract("construction_program_id", "([0-9]+)$", 1).cast("long")
    pop = population(spark, sf).withColumn("construction_program_id", F.concat(F.lit("program-"), F.pmod(number, F.lit(25))))
    pop = reconcile.grid(pop, budget=[24, 48, 72]).filter("n <= budget")
    flagged = projection.threshold_readings(cells(spark, sf).filter("decoder = 'O'"))
    return rounded(projection.composition(pop, flagged, ["budget"]), "fraction_flagged", "fraction_without_reading")


@query("probe_cost_report", "M12 A12 A13 J7 W10", f"""WITH {_proj('pp')},
me AS (SELECT CAST(l_partkey AS VARCHAR) AS code_id, count(*) AS shots, count(*) FILTER (l_returnflag = 'R') AS failures, sum(l_quantity / 1000) AS seconds,
              count(*) FILTER (l_returnflag = 'R') >= {_MIN} AS finished FROM lineitem WHERE l_discount > 0.05 GROUP BY 1),
t AS (SELECT pp.code_id, pp.d_upper, pp.n, sps, exc, rs, rs * sps / 3600 AS ch, shots, failures, seconds, finished, shots IS NOT NULL AS started,
             seconds / shots AS msps, failures / shots::DOUBLE AS mff,
             CASE WHEN finished THEN false WHEN shots IS NOT NULL THEN CASE WHEN failures > 0 THEN ceil({_MIN} * shots / failures::DOUBLE) > {_CAP}
               WHEN ceil({_MIN} / least(1.0, (3.8414588206941227/(2.0*shots))/(1.0 + 3.8414588206941227/shots) + (1.959963984540054*sqrt(3.8414588206941227/(4.0*shots*shots)))/(1.0 + 3.8414588206941227/shots))) > {_CAP} THEN true END END AS cens
      FROM pp JOIN pj ON pj.d_upper = pp.d_upper AND pj.n = pp.n AND pj.decoder = 'O' AND pj.p = 0.02 LEFT JOIN me ON me.code_id = pp.code_id),
r AS (SELECT quantile_cont(msps / sps, 0.5) AS med, max(msps / sps) AS mx, min(msps / sps) AS mn FROM t WHERE started),
st AS (SELECT *, CASE WHEN started THEN cens ELSE exc END AS status FROM t),
tp AS (SELECT * FROM st ORDER BY d_upper DESC, n DESC, code_id LIMIT (SELECT CAST(ceil(count(*) / 3.0) AS BIGINT) FROM t)),
lw AS (SELECT * FROM t WHERE started ORDER BY mff, code_id LIMIT (SELECT CAST(ceil(count(*) / 3.0) AS BIGINT) FROM t WHERE started))
SELECT count(*) AS codes, round(sum(ch), 6) AS projected, count(*) FILTER (status) AS all_censored, count(*) FILTER (status IS NULL) AS all_unknown,
       (SELECT round(med, 6) FROM r) AS ratio_median, (SELECT round(mx, 6) FROM r) AS ratio_max, (SELECT round(mn, 6) FROM r) AS ratio_min,
       (SELECT count(*) FROM tp) AS top_codes, (SELECT count(*) FILTER (status) FROM tp) AS top_censored, (SELECT count(*) FILTER (status IS NULL) FROM tp) AS top_unknown,
       (SELECT min(d_upper) FROM tp) AS top_d_upper_min, (SELECT count(*) FROM lw) AS lowest_codes, (SELECT count(*) FILTER (cens) FROM lw) AS lowest_censored,
       (SELECT count(*) FILTER (cens IS NULL) FROM lw) AS lowest_unknown,
       round(coalesce(sum(CASE WHEN finished THEN seconds ELSE msps * greatest(rs, shots) END) FILTER (started), 0) / 3600 + coalesce(sum(ch) FILTER (NOT started), 0) * (SELECT med FROM r), 6) AS reprojected_at_median,
       round(coalesce(sum(CASE WHEN finished THEN seconds ELSE msps * greatest(rs, shots) END) FILTER (started), 0) / 3600 + coalesce(sum(ch) FILTER (NOT started), 0) * (SELECT mx FROM r), 6) AS reprojected_at_max
FROM st""")
def probe_cost_report(spark: SparkSession, sf: str) -> DataFrame:
    at = projection.project_items(population(spark, sf), cells(spark, sf), caps=[_CAP], **_OPT).filter("decoder = 'O' and p = 0.02")
    measured = (views.read(spark, sf, "lineitem").filter("l_discount > 0.05").groupBy(F.col("l_partkey").cast("string").alias("code_id"))
                .agg(F.count(F.lit(1)).alias("shots"), F.count_if(F.col("l_returnflag") == "R").alias("failures"),
                     F.sum(F.col("l_quantity") / 1000).alias("seconds"))
                .withColumn("finished", F.col("failures") >= _MIN))
    out = projection.cost_report(at, measured, max_shots=_CAP, min_failures=_MIN)
    return rounded(out, "projected", "ratio_median", "ratio_max", "ratio_min", "reprojected_at_median", "reprojected_at_max", digits=6)
