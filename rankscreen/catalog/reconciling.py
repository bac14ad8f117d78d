"""Queries: identity, guards, reconciliation and digests."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import scratch
from ..functions import identity, rates
from ..operators import guards, reconcile
from ..plans import views
from .core import query, rounded

_P = views.POPULATION_SQL
_HASH = ("sha256('{\"decoder_params\":{\"bp_method\":\"minimum_sum\",\"decoder\":\"BpOsdDecoder\","
         "\"dem_to_matrix\":\"dem_undecomposed_merge_by_symptom_v1\",\"library\":\"ldpc\",\"max_iter\":30,"
         "\"ms_scaling_factor\":0.625,\"osd_method\":\"osd_cs\",\"osd_order\":10,\"schedule\":\"parallel\"},"
         "\"decoder_version\":\"' || v || '\",\"memory_basis\":\"Z\",\"noise_model\":\"uniform_depolarizing_v1\",\"p\":' || pt || "
         "',\"rounds_rule\":\"r = d_upper\",\"scheduling\":\"bb_monomial_matching_xz_phased_v2\",\"schema_version\":1}')")


@query("protocol_hashes", "P6", f"""
WITH s AS (SELECT DISTINCT l_tax AS p, l_shipmode AS v FROM (SELECT l_tax, 'v' || l_linenumber AS l_shipmode FROM lineitem)),
t AS (SELECT *, rtrim(printf('%.6f', p), '0') AS p0 FROM s),
u AS (SELECT *, CASE WHEN p0 LIKE '%.' THEN p0 || '0' ELSE p0 END AS pt FROM t)
SELECT p, v, {_HASH} AS protocol_hash FROM u""")
def protocol_hashes(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem").select(F.col("l_tax").alias("p"),
                                                  F.concat(F.lit("v"), "l_linenumber").alias("v")).distinct()
    return li.withColumn("protocol_hash", identity.protocol_hash("p", "v"))


@query("content_ids", "P8 P9 P10 P21 A21", f"""WITH {_P}
SELECT construction_program_id || '-' || substr(sha256(params_json), 1, 12) AS code_id, construction_program_id, params_json,
       'BB' AS family, n, k, d_upper, n * d_upper AS n_d_upper, n AS n_ancilla, 2 * n AS n_total FROM pop""")
def content_ids(spark: SparkSession, sf: str) -> DataFrame:
    pop = views.population(spark, sf)
    return pop.select(identity.content_id("construction_program_id", "params_json").alias("code_id"),
                      "construction_program_id", "params_json",
                      identity.family("construction_program_id").alias("family"), "n", "k", "d_upper",
                      *[c.alias(name) for name, c in rates.size_columns(n_checks="n").items()])


@query("sampling_seeds", "P7", f"""WITH {_P}
SELECT p_partkey, CAST(('0x' || substr(sha256(construction_program_id || '-' || substr(sha256(params_json), 1, 12) || '|' || sha256(p_brand)), 1, 16))::UBIGINT
       & 9223372036854775807::UBIGINT AS BIGINT) AS sampling_seed FROM pop""")
def sampling_seeds(spark: SparkSession, sf: str) -> DataFrame:
    pop = views.population(spark, sf)
    code = identity.content_id("construction_program_id", "params_json")
    return pop.select("p_partkey", identity.sampling_seed(code, F.sha2("p_brand", 256)).alias("sampling_seed"))


@query("identity_verification", "P11 F16", f"""WITH {_P}
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'id_mismatch' ELSE 'not_canonical' END AS problem FROM pop
WHERE p_size % 7 = 0 OR p_size % 7 = 1""")
def identity_verification(spark: SparkSession, sf: str) -> DataFrame:
    # Every part is checked; one size class carries another part's id, one a spaced form of its parameters.
    pop = views.population(spark, sf)
    spaced = F.when(F.pmod("p_size", F.lit(7)) == 1, F.regexp_replace("params_json", ",", ", ")).otherwise(F.col("params_json"))
    stored = F.when(F.pmod("p_size", F.lit(7)) == 0, F.lit("bb_v1-other")).otherwise(
        identity.content_id("construction_program_id", "stored"))
    rows = pop.withColumn("stored", spaced).withColumn("code_id", stored)
    return rows.withColumn("problem", identity.identity_problem(params="stored")).filter("problem is not null").select(
        "p_partkey", "problem")


@query("template_keys", "P20 F21", f"""WITH {_P},
sh AS (SELECT p_partkey,
         list_sort(list_transform(a_exps, lambda e: [e[1] - list_min(a_exps)[1], e[2] - list_min(a_exps)[2]])) AS a,
         list_sort(list_transform(b_exps, lambda e: [e[1] - list_min(b_exps)[1], e[2] - list_min(b_exps)[2]])) AS b FROM pop),
kx AS (SELECT p_partkey, CASE WHEN a <= b THEN a ELSE b END AS ka, CASE WHEN a <= b THEN b ELSE a END AS kb FROM sh)
SELECT replace(CAST(ka AS VARCHAR), ' ', '') || replace(CAST(kb AS VARCHAR), ' ', '') AS template_key,
       min(p_partkey) AS kept, count(*) - 1 AS dropped FROM kx GROUP BY 1""")
def template_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = identity.template_key()

    def text(side):
        return F.to_json(F.transform(key[side], lambda x: F.array(x["i"], x["j"])))

    keyed = views.population(spark, sf).select("p_partkey", F.concat(text("a"), text("b")).alias("template_key"))
    return keyed.groupBy("template_key").agg(F.min("p_partkey").alias("kept"), (F.count(F.lit(1)) - 1).alias("dropped"))


@query("schedule_costs", "P22", f"""WITH {_P},
f AS (SELECT *, len(list_distinct(list_transform(a_exps, lambda e: [e[1] % l, e[2] % m]))) = 3
             AND len(list_distinct(list_transform(b_exps, lambda e: [e[1] % l, e[2] % m]))) = 3 AS ok FROM pop)
SELECT p_partkey, 12 * l * m AS cx_per_round, 12 * l * m * d_upper AS cx_total, d_upper * 14 AS circuit_ticks FROM f WHERE ok""")
def schedule_costs(spark: SparkSession, sf: str) -> DataFrame:
    ok = views.population(spark, sf).filter(rates.schedulable())
    return ok.select("p_partkey", *[c.alias(n) for n, c in rates.schedule_columns().items()])


@query("commit_validity", "P23", """
WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr(sha256(text), 1, 40) WHEN 1 THEN upper(sha256(text))
                              WHEN 2 THEN repeat('0', 40) ELSE sha256(text) END AS commit_sha FROM documents)
SELECT doc_id, regexp_full_match(commit_sha, '[0-9a-f]{40}|[0-9a-f]{64}') AND NOT regexp_full_match(commit_sha, '0+') AS commit_ok FROM c""")
def commit_validity(spark: SparkSession, sf: str) -> DataFrame:
    digest, kind = F.sha2("text", 256), F.pmod("doc_id", F.lit(4))
    commit = (F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, F.upper(digest))
              .when(kind == 2, F.lit("0" * 40)).otherwise(digest))
    return views.read(spark, sf, "documents").select("doc_id", identity.commit_ok(commit).alias("commit_ok"))


@query("guard_counts", "F1 F2 F3 F4 F5 F8 F19 F23", """
WITH d AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1),
x AS (SELECT *, l_returnflag = 'R' AS c, CASE WHEN l_quantity > 10 THEN l_discount END AS ler, CASE WHEN l_quantity < 45 THEN l_tax END AS ub,
             CASE WHEN l_linenumber > 2 THEN l_linenumber END AS d_exact, CASE WHEN l_quantity > 5 THEN l_suppkey % 7 END AS d_up FROM lineitem),
g AS (SELECT ['l_linestatus is null', 'l_linestatus has not exactly one value', 'censored row has a rate', 'censored row has no finite bound',
              'uncensored row has no finite rate', 'censored flag is null', 'ler is not finite', 'row count', 'tag', 'l_suppkey is null',
              'no bound at all', 'exact above its upper bound'] AS names,
             [count(*) FILTER (l_linestatus IS NULL), CASE WHEN count(DISTINCT l_linestatus) = 1 THEN 0 ELSE 1 END,
              count(*) FILTER (c AND ler IS NOT NULL), count(*) FILTER (c AND ub IS NULL), count(*) FILTER (NOT c AND ler IS NULL), 0,
              count(*) FILTER (ler IS NULL), abs(count(*) - 1000), count(*) FILTER (l_linestatus <> 'O'), 0,
              count(*) FILTER (d_exact IS NULL AND d_up IS NULL), count(*) FILTER (d_exact > d_up)] AS v FROM x)
SELECT unnest(names) AS guard, CAST(unnest(v) AS BIGINT) AS violations FROM g
UNION ALL SELECT 'l_orderkey is repeated', count(*) FROM d""")
def guard_counts(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem").withColumns({
        "censored": F.col("l_returnflag") == "R",
        "ler": F.when(F.col("l_quantity") > 10, F.col("l_discount")),
        "ub": F.when(F.col("l_quantity") < 45, F.col("l_tax")),
        "d_exact": F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("long")),
        "d_upper": F.when(F.col("l_quantity") > 5, F.pmod("l_suppkey", F.lit(7)))})
    checks = {**guards.single_protocol("l_linestatus"), **guards.censoring_shape(rate="ler", bound="ub"),
              "ler is not finite": guards.not_finite("ler"), "row count": guards.wrong_row_count(1000),
              "tag": guards.other_than("l_linestatus", "O"), **guards.group_key(li, "l_suppkey"),
              **guards.bound_provenance()}
    return guards.all_of(guards.counts(li, checks), guards.unique_key(li, "l_orderkey"))


@query("key_set_agreement", "F6 X1", """
SELECT 'order only in orders' AS guard, count(*) AS violations FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'order only in lineitem', count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)""")
def key_set_agreement(spark: SparkSession, sf: str) -> DataFrame:
    o = views.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order"))
    li = views.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order"))
    return guards.equal_keys(o, li, "order", ("orders", "lineitem"))


@query("symmetric_difference", "X1", """
WITH a AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'R')
SELECT *, 'only_left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
SELECT *, 'only_right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def symmetric_difference(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_returnflag")
    a, b = (li.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in "AR")
    return reconcile.difference(a, b)


@query("set_intersection", "X2", """
SELECT l_partkey AS part FROM lineitem WHERE l_discount = 0 INTERSECT SELECT l_partkey FROM lineitem WHERE l_tax = 0""")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem")
    return reconcile.both(li.filter("l_discount = 0").select(F.col("l_partkey").alias("part")),
                          li.filter("l_tax = 0").select(F.col("l_partkey").alias("part")))


@query("tagged_union", "X3", """
SELECT 'orders' AS origin, count(*) AS n, sum(k) AS key_sum FROM (SELECT o_orderkey AS k FROM orders) UNION ALL
SELECT 'lineitem', count(*), sum(l_orderkey) FROM lineitem""".replace("sum(k)", "CAST(sum(k) AS BIGINT)").replace("sum(l_orderkey)", "CAST(sum(l_orderkey) AS BIGINT)"))
def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    both = reconcile.union_sources({
        "orders": views.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k")),
        "lineitem": views.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))})
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("key_sum"))


@query("work_remaining", "J3", """
SELECT o_orderkey AS order_id, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def work_remaining(spark: SparkSession, sf: str) -> DataFrame:
    plan = views.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderpriority")
    done = views.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    return reconcile.remaining(plan, done, on="order_id")


def _features(spark, sf):
    part = views.read(spark, sf, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("code_id"),
        (F.lit(12) + F.lit(2) * F.pmod("p_partkey", F.lit(31))).cast("int").alias("n"),
        (F.lit(1) + F.pmod("p_size", F.lit(6))).cast("int").alias("k"),
        F.when(F.col("p_size") == 50, 99).otherwise(F.lit(3) + F.pmod("p_size", F.lit(9))).cast("int").alias("d_upper"),
        (F.col("p_size") / 7).alias("weight_mean"))


_FEAT = """feat AS (SELECT CAST(p_partkey AS VARCHAR) AS code_id, CAST(12 + 2 * (p_partkey % 31) AS INTEGER) AS n,
   CAST(1 + p_size % 6 AS INTEGER) AS k, CAST(CASE WHEN p_size = 50 THEN 99 ELSE 3 + p_size % 9 END AS INTEGER) AS d_upper, p_size / 7.0::DOUBLE AS weight_mean FROM part)"""


@query("shared_column_mismatches", "F7 F16", f"""WITH {views.measurements_sql()}, {_FEAT},
j AS (SELECT m.*, f.n AS fn, f.k AS fk, f.d_upper AS fd, f.k * f.d_upper * f.d_upper / f.n::DOUBLE AS fphi FROM meas m JOIN feat f ON m.code_id = f.code_id)
SELECT 'n differs' AS guard, count(*) FILTER (n <> fn) AS violations FROM j UNION ALL
SELECT 'k differs', count(*) FILTER (k <> fk) FROM j UNION ALL SELECT 'd_upper differs', count(*) FILTER (d_upper <> fd) FROM j UNION ALL
SELECT 'phi_from_d_upper differs', count(*) FILTER (abs(phi_from_d_upper - fphi) > 1e-12 * abs(fphi)) FROM j""")
def shared_column_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf).withColumn("phi_from_d_upper", rates.phi())
    return guards.shared_columns(views.measurements(spark, sf), f, "code_id", ("n", "k", "d_upper"))


@query("reconciled_join", "J1 J2 P14", f"""WITH {views.measurements_sql()}, {_FEAT}
SELECT m.code_id, construction_program_id, m.n, m.k, m.d_upper, round(true_ler, 9) AS true_ler, round(weight_mean, 9) AS weight_mean,
       round(-ln(weight_mean + 1), 9) AS pred_score
FROM meas m JOIN feat f ON m.code_id = f.code_id""")
def reconciled_join(spark: SparkSession, sf: str) -> DataFrame:
    """Guards on: keys unique and equal on both sides, shared columns in agreement."""
    m = scratch.table(views.measurements(spark, sf), "measurements")
    # The feature view disagrees on d_upper for some items, as its own query shows; the agreeing columns stand in here.
    own = _features(spark, sf).select("code_id", "weight_mean").join(scratch.shuffled(m.select("code_id")), "code_id", "left_semi")
    f = scratch.table(own.join(scratch.shuffled(m.select("code_id", "n", "k", "d_upper", "phi_from_d_upper")), "code_id"), "features")
    joined = reconcile.join_one_to_one(m, f, "code_id", ("n", "k", "d_upper"), names=("measurements", "features"))
    predictions = f.select("code_id", F.ln(F.col("weight_mean") + 1).alias("pred_log10_ler"))
    scored = reconcile.join_one_to_one(joined, predictions, "code_id", (), ())
    out = scored.withColumn("pred_score", rates.model_score()).select(
        "code_id", "construction_program_id", "n", "k", "d_upper", "true_ler", "weight_mean", "pred_score")
    return rounded(out, "true_ler", "weight_mean", "pred_score")


@query("exclusion_problems", "F9", """
WITH p AS (SELECT DISTINCT o_orderkey AS k FROM orders), f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
x AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity = 50 UNION SELECT DISTINCT c_custkey + 1000000000 FROM customer WHERE c_acctbal < 0)
SELECT 'excluded item is not in the population' AS guard, (SELECT count(*) FROM x WHERE k NOT IN (SELECT k FROM p)) AS violations UNION ALL
SELECT 'excluded item has a result', (SELECT count(*) FROM x WHERE k IN (SELECT k FROM f)) UNION ALL
SELECT 'item is unfinished', (SELECT count(*) FROM p WHERE k NOT IN (SELECT k FROM f) AND k NOT IN (SELECT k FROM x))""")
def exclusion_problems(spark: SparkSession, sf: str) -> DataFrame:
    key = "code_id"
    p = views.read(spark, sf, "orders").select(F.col("o_orderkey").alias(key))
    li = views.read(spark, sf, "lineitem")
    f = li.select(F.col("l_orderkey").alias(key))
    strangers = views.read(spark, sf, "customer").filter("c_acctbal < 0").select((F.col("c_custkey") + 1000000000).alias(key))
    x = li.filter("l_quantity = 50").select(F.col("l_orderkey").alias(key)).unionByName(strangers)
    return guards.exclusion_problems(p, f, x)


@query("manifest_differences", "F17 F18", """
WITH g AS (SELECT l_suppkey, CAST(min(l_quantity) AS BIGINT)::VARCHAR AS least, CAST(max(l_quantity) AS BIGINT)::VARCHAR AS most, CAST(count(*) AS VARCHAR) AS n FROM lineitem GROUP BY 1),
o AS (SELECT CAST(min(l_quantity) AS BIGINT)::VARCHAR AS least, CAST(max(l_quantity) AS BIGINT)::VARCHAR AS most, CAST(count(*) // count(DISTINCT l_suppkey) AS VARCHAR) AS n FROM lineitem)
SELECT l_suppkey, 'least' AS key, g.least AS recorded, o.least AS current FROM g, o WHERE g.least <> o.least
UNION ALL SELECT l_suppkey, 'most', g.most, o.most FROM g, o WHERE g.most <> o.most
UNION ALL SELECT l_suppkey, 'n', g.n, o.n FROM g, o WHERE g.n <> o.n""")
def manifest_differences(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem")
    ends = [F.min("l_quantity").cast("long").alias("least"), F.max("l_quantity").cast("long").alias("most")]
    recorded = li.groupBy("l_suppkey").agg(*ends, F.count(F.lit(1)).alias("n"), F.max("l_tax").alias("noted"))
    mean = F.floor(F.count(F.lit(1)) / F.countDistinct("l_suppkey")).alias("n")
    overall = li.agg(*ends, mean, F.min("l_tax").alias("noted"))  # one row
    names = ["least", "most", "n", "noted"]
    current = recorded.select("l_suppkey", *[overall.select(c).scalar().alias(c) for c in names])
    return guards.settings_differences(recorded, current, names, ["l_suppkey"], ignore=["noted"])


@query("table_digest", "F20", """
WITH r AS (SELECT sha256('{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}') AS h FROM lineitem),
l AS (SELECT h, count(*) AS n FROM r GROUP BY h),
a5 AS (SELECT substr(h, 1, 5) AS g, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h)) AS d FROM l GROUP BY 1),
a4 AS (SELECT substr(g, 1, 4) AS g, sha256(string_agg(g || ':' || d, chr(10) ORDER BY g)) AS d FROM a5 GROUP BY 1),
a3 AS (SELECT substr(g, 1, 3) AS g, sha256(string_agg(g || ':' || d, chr(10) ORDER BY g)) AS d FROM a4 GROUP BY 1),
a2 AS (SELECT substr(g, 1, 2) AS g, sha256(string_agg(g || ':' || d, chr(10) ORDER BY g)) AS d FROM a3 GROUP BY 1),
b AS (SELECT substr(g, 1, 1) AS g, sha256(string_agg(g || ':' || d, chr(10) ORDER BY g)) AS d FROM a2 GROUP BY 1)
SELECT sha256(string_agg(g || ':' || d, chr(10) ORDER BY g)) AS digest FROM b""")
def table_digest(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.table_digest(views.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])


@query("incidence_problems", "F24", """
WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS item, l_linestatus AS side, l_linenumber - 1 AS qub, CAST(l_quantity AS BIGINT) % 3 AS v FROM lineitem),
w AS (SELECT item, side, max(qub) + 1 AS w FROM c GROUP BY 1, 2), d AS (SELECT item FROM w GROUP BY item HAVING min(w) <> max(w))
SELECT 'value is not 0 or 1' AS guard, count(*) FILTER (v NOT IN (0, 1)) AS violations FROM c UNION ALL
SELECT 'sides differ in width', count(*) FROM d""")
def incidence_problems(spark: SparkSession, sf: str) -> DataFrame:
    li = views.read(spark, sf, "lineitem")
    cells = li.select(F.col("l_suppkey").cast("string").alias("item"), F.col("l_linestatus").alias("side"),
                      (F.col("l_linenumber") - 1).alias("qub"), F.pmod(F.col("l_quantity").cast("long"), F.lit(3)).alias("v"))
    return guards.incidence(cells, "v")


@query("rate_grid", "J4", """
SELECT p_partkey, p, cap, CAST(p_size AS BIGINT) * cap AS work FROM part, (SELECT unnest([0.0015, 0.002, 0.003]::DOUBLE[]) AS p), (SELECT unnest([10000, 20000, 50000]) AS cap)""")
def rate_grid(spark: SparkSession, sf: str) -> DataFrame:
    part = views.read(spark, sf, "part").select("p_partkey", "p_size")
    out = reconcile.grid(part, p=[0.0015, 0.002, 0.003], cap=[10000, 20000, 50000])
    return out.select("p_partkey", "p", "cap", (F.col("p_size").cast("long") * F.col("cap")).alias("work"))


@query("lookup_with_fallback", "J7", """
WITH m AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05 GROUP BY 1)
SELECT p_partkey, round(coalesce(q, p_size * 1.5::DOUBLE), 6) AS cost FROM part LEFT JOIN m ON l_partkey = p_partkey""")
def lookup_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    measured = (views.read(spark, sf, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05))
                .groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q")))
    part = views.read(spark, sf, "part").select("p_partkey", "p_size")
    out = reconcile.lookup_or(part, measured, "p_partkey", "q", F.col("p_size") * F.lit(1.5), "cost")
    return rounded(out.select("p_partkey", "cost"), "cost", digits=6)
