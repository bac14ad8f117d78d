"""The screening tables as views over the warehouse tables, used by the catalog and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import scratch
from ..functions import identity, rates
from ..operators import ranks

VIEW_MIN_FAILURES = 6
VIEW_BATCH = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials and failures per part."""
    return (read(spark, sf_dir, "lineitem").groupBy("l_partkey")
            .agg(F.count(F.lit(1)).alias("shots"),
                 F.count_if(F.col("l_returnflag") == "R").alias("failures"),
                 F.sum("l_quantity").alias("decode_seconds")))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per part, with parameters derived from its columns."""
    part = read(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")

    def pair(i, j):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))

    l = (F.lit(2) + F.pmod(size, F.lit(3))).cast("int")
    m = (F.lit(2) + F.pmod(key, F.lit(4))).cast("int")
    a = F.array(pair(F.pmod(key, F.lit(3)), F.lit(0)), pair(F.lit(0), F.lit(1)),
                pair(F.pmod(size, F.lit(5)), F.lit(2)))
    b = F.array(pair(F.lit(0), F.pmod(size, F.lit(4))), pair(F.lit(1), F.lit(0)), pair(F.lit(2), F.pmod(key, F.lit(5))))
    out = part.select(
        "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice",
        F.concat(F.lit("bb_v1_"), F.regexp_replace("p_brand", "#", "")).alias("construction_program_id"),
        l.alias("l"), m.alias("m"), a.cast(identity.EXPS).alias("a_exps"), b.cast(identity.EXPS).alias("b_exps"),
        (F.lit(1) + F.pmod(size, F.lit(6))).cast("int").alias("k"),
        (F.lit(3) + F.pmod(size, F.lit(9))).cast("int").alias("d_upper"),
        (F.lit(1) + F.pmod(key, F.lit(8))).cast("int").alias("rounds"),
    )
    n = F.lit(2) * F.col("l") * F.col("m")
    return out.withColumn("n", n).withColumn("params_json", identity.canonical_params())


# The same columns as SQL, for the oracle.
POPULATION_SQL = """
pop0 AS (
  SELECT p_partkey, p_brand, p_type, p_size, p_retailprice,
         'bb_v1_' || replace(p_brand, '#', '') AS construction_program_id,
         CAST(2 + p_size % 3 AS INTEGER) AS l, CAST(2 + p_partkey % 4 AS INTEGER) AS m,
         CAST(1 + p_size % 6 AS INTEGER) AS k, CAST(3 + p_size % 9 AS INTEGER) AS d_upper,
         CAST(1 + p_partkey % 8 AS INTEGER) AS rounds,
         [[CAST(p_partkey % 3 AS INTEGER), 0], [0, 1], [CAST(p_size % 5 AS INTEGER), 2]] AS a_exps,
         [[0, CAST(p_size % 4 AS INTEGER)], [1, 0], [2, CAST(p_partkey % 5 AS INTEGER)]] AS b_exps
  FROM part),
pop AS (
  SELECT *, 2 * l * m AS n,
         '{"a_exps":[[' || a_exps[1][1] || ',' || a_exps[1][2] || '],[' || a_exps[2][1] || ',' || a_exps[2][2] || '],['
         || a_exps[3][1] || ',' || a_exps[3][2] || ']],"b_exps":[[' || b_exps[1][1] || ',' || b_exps[1][2] || '],['
         || b_exps[2][1] || ',' || b_exps[2][2] || '],[' || b_exps[3][1] || ',' || b_exps[3][2] || ']],"l":' || l
         || ',"m":' || m || '}' AS params_json
  FROM pop0)"""


def measurements(spark: SparkSession, sf_dir: str, min_failures: int = VIEW_MIN_FAILURES) -> DataFrame:
    """One labelled item per part that has trials."""
    items = read(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    # A part that failed every trial has no rate and is no measurement.
    per_part = counts(spark, sf_dir).filter(F.col("failures") < F.col("shots"))
    joined = items.join(scratch.shuffled(per_part), F.col("l_partkey") == key).select(
        key.cast("string").alias("code_id"), F.col("p_brand").alias("construction_program_id"),
        F.col("p_type").alias("family"), "p_size", "p_retailprice",
        (F.lit(12) + F.lit(2) * F.pmod(key, F.lit(31))).cast("int").alias("n"),
        (F.lit(1) + F.pmod(size, F.lit(6))).cast("int").alias("k"),
        (F.lit(3) + F.pmod(size, F.lit(9))).cast("int").alias("d_upper"),
        (F.lit(1) + F.pmod(key, F.lit(8))).cast("int").alias("rounds"),
        F.lit("protocol-a").alias("protocol_hash"), "shots", "failures", "decode_seconds")
    labels = rates.label_columns(min_failures=min_failures)
    # Twelve decimals, so that rates equal on paper tie here whatever a platform's pow rounds to.
    labels["true_ler"] = F.round(labels["true_ler"], 12)
    labels["true_ler_ub"] = F.round(labels["true_ler_ub"], 12)
    return (joined.withColumns(labels)
            .withColumns({"phi_from_d_upper": rates.phi(), "rank_value": rates.ranking_value()})
            .withColumns({"price_score": F.col("p_retailprice"), "size_score": -F.col("p_size").cast("double")}))


def measurements_sql(min_failures: int = VIEW_MIN_FAILURES) -> str:
    z = 1.959963984540054
    wilson = f"({z} * sqrt((failures/shots::DOUBLE)*(1-failures/shots::DOUBLE)/shots + {z*z}/(4.0*shots*shots)))"
    centre = f"((failures/shots::DOUBLE) + {z*z}/(2.0*shots))"
    denom = f"(1.0 + {z*z}/shots)"

    def rate(p):
        return f"CASE WHEN {p} = 0 THEN 0.0 ELSE 1.0 - pow(1.0 - {p}, 1.0/(rounds*k)) END"

    return f"""
counts AS (SELECT l_partkey, count(*) AS shots, count(*) FILTER (WHERE l_returnflag = 'R') AS failures,
                  sum(l_quantity) AS decode_seconds FROM lineitem GROUP BY l_partkey),
m0 AS (SELECT CAST(p_partkey AS VARCHAR) AS code_id, p_brand AS construction_program_id, p_type AS family,
              p_size, p_retailprice, CAST(12 + 2 * (p_partkey % 31) AS INTEGER) AS n,
              CAST(1 + p_size % 6 AS INTEGER) AS k, CAST(3 + p_size % 9 AS INTEGER) AS d_upper,
              CAST(1 + p_partkey % 8 AS INTEGER) AS rounds, shots, failures, decode_seconds
       FROM part JOIN counts ON l_partkey = p_partkey AND failures < shots),
m1 AS (SELECT *, greatest(0.0, {centre}/{denom} - {wilson}/{denom}) AS w_low,
              least(1.0, {centre}/{denom} + {wilson}/{denom}) AS w_high, failures < {min_failures} AS censored FROM m0),
meas AS (SELECT *, round(CASE WHEN NOT censored THEN {rate('(failures/shots::DOUBLE)')} END, 12) AS true_ler,
                round({rate('w_high')}, 12) AS true_ler_ub, {rate('w_low')} AS true_ler_ci_low, {rate('w_high')} AS true_ler_ci_high,
                k * d_upper * d_upper / n::DOUBLE AS phi_from_d_upper,
                round(CASE WHEN censored THEN {rate('w_high')} ELSE {rate('(failures/shots::DOUBLE)')} END, 12) AS rank_value,
                p_retailprice AS price_score, -CAST(p_size AS DOUBLE) AS size_score FROM m1)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial per event, numbered per user in time order."""
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return ranks.row_index(events, [F.col("ts").asc(), F.col("event_id").asc()], ["user_id"], "trial")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials grouped in batches of fixed size: one row per (item, batch index)."""
    t = trials(spark, sf_dir)
    return (t.withColumn("batch_index", F.floor(F.col("trial") / VIEW_BATCH).cast("long"))
            .groupBy(F.col("user_id").alias("item"), "batch_index")
            .agg(F.count(F.lit(1)).alias("batch_shots"),
                 F.count_if(F.col("event_type") == "error").alias("batch_failures"),
                 F.sum("value").alias("batch_decode_seconds"),
                 F.count_if(F.col("event_type") == "click").alias("batch_osd_invocations")))


BATCHES_SQL = f"""
trials AS (SELECT user_id, ts, event_id, event_type, value,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS trial FROM events),
batches AS (SELECT user_id AS item, CAST(trial // {VIEW_BATCH} AS BIGINT) AS batch_index, count(*) AS batch_shots,
                   count(*) FILTER (WHERE event_type = 'error') AS batch_failures,
                   sum(value) AS batch_decode_seconds,
                   count(*) FILTER (WHERE event_type = 'click') AS batch_osd_invocations
            FROM trials GROUP BY 1, 2)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bipartite graphs per region: suppliers as checks, parts as qubits, one side per line status."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linestatus")
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    where = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    rows = (li.join(where, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("n_regionkey").cast("string").alias("item"),
                    F.when(F.col("l_linestatus") == "O", "x").otherwise("z").alias("side"),
                    F.col("l_suppkey").alias("chk"), F.col("l_partkey").alias("qub")))
    return rows.repartition(ranks.tasks_for(li.count()), "item", "side", "qub").distinct()


EDGES_SQL = """
edges AS (SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS item, CASE WHEN l_linestatus = 'O' THEN 'x' ELSE 'z' END AS side,
                 l_suppkey AS chk, l_partkey AS qub
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def graph_vertices(spark: SparkSession, sf_dir: str, e: DataFrame | None = None) -> DataFrame:
    """Every (graph, kind, vertex) on both sides: a vertex of either side is one of the other, maybe of degree 0."""
    e = edges(spark, sf_dir) if e is None else e
    ends = F.explode(F.array(F.struct(F.lit("c").alias("kind"), F.col("chk").alias("v")),
                             F.struct(F.lit("q").alias("kind"), F.col("qub").alias("v")))).alias("end")
    tasks = ranks.tasks_for(2 * read(spark, sf_dir, "lineitem").count())
    both = e.select("item", ends).select("item", "end.kind", "end.v").repartition(tasks, "item", "kind", "v").distinct()
    return both.select("item", F.explode(F.array(F.lit("x"), F.lit("z"))).alias("side"), "kind", "v")


GRAPH_VERTICES_SQL = """
vertices AS (SELECT item, unnest(['x', 'z']) AS side, kind, v FROM (
               SELECT item, 'c' AS kind, chk AS v FROM edges UNION SELECT item, 'q', qub FROM edges))"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two treatments on the same trial: each labelled document, grouped by language."""
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", "lang")
    return labels.join(docs, "doc_id").select(
        F.col("lang").alias("item"), F.col("doc_id").alias("trial"),
        (F.col("quality") == 0).alias("fail_a"), (F.col("toxic") == 1).alias("fail_b"))


PAIRED_SQL = """
paired AS (SELECT lang AS item, labels.doc_id AS trial, quality = 0 AS fail_a, toxic = 1 AS fail_b
           FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"""


def fit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cost points: words against characters, by language."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("code_id"), "lang",
        F.size(F.split("text", " ")).cast("long").alias("size"), F.col("n_chars").cast("double").alias("seconds"))


FIT_SQL = """
fit AS (SELECT CAST(doc_id AS VARCHAR) AS code_id, lang, CAST(len(string_split(text, ' ')) AS BIGINT) AS size,
               CAST(n_chars AS DOUBLE) AS seconds FROM documents)"""
