"""Mixing sources to target weights: complete epochs, then Efraimidis-Spirakis selection of the last, partial epoch.

Every document gets the key ``-ln(u) / weight``: ``u`` is a hash of its id, ``weight`` its quality. The order of the keys
within a source is a weighted sample without replacement, so a prefix of that order is the sample of a partial epoch.

No source is sorted as a whole. The keys of a source are cut into buckets of some thousand documents by a monotone
function of the key; sums per bucket tell in which single bucket the budget of the source ends, and only the documents
of that bucket are numbered by a window. All steps are DataFrame expressions.

Defined results: null text has size 0 and weight 1; the null source is a source of its own, last in order; documents
of size 0 are copied like the others and take no words; repeated rows count each; an empty table gives no rows; a
corpus without words gives target 0 everywhere. Columns of the input other than the named ones play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from .common import WORD

#: Characters that speak against running text; the weight of a document is its share of other characters. Fixed values.
NOISE = "0123456789#*$%&|<>!{}[]~^_=+\\"
SEED = "mix-1"
MAX_EPOCHS = 3
BUCKET_ROWS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of code points outside NOISE, at least 0.05; 1 for null and empty texts."""
    share = F.length(F.translate(text, NOISE, "")) / F.length(text)
    return F.greatest(F.lit(0.05), F.when(F.length(text) > 0, share).otherwise(F.lit(1.0)))


def selection_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its size, target, complete epochs and the words of its partial epoch.

    Targets share the total by weight, capped at ``max_epochs`` times the source's size. With sources ordered by
    cap / weight, the level is the first (total - caps before) / (weights from here) that its own source can take.
    """
    per = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"),
                                              F.avg("weight").alias("mean_weight"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("share", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("share"))
    order = Window.orderBy("ratio", "skey")
    upto, everything = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(everything) - (F.sum("cap").over(upto) - F.col("cap")))
                         / (F.sum("share").over(everything) - (F.sum("share").over(upto) - F.col("share"))))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))
    level = F.min(fits).over(everything)["level"]
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("share"), F.lit(0.0))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    return per.select("skey", "source_size", "mean_weight", "target", "epochs", "rest",
                      F.ceil(F.col("n_docs") / BUCKET_ROWS).cast("long").alias("buckets"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, epochs, copies, taken``, one row per input row."""
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        n_words(F.col(text_col)).alias("size"), quality_weight(F.col(text_col)).alias("weight"))
    skey = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sizes = scratch.table(sizes.withColumn("skey", skey)
                          .withColumn("key", selection_key(F.col("doc_id"), F.col("weight"), seed)), "mix-sizes")
    per = scratch.table(source_targets(sizes, weights, max_epochs), "mix-targets")
    spread = 1 - F.exp(-F.col("key") * F.col("mean_weight"))
    bucket = F.least(F.col("buckets") - 1, F.floor(spread * F.col("buckets")))
    placed = sizes.join(per, "skey").withColumn("bucket", bucket)
    run = Window.partitionBy("skey").orderBy("bucket")
    sums = placed.groupBy("skey", "bucket").agg(F.sum("size").alias("words"), F.min("rest").alias("rest"))
    sums = sums.withColumn("upto", F.sum("words").over(run))
    ends = (sums.filter(F.col("upto") > F.col("rest")).groupBy("skey")
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
            .select("skey", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before")))
    per = scratch.table(per.join(ends, "skey", "left"), "mix-ends")
    placed = sizes.join(per, "skey").withColumn("bucket", bucket)
    whole = placed.filter(F.col("end_bucket").isNull() | (F.col("bucket") != F.col("end_bucket")))
    whole = whole.withColumn("chosen", F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(True)))
    inside = Window.partitionBy("skey").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.filter(F.col("bucket") == F.col("end_bucket"))
    reach = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    cut = cut.withColumn("chosen", reach <= F.col("rest"))
    out = whole.unionByName(cut)
    copies = F.col("epochs") + F.when((F.col("rest") > 0) & F.col("chosen"), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies, with the columns of the input."""
    plan = mix(docs, id_col=id_col, **options).groupBy("doc_id").agg(F.max("copies").alias("__copies"))
    plan = plan.withColumnRenamed("doc_id", "__id")
    joined = docs.join(plan, docs[id_col].eqNullSafe(plan["__id"]))
    wanted = joined.filter(F.col("__copies") > 0)
    return wanted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
