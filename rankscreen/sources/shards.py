"""Batch shards: one file per (item, batch) as runs write them, or one compact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..schemas import SHARDS

_NAME = r"/([^/]+)/batch_(\d{6})\.parquet$"


def read_shards(spark: SparkSession, directory: str, schema: T.StructType = SHARDS) -> DataFrame:
    """Every ``<item>/batch_NNNNNN.parquet`` under a directory; item and file index come from the path.

    Other files are ignored. ``file_index`` is kept beside the stored ``batch_index`` for the sequence check.
    """
    raw = (spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "batch_*.parquet")
           .parquet(directory).withColumn("__path", F.col("_metadata.file_path")))
    item, index = F.regexp_extract("__path", _NAME, 1), F.regexp_extract("__path", _NAME, 2)
    return (raw.withColumn("item", item).filter("item != ''")
            .withColumn("file_index", index.cast("long")).drop("__path"))


def misplaced(shards: DataFrame) -> DataFrame:
    """Shards whose file name and stored index disagree, or files with more than one row."""
    return (shards.groupBy("item", "file_index")
            .agg(F.count(F.lit(1)).alias("n"), F.min("batch_index").alias("stored"))
            .filter("n != 1 or stored is null or stored != file_index"))


def compact(shards: DataFrame, path: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Rewrite many one-row files as one table, items kept together by hash bucket for pruning."""
    bucketed = shards.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
    bucketed.repartition("bucket", "item").write.mode(mode).partitionBy("bucket").parquet(path)


def read_compact(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(full).parquet(path).drop("bucket")
