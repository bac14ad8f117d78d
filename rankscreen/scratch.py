"""Intermediate tables in the cluster's shared folder.

A global sort order, an iterative graph state or a table that several jobs read is written once and read back, so
the lineage is cut and a lost executor never changes or repeats the work. The folder is the one the session names in
``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Otherwise shuffle files stay until the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_root: dict[str, str] = {}
_made: list[str] = []


def root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    existing = sc.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _local_root:
        _local_root[sc.applicationId] = tempfile.mkdtemp(prefix="spark-rankscreen-")
    return _local_root[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{root(spark)}/rankscreen/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it. The shuffle files behind it go as soon as it is written."""
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A join with ``df`` moves both sides: a table's compressed size on disk says little of its rows, which a broadcast would hold."""
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Delete the tables this process has made so far. Call it once every result that reads them is written."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
