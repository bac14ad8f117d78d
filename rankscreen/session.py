"""A local session for tests, checks and the benchmark. On a cluster the session comes from spark-submit."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus: str | None = None) -> SparkSession:
    """``$SCRATCH_DIR`` names the shared scratch folder; one machine's own temporary folder serves where it is not set."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{n}]").appName("rankscreen")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             .config("spark.checkpoint.dir", os.environ.get("SCRATCH_DIR") or tempfile.mkdtemp(prefix="spark-"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped_to: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for those whose Python path lacks it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped_to:
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    handle, path = tempfile.mkstemp(prefix="rankscreen-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        for top, _, files in os.walk(folder):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    packed.write(full, os.path.relpath(full, os.path.dirname(folder)))
    sc.addPyFile(path)
    _shipped_to.add(sc.applicationId)
