"""Fixed-schema Parquet tables in and out."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..operators import guards

_EXCLUDED = "excluded_items"


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table with exactly these columns, in this order; anything else is refused before a row is read."""
    guards.exact_columns(spark.read.parquet(path), schema)
    return spark.read.schema(schema).parquet(path)


def column_total(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Sum of one column over every file under a path or glob; no other column is read."""
    return spark.read.parquet(path).agg(F.sum(column).alias(column))


def write_table(df: DataFrame, path: str, schema: T.StructType, *, key: str, tag: tuple[str, str] | None = None,
                forbidden_prefix: str | None = None) -> None:
    """Write once; refuses other columns, no rows, a repeated key, another version tag, or a table already there."""
    guards.exact_columns(df, schema)
    if forbidden_prefix:
        guards.column_policy(df, forbidden_prefix)
    checks = {"no rows": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0), f"{key} is null": guards.nulls(key)}
    if tag:
        checks[f"{tag[0]} is not {tag[1]}"] = guards.other_than(*tag)
    guards.enforce(guards.all_of(guards.counts(df, checks), guards.unique_key(df, key)))
    df.write.mode("errorifexists").parquet(path)


def with_exclusions(df: DataFrame, key: str, excluded: Mapping[str, str]) -> DataFrame:
    """Record the excluded ids and their reasons in the key column's metadata, which Parquet keeps."""
    return df.withMetadata(key, {_EXCLUDED: json.dumps(dict(sorted(excluded.items())))})


def exclusions(df: DataFrame, key: str) -> dict[str, str]:
    return json.loads(df.schema[key].metadata.get(_EXCLUDED, "{}"))


def reject_marked(df: DataFrame, column: str = "calibration") -> DataFrame:
    """Refuse a table that carries the marker column at all: its rows are not dataset rows."""
    if column in df.columns:
        raise Refused(f"a table with a {column!r} column is not dataset input")
    return df


def marked_rows(df: DataFrame, column: str = "calibration") -> DataFrame:
    """The rows whose marker is set, wherever the marker is a plain column."""
    return df.filter(F.coalesce(F.col(column).cast("boolean"), F.lit(False)))


def reject_marked_json(spark: SparkSession, directory: str, column: str = "calibration") -> None:
    """Refuse a directory in which any JSON document is marked; files that are not JSON do not count."""
    docs = (spark.read.schema(f"{column} boolean").option("multiLine", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.json").json(directory).select(column, F.col("_metadata.file_path").alias("path")))
    found = docs.filter(F.col(column)).limit(1).collect()
    if found:
        raise Refused(f"{found[0]['path']} is marked {column!r}; it is not dataset input")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_text(lines: DataFrame, path: str) -> None:
    """A report: one string column, in its own order."""
    lines.write.mode("errorifexists").text(path)
