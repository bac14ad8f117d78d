"""File inventories: every file's digest, and what a recorded inventory misses."""

from __future__ import annotations

import ctypes
import hashlib
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import scratch
from ..errors import Refused

#: Bytes of a file that a task reads.
BLOCK = 256 << 20
_PIECE = 8 << 20
_RELAY = "path string, n_bytes long, position long, state binary, sha256 string"


def _advance(path: str, n_bytes: int, position: int, state: bytes | None, block: int) -> tuple[int, bytes | None, str | None]:
    """Take the SHA-256 of a file one block on: where it stands then, the state of the digest, the digest at the end.

    The state is the library's own, 112 bytes of plain memory. Where the library shows none, the file is read to its end.
    """
    import _hashlib
    try:
        library = ctypes.CDLL(_hashlib.__file__)
        begin, update, finish = library.SHA256_Init, library.SHA256_Update, library.SHA256_Final
        context = ctypes.create_string_buffer(state or bytes(256), 256)
        if state is None:
            begin(context)
        end = min(n_bytes, position + block)
    except (AttributeError, OSError):
        whole, end = hashlib.sha256(), n_bytes
        update = lambda _, piece, size: whole.update(piece)
        context = finish = None
    with open(path, "rb") as file:
        file.seek(position)
        while position < end:
            piece = file.read(min(_PIECE, end - position))
            if not piece:
                raise Refused(f"{path} ends before its {n_bytes} bytes")
            update(context, piece, ctypes.c_size_t(len(piece)))
            position += len(piece)
    if position < n_bytes:
        return position, context.raw, None
    if finish is None:
        return position, None, whole.hexdigest()
    digest = ctypes.create_string_buffer(32)
    finish(digest, context)
    return position, None, digest.raw.hex()


def _relayed(files: DataFrame, block: int) -> DataFrame:
    """(path, n_bytes, sha256) of files larger than ``block``: a digest is a chain, so each task takes it one block on."""
    count, longest = files.agg(F.count(F.lit(1)), F.max("n_bytes")).first()

    def step(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                local = "/" + r.path.removeprefix("file:").lstrip("/")
                done = (r.position, r.state, r.sha256) if r.sha256 else _advance(local, r.n_bytes, r.position, r.state, block)
                rows.append((r.path, r.n_bytes, *done))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RELAY.split(", ")])
    at = files.select("path", "n_bytes", F.lit(0).cast("long").alias("position"), F.lit(None).cast("binary").alias("state"), F.lit(None).cast("string").alias("sha256"))
    for _ in range(-(-longest // block)):
        at = scratch.table(at.repartition(4 * count, "path").mapInPandas(step, _RELAY), "inventory")
    return at.select("path", "n_bytes", "sha256")


def inventory(spark: SparkSession, root: str, glob: str | None = None, block: int = BLOCK) -> DataFrame:
    """(path, n_bytes, sha256) of every file under ``root``, path relative to it; temporary files are left out.

    Files of the local or a mounted file system that are larger than ``block`` are read a block per task.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    files = reader.load(root).filter(~F.col("path").endswith(".tmp"))
    relative = F.substring_index(F.col("path"), base + "/", -1)
    digest = F.sha2("content", 256).alias("sha256")
    large = files.filter((F.col("length") > block) & F.col("path").startswith("file:")).select("path", F.col("length").alias("n_bytes"))
    if large.isEmpty():
        return files.select(relative.alias("path"), F.col("length").alias("n_bytes"), digest)
    small = files.filter(F.col("length") <= block)   # the reader compares lengths before it reads
    found = small.select("path", F.col("length").alias("n_bytes"), digest).unionByName(_relayed(large, block))
    return found.select(relative.alias("path"), "n_bytes", "sha256")


def missing_or_altered(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded files that are gone or no longer have their digest."""
    return recorded.select("path", "sha256").join(found.select("path", "sha256"), ["path", "sha256"], "left_anti")


def require_intact(recorded: DataFrame, found: DataFrame) -> None:
    gone = missing_or_altered(recorded, found)
    examples = [r["path"] for r in gone.orderBy("path").limit(5).collect()]
    if examples:
        raise Refused(f"{gone.count()} recorded files are missing or altered, e.g. {examples}")
