"""Batch shards as a stream: ingest, duplicate removal, stateful stopping, quarantine and snapshots.

Checkpoints and sinks live in paths the caller gives. Every sink is keyed by the micro-batch, so a batch that is run
again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import MAX_SHOTS, MIN_FAILURES, PROVENANCE_FIELDS, SHOT_BATCH
from ..operators import trials

_COUNTS = ("batch_index", "batch_shots", "batch_failures")
OUTPUT = ("item string, batch_index bigint, status string, shots bigint, failures bigint, stopped_by string")
_STATE = ("next bigint, shots bigint, failures bigint, stopped string, provenance string, "
          "waiting array<bigint>, waiting_shots array<bigint>, waiting_failures array<bigint>, waiting_source array<string>")


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def without_repeats(stream: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Each (item, batch) once; a repeat inside the watermark's delay is dropped."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["item", "batch_index"])


def _runs_joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open runs of indices, touching ones made one; the runs given do not overlap."""
    order = np.argsort(starts)
    starts, ends = starts[order], ends[order]
    opens = np.r_[True, starts[1:] != ends[:-1]] if len(starts) else np.zeros(0, bool)
    return starts[opens], ends[np.r_[opens[1:], True]] if len(ends) else ends


def each_batch_once(stream: DataFrame) -> DataFrame:
    """Each (item, batch_index) once, however late a repeat comes: the first row that arrived, with all its columns.

    An item's state is the runs of indices it has seen: one run up to its high-water mark, and one more per gap, so
    it does not grow with the batches of an item that arrive in full. Of equal indices in one micro-batch any one stays.
    Rows without an item or index are left out. Without a watermark nothing expires and no late row is lost.
    """
    schema = stream.schema

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends = (np.asarray(x, np.int64) for x in (state.get if state.exists else ([], [])))
        for frame in frames:
            came = frame["batch_index"].to_numpy(np.int64)
            at = np.searchsorted(starts, came, "right") - 1
            seen = (at >= 0) & (came < ends[at]) if len(ends) else np.zeros(len(came), bool)
            first = np.zeros(len(came), bool)
            first[np.unique(came, return_index=True)[1]] = True
            fresh = came[first & ~seen]
            if len(fresh):
                yield frame[first & ~seen]
                starts, ends = _runs_joined(np.r_[starts, fresh], np.r_[ends, fresh + 1])
        state.update((starts.tolist(), ends.tolist()))

    rows = stream.filter("item is not null and batch_index is not null").select(*schema.names)
    return rows.groupBy("item").applyInPandasWithState(
        step, schema, "starts array<bigint>, ends array<bigint>", "append", GroupStateTimeout.NoTimeout)


def _stopper(batch_size: int, max_shots: int, min_failures: int, gap_ms: int | None):
    last_index = -(-max_shots // batch_size) - 1

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, shots, failures, stopped, provenance, *waiting = state.get if state.exists else (0, 0, 0, "", "", [], [], [], [])
        out = []

        def emit(index, status, shots=shots, failures=failures, stopped_by=None):
            index = np.atleast_1d(index)
            if len(index):
                values = status, shots, failures, stopped or "running" if stopped_by is None else stopped_by
                out.append((index, *(np.broadcast_to(np.asarray(v, object if isinstance(v, str) else None), index.shape) for v in values)))

        if state.hasTimedOut and len(waiting[0]):
            emit(nxt, "gap")
        index, n, fails = (np.asarray(w, np.int64) for w in waiting[:3])
        source = np.asarray(waiting[3], object)
        for frame in frames:
            came = frame[_COUNTS[0]].to_numpy(np.int64)
            known = (came < nxt) | np.isin(came, index)
            late = ~known & (bool(stopped) | (came > last_index))
            first = np.zeros(len(came), bool)
            first[np.unique(came, return_index=True)[1]] = True
            fresh = ~known & ~late & first
            emit(came[late], "past_stop")
            emit(came[~late & ~fresh], "duplicate")
            index, n, fails, source = (np.concatenate([old, frame[c].to_numpy()[fresh].astype(old.dtype)])
                                       for old, c in zip((index, n, fails, source), (*_COUNTS, "__provenance")))
        order = np.argsort(index)
        index, n, fails, source = index[order], n[order], fails[order], source[order]
        if len(index) and not stopped:
            ready = int((np.cumprod(index == nxt + np.arange(len(index)))).sum())
            provenance = provenance or (source[0] if ready else "")
            own = int(np.cumprod(source[:ready] == provenance).sum())
            run_shots, run_fails = shots + np.cumsum(n[:own]), failures + np.cumsum(fails[:own])
            ends = np.flatnonzero((run_fails >= min_failures) | (run_shots >= max_shots))
            kept = int(ends[0]) + 1 if len(ends) else own
            if kept:
                shots, failures = int(run_shots[kept - 1]), int(run_fails[kept - 1])
            if len(ends):
                stopped = "min_failures" if failures >= min_failures else "max_shots"
            reasons = np.full(kept, "running", object)
            if stopped:
                reasons[-1] = stopped
            emit(index[:kept], "kept", run_shots[:kept], run_fails[:kept], reasons)
            nxt += kept
            if not stopped and own < ready:
                stopped = "mixed_provenance"
                emit(index[own], "foreign", shots, failures)
                kept += 1
            index, n, fails, source = index[kept:], n[kept:], fails[kept:], source[kept:]
        if stopped:
            emit(index, "past_stop", shots, failures)
            index, n, fails, source = index[:0], n[:0], fails[:0], source[:0]
        state.update((nxt, shots, failures, stopped, provenance, index.tolist(), n.tolist(), fails.tolist(), source.tolist()))
        if len(index) and gap_ms is not None:
            state.setTimeoutDuration(gap_ms)
        # One frame a call: a frame costs far more than the few rows of an item. Without rows none is made.
        if out:
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pd.DataFrame(dict(zip(("item", "batch_index", "status", "shots", "failures", "stopped_by"), ([key[0]] * len(columns[0]), *columns))))

    return step


def stop_items(stream: DataFrame, *, batch_size: int = SHOT_BATCH, max_shots: int = MAX_SHOTS,
               min_failures: int = MIN_FAILURES, gap_minutes: float | None = None) -> DataFrame:
    """Running totals and the stop per item, whatever order its batches arrive in.

    A batch waits in the item's state until the ones before it are in; at most cap / batch size of them can wait,
    because an index beyond the cap is refused on arrival. With ``gap_minutes``, a batch still waiting after that long
    emits a 'gap' row for the missing index; that needs a stream that keeps running, so leave it out for a catch-up run
    over what is already there. The first accepted batch fixes the provenance; another one stops the item.
    """
    fields = [f for f in PROVENANCE_FIELDS if f in stream.columns]
    source = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}) if fields else F.lit("")
    rows = stream.select(F.col("item").cast("string").alias("item"), *_COUNTS, source.alias("__provenance"))
    return rows.groupBy("item").applyInPandasWithState(
        _stopper(batch_size, max_shots, min_failures, None if gap_minutes is None else max(1, int(gap_minutes * 60_000))),
        OUTPUT, _STATE, "append",
        GroupStateTimeout.NoTimeout if gap_minutes is None else GroupStateTimeout.ProcessingTimeTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, *, quarantine: tuple[str, ...] = ("foreign", "past_stop", "duplicate", "gap"),
             trigger: dict | None = None) -> StreamingQuery:
    """Write kept rows and refused rows to ``path/kept`` and ``path/refused``, one folder per micro-batch."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        refused = F.col("status").isin(*quarantine)
        batch.filter(~refused).write.mode("overwrite").parquet(f"{path}/kept/batch_id={batch_id}")
        batch.filter(refused).write.mode("overwrite").parquet(f"{path}/refused/batch_id={batch_id}")
        batch.unpersist()

    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def ingest(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append new shards to a compact table exactly once; the file sink's log makes restarts safe."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def transitions(rows: DataFrame) -> DataFrame:
    """Signed changes of item states, from rows of ``stop_items``: (item, state, change).

    An item's first kept batch takes it from not_started to partial and its stopping one from partial to done; each of
    them is emitted once in the item's life, so what was seen before need not be read.
    """
    kept = F.col("status") == "kept"
    move = lambda old, new: F.array(F.struct(F.lit(old).alias("state"), F.lit(-1).alias("change")),
                                    F.struct(F.lit(new).alias("state"), F.lit(1).alias("change")))
    none = F.array().cast("array<struct<state:string,change:int>>")
    first = F.when(kept & (F.col("batch_index") == 0), move("not_started", "partial")).otherwise(none)
    last = F.when(kept & F.col("stopped_by").isin("min_failures", "max_shots"), move("partial", "done")).otherwise(none)
    return rows.select("item", F.explode(F.concat(first, last)).alias("m")).select("item", "m.state", "m.change")


def snapshots(stream: DataFrame, population: DataFrame, path: str, checkpoint: str, *, members_only: bool = False,
              trigger: dict | None = None) -> StreamingQuery:
    """A state count of the whole population after every trigger: the count before it plus the batch's transitions.

    A trigger reads its own rows and the five rows of the snapshot before, never the history; a batch that is run again
    replaces its own snapshot. Items outside the population are left out, which scans the population's ids at each
    trigger; ``members_only`` promises that there are none and saves that scan.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        moves = transitions(batch)
        if not members_only:
            moves = moves.join(population.select(F.col("code_id").alias("item")).distinct(), "item", "left_semi")
        if batch_id == 0:
            before = population.agg(F.count(F.lit(1)).alias("n")).select(F.lit("not_started").alias("state"), "n")
        else:
            before = spark.read.parquet(f"{path}/snapshots/batch_id={batch_id - 1}")
        rows = before.unionByName(moves.groupBy("state").agg(F.sum("change").alias("n")))
        cells = [F.struct(F.lit(s).alias("state"), F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).cast("long").alias("n"))
                 for s in trials.STATES]
        counts = rows.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.state", "c.n")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/snapshots/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
