import time

import numpy as np

from rankscreen.operators import trials
from rankscreen.streaming import shards as stream

SCHEMA = "item string, batch_index long, batch_shots long, batch_failures long, batch_osd_invocations long, batch_decode_seconds double, cpu_class string"
OPTIONS = {"batch_size": 10, "max_shots": 60, "min_failures": 9}


def rows():
    return [(f"i{k}", b, 10, (b * 3 + k) % 4, 0, 1.0, "c") for k in range(5) for b in range(8)]


def test_restarted_out_of_order_stream_equals_batch(spark, tmp_path):
    data = sorted(rows(), key=lambda r: (r[1] * 5 + 3) % 8)
    source, out, done = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for part in (data[:15], data[15:22], data[22:] + data[:4]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        s = stream.stop_items(stream.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema), **OPTIONS)
        stream.to_table(s, out, done).awaitTermination(120)
    kept = sorted(map(tuple, spark.read.parquet(f"{out}/kept").select("item", "batch_index", "shots", "failures").collect()))
    batch = trials.stop_batches(spark.createDataFrame(rows(), SCHEMA), min_failures=9, max_shots=60)
    assert kept == sorted(map(tuple, batch.select("item", "batch_index", "shots", "failures").collect()))
    refused = spark.read.parquet(f"{out}/refused")
    n_rows = len(data) + 4
    assert refused.count() == n_rows - len(kept) and refused.filter("status = 'duplicate'").count() > 0


def test_mixed_provenance_and_gap(spark, tmp_path):
    source, out, done = (str(tmp_path / n) for n in ("in", "out", "ck"))
    mixed = [("m", 0, 10, 1, 0, 1.0, "c"), ("m", 1, 10, 1, 0, 1.0, "other"), ("m", 2, 10, 1, 0, 1.0, "c"),
             ("g", 0, 10, 1, 0, 1.0, "c"), ("g", 2, 10, 1, 0, 1.0, "c")]
    spark.createDataFrame(mixed, SCHEMA).coalesce(1).write.parquet(source)
    s = stream.stop_items(stream.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema), **OPTIONS, gap_minutes=0.0001)
    q = stream.to_table(s, out, done, trigger={"processingTime": "1 second"})
    refused = set()
    try:
        for _ in range(60):
            time.sleep(1)
            if q.lastProgress is None or q.lastProgress["batchId"] < 1:
                continue
            refused = {(r["item"], r["batch_index"], r["status"]) for r in spark.read.parquet(f"{out}/refused").collect()}
            if ("g", 1, "gap") in refused:
                break
    finally:
        q.stop()
    assert {("m", 1, "foreign"), ("m", 2, "past_stop"), ("g", 1, "gap")} <= refused


def test_snapshots_equal_the_whole_count_after_every_trigger(spark, tmp_path):
    data = sorted(rows(), key=lambda r: (r[1] * 5 + 3) % 8)
    source, out, done = (str(tmp_path / n) for n in ("in", "out", "ck"))
    people = spark.createDataFrame([(f"i{k}",) for k in range(3)] + [("never",)], "code_id string")   # i3 and i4 are strangers
    schema = spark.createDataFrame([], SCHEMA).schema
    for at, part in enumerate((data[:9], data[9:24], data[24:], data[:3])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        s = stream.stop_items(stream.read_stream(spark, source, schema), **OPTIONS)
        stream.snapshots(s, people, out, done).awaitTermination(120)
        seen, ended = {}, set()
        for r in data[:(9, 24, 40, 40)[at]]:
            seen.setdefault(r[0], set()).add(r[1])
        ready = {i: [b for b in range(8) if set(range(b + 1)) <= got] for i, got in seen.items()}
        for i, own in ready.items():
            shots = fails = 0
            for b in own:
                shots, fails = shots + 10, fails + (b * 3 + int(i[1])) % 4
                if fails >= 9 or shots >= 60:
                    ended.add(i)
        members = {f"i{k}" for k in range(3)}
        want = {"done": len(ended & members), "partial": sum(bool(ready.get(i)) for i in members) - len(ended & members), "failed": 0, "row_error": 0}
        want["not_started"] = 4 - want["done"] - want["partial"]
        ids = [int(p.name.split("=")[1]) for p in (tmp_path / "out" / "snapshots").iterdir() if "=" in p.name]
        last = spark.read.parquet(f"{out}/snapshots/batch_id={max(ids)}")
        assert {r["state"]: r["n"] for r in last.collect()} == want
    assert want["done"] > 0


def test_each_batch_once_in_any_order_with_gaps_and_late_repeats(spark, tmp_path):
    source, out, done = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "item string, batch_index long, note string"
    parts = [[("a", 0, "1"), ("a", 1, "1"), ("a", 5, "1"), ("a", 5, "1"), ("b", -3, "1"), (None, 0, "1"), ("a", None, "1")],
             [("a", 4, "2"), ("a", 1, "2"), ("a", 6, "2"), ("b", 2, "2")], [("a", 3, "3"), ("a", 2, "3"), ("a", 0, "3"), ("b", -3, "3"), ("a", 6, "3")]]
    for part in parts:
        df = spark.createDataFrame(part, schema)
        df.coalesce(1).write.mode("append").parquet(source)
        stream.ingest(stream.each_batch_once(stream.read_stream(spark, source, df.schema)), out, done).awaitTermination(120)
    got = sorted(map(tuple, spark.read.schema(df.schema).parquet(out).collect()))
    assert got == [("a", 0, "1"), ("a", 1, "1"), ("a", 2, "3"), ("a", 3, "3"), ("a", 4, "2"), ("a", 5, "1"), ("a", 6, "2"), ("b", -3, "1"), ("b", 2, "2")]


def test_runs_join_where_they_touch():
    starts, ends = stream._runs_joined(np.array([0, 7, 3, 4]), np.array([3, 9, 4, 5]))
    assert starts.tolist() == [0, 7] and ends.tolist() == [5, 9]
    assert [x.tolist() for x in stream._runs_joined(np.zeros(0, int), np.zeros(0, int))] == [[], []]


def test_a_step_makes_one_frame_or_none(monkeypatch):
    """Accepted, late and repeated batches of an item leave in one frame, built once; a call without rows makes none."""
    class State:
        exists = hasTimedOut = False

        def update(self, value):
            self.exists, self.get = True, value

    made, real = [], stream.pd.DataFrame
    monkeypatch.setattr(stream.pd, "concat", lambda *a, **k: made.append("concat"))
    step, state = stream._stopper(10, 60, 9, None), State()
    batch = lambda indices: real({"batch_index": indices, "batch_shots": 10, "batch_failures": 0, "__provenance": ""})
    assert list(step(("i",), iter([batch([2, 3])]), state)) == []
    out = list(step(("i",), iter([batch([0, 1, 1, 9, 2])]), state))
    assert len(out) == 1 and not made
    assert out[0].sort_values(["status", "batch_index"])[["batch_index", "status"]].values.tolist() == [
        [1, "duplicate"], [2, "duplicate"], [0, "kept"], [1, "kept"], [2, "kept"], [3, "kept"], [9, "past_stop"]]
    assert out[0].loc[out[0].status == "kept", "shots"].tolist() == [10, 20, 30, 40] and set(out[0]["stopped_by"]) == {"running"}
