import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankscreen import schemas, scratch
from rankscreen.errors import Refused
from rankscreen.functions import identity
from rankscreen.operators import guards, model, reconcile, splits
from rankscreen.plans import assembly
from rankscreen.sources import cells, inventory, shards, tables
from rankscreen.constants import TEMPLATES

COMMIT, P, VERSION = "ab" * 20, 0.002, "1.0"


def test_fixed_schema_and_single_write(spark, tmp_path):
    schema = schemas.PREDICTIONS
    df = spark.createDataFrame([("a", -3.0, 0, "v1"), ("b", -4.0, 1, "v1")], schema)
    path = str(tmp_path / "pred")
    tables.write_table(df, path, schema, key="code_id", tag=("model_version", "v1"), forbidden_prefix="true_")
    assert tables.read_table(spark, path, schema).count() == 2
    assert tables.column_total(spark, path, "pred_log10_ler").head()[0] == -7.0
    with pytest.raises(Exception):
        tables.write_table(df, path, schema, key="code_id")
    for bad in (df.select("fold", "code_id", "pred_log10_ler", "model_version"), df.limit(0), df.unionByName(df), df.withColumn("true_x", F.lit(1))):
        with pytest.raises(Refused):
            tables.write_table(bad, str(tmp_path / "no"), schema, key="code_id", forbidden_prefix="true_")
    with pytest.raises(Refused):
        tables.write_table(df, str(tmp_path / "no"), schema, key="code_id", tag=("model_version", "v2"))
    with pytest.raises(Refused):
        tables.read_table(spark, path, schemas.POPULATION)
    meta = tables.with_exclusions(df, "code_id", {"x": "unbuildable"})
    meta.write.parquet(str(tmp_path / "meta"))
    assert tables.exclusions(spark.read.parquet(str(tmp_path / "meta")), "code_id") == {"x": "unbuildable"}


def test_marked_input(spark, tmp_path):
    with pytest.raises(Refused):
        tables.reject_marked(spark.range(1).withColumn("calibration", F.lit(False)))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"other": 1}')
    (tmp_path / "notes.txt").write_text('{"calibration": true}')
    tables.reject_marked_json(spark, str(tmp_path))
    (tmp_path / "a" / "y.json").write_text('{\n "calibration": true\n}')
    with pytest.raises(Refused):
        tables.reject_marked_json(spark, str(tmp_path))


def test_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one").write_bytes(b"1")
    (tmp_path / "two.tmp").write_bytes(b"2")
    found = inventory.inventory(spark, str(tmp_path))
    got = spark.createDataFrame(found.collect(), found.schema)
    assert [(r["path"], r["n_bytes"]) for r in got.collect()] == [("d/one", 1)]
    inventory.require_intact(got, got)
    (tmp_path / "d" / "one").write_bytes(b"changed")
    with pytest.raises(Refused):
        inventory.require_intact(got, inventory.inventory(spark, str(tmp_path)))


def test_inventory_of_files_larger_than_a_block(spark, tmp_path):
    """A digest goes from task to task; 2 GB and more, which the reader of whole files refuses, included."""
    import hashlib
    for size in (999, 1000, 1001, 2000, 5003):
        (tmp_path / f"f {size}").write_bytes(bytes(i * 7 % 251 for i in range(size)))
    got = inventory.inventory(spark, str(tmp_path), block=1000).collect()
    assert {(r["path"], r["n_bytes"], r["sha256"]) for r in got} == {
        (f.name, f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.iterdir()}
    position, state, digest = inventory._advance(str(tmp_path / "f 5003"), 5003, 1000, None, 1000)
    assert position == 2000 and len(state) == 256 and digest is None   # no more than its block
    (tmp_path / "large").mkdir()
    with open(tmp_path / "large" / "f", "wb") as file:
        file.truncate((1 << 31) + 5)
    whole = hashlib.sha256()
    for _ in range(1 << 7):
        whole.update(bytes(1 << 24))
    whole.update(bytes(5))
    assert [tuple(r) for r in inventory.inventory(spark, str(tmp_path / "large")).collect()] == [("f", (1 << 31) + 5, whole.hexdigest())]


def test_cells_multi_line(spark, tmp_path):
    entry = {"failures": 3, "censored": True, "ler": None, "ler_ci_low": 0.1, "ler_ci_high": 0.2, "decode_seconds": 1.5, "ms_per_shot": 2.0}
    doc = {"calibration": True, "status": "completed", "p": 0.1, "code": {"code_id": "c", "name": "c", "n": 4, "k": 1, "d_upper": 2},
           "rounds": 2, "shots": 9, "stopped_by": "max_shots", "decoders": {"x": entry, "y": entry}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({**doc, "status": "killed", "decoders": None, "p": 0.2}, indent=2))
    c = cells.read_cells(spark, str(tmp_path))
    plan = spark.createDataFrame([(0.1, "c"), (0.2, "c")], "p double, code_id string")
    cells.require_own_cells(c, plan, ["y", "x"])
    assert cells.flatten(c).count() == 2 and cells.unfinished(c).head()["status"] == "killed"
    for bad_plan, names in ((plan.limit(1), ["x", "y"]), (plan, ["x"])):
        with pytest.raises(Refused):
            cells.require_own_cells(c, bad_plan, names)
    for i in (2, 1):
        (tmp_path / f"session_{i:03d}.json").write_text(json.dumps({"session": i, "kind": "probe"}, indent=1))
    assert [r["session"] for r in cells.read_sessions(spark, str(tmp_path)).collect()] == [1, 2]


def population(spark):
    rows = None
    for i, (name, a, b) in enumerate(TEMPLATES[:2]):
        r = spark.range(1).select(F.lit(f"bb_v1_{name}").alias("construction_program_id"), F.lit(3).alias("l"), F.lit(4 + i).alias("m"),
                                  identity.exps(a).alias("a_exps"), identity.exps(b).alias("b_exps"), F.lit(2).alias("k"), F.lit(4).alias("d_upper"))
        rows = r if rows is None else rows.unionByName(r)
    return assembly.population_table(rows)


def write_shards(spark, root, pop, batches, **changes):
    """One-row shard files, as a run leaves them."""
    ids = pop.select("code_id", identity.sampling_seed("code_id", identity.protocol_hash(F.lit(P), F.lit(VERSION))).alias("s")).orderBy("code_id").collect()
    names = [f.name for f in schemas.SHARDS]
    for row in ids:
        os.makedirs(f"{root}/{row['code_id']}", exist_ok=True)
        shots = fails = 0
        for i, f in enumerate(batches):
            shots, fails = shots + 10, fails + f
            rec = {"seed": row["s"], "batch_size": 10, "max_shots": 40, "batch_index": i, "batch_shots": 10, "batch_failures": f,
                   "batch_osd_invocations": 1, "batch_decode_seconds": 0.5, "batch_samples_sha256": "", "shots": shots, "failures": fails,
                   "samples_sha256": "", "commit_sha": COMMIT, "stim_version": "1", "cpu_class": "c"}
            rec.update(changes.get(f"b{i}", {}))
            kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int64() for f in schemas.SHARDS]
            pq.write_table(pa.table({n: pa.array([rec[n]], k) for n, k in zip(names, kinds)}), f"{root}/{row['code_id']}/batch_{i:06d}.parquet")
        with open(f"{root}/{row['code_id']}/result.parquet", "wb") as out:
            out.write(b"not a shard")
    return [r["code_id"] for r in ids]


OPTIONS = {"p": P, "decoder_version": VERSION, "batch_size": 10, "max_shots": 40, "min_failures": 9, "created_at": "2026-01-01T00:00:00+00:00"}


def test_assembly_end_to_end_and_refusals(spark, tmp_path):
    pop = population(spark)
    ids = write_shards(spark, str(tmp_path / "ok"), pop, [3, 3, 5])
    read = shards.read_shards(spark, str(tmp_path / "ok"))
    assert read.count() == 6 and shards.misplaced(read).count() == 0
    rows = assembly.assemble(pop, read, **OPTIONS)
    guards.exact_columns(rows, schemas.MEASUREMENTS)
    r = rows.orderBy("code_id").head()
    assert (r["shots"], r["failures"], r["censored"], r["family"], r["decode_seconds"]) == (30, 11, False, "BB", 1.5)
    shards.compact(read, str(tmp_path / "compact"), 4)
    assert shards.read_compact(spark, str(tmp_path / "compact"), read.schema).count() == 6
    with pytest.raises(Refused, match="has a result"):
        assembly.assemble(pop, read, {ids[0]: "why"}, **OPTIONS)
    with pytest.raises(Refused, match="not in the population"):
        assembly.assemble(pop, read, {"stranger": "why"}, **OPTIONS)
    with pytest.raises(Refused, match="unfinished"):
        assembly.assemble(pop, read.filter(F.col("item") == ids[0]), **OPTIONS)
    assert assembly.assemble(pop, read.filter(F.col("item") == ids[0]), {ids[1]: "why"}, **OPTIONS).count() == 1
    with pytest.raises(Refused, match="out of sequence"):
        assembly.assemble(pop, read.filter("batch_index != 1"), **OPTIONS)
    for field, value in (("cpu_class", "d"), ("commit_sha", None), ("seed", 5)):
        mixed = read.withColumn(field, F.when(F.col("batch_index") == 2, F.lit(value)).otherwise(F.col(field)))
        with pytest.raises(Refused, match=field):
            assembly.assemble(pop, mixed, **OPTIONS)
    with pytest.raises(Exception, match="real commit"):
        assembly.assemble(pop, read.withColumn("commit_sha", F.lit("0" * 40)), **OPTIONS)
    past = tmp_path / "past"
    write_shards(spark, str(past), pop, [5, 5, 1])
    with pytest.raises(Refused, match="past the stopping point"):
        assembly.assemble(pop, shards.read_shards(spark, str(past)), **OPTIONS)


def test_join_refusals(spark):
    a = spark.createDataFrame([("x", 1, 2.0), ("y", 2, 3.0)], "code_id string, n int, phi double")
    joined = reconcile.join_one_to_one(a.withColumn("m", F.lit(1)), a, "code_id", ["n"], ["phi"])
    assert joined.columns == ["code_id", "m", "n", "phi"] and joined.count() == 2
    with pytest.raises(Refused, match="1 only in left"):
        reconcile.join_one_to_one(a, a.limit(1), "code_id", ["n"], ["phi"])
    with pytest.raises(Refused, match="repeated"):
        reconcile.join_one_to_one(a.unionByName(a), a, "code_id", ["n"], ["phi"])
    with pytest.raises(Refused, match="phi differs"):
        reconcile.join_one_to_one(a, a.withColumn("phi", F.col("phi") * (1 + 1e-9)), "code_id", ["n"], ["phi"])
    with pytest.raises(Refused):
        reconcile.union_sources({"a": a, "b": a}, "code_id")


def test_folds_and_leakage(spark):
    sizes = [1, 3, 7, 12, 20, 40]
    df = spark.createDataFrame([(f"p{i}", j) for i, n in enumerate(sizes) for j in range(n)], "construction_program_id string, x int")
    for k in range(2, 7):
        folded = splits.with_folds(df, k)
        assert folded.count() == sum(sizes) and splits.leaking_groups(folded).count() == 0 and folded.select("fold").distinct().count() == k
    assert splits.leaking_groups(df.withColumn("fold", F.col("x") % 2)).count() > 0
    with pytest.raises(Refused):
        splits.assign_folds(df, 7)
    with pytest.raises(Refused):
        splits.assign_folds(df.withColumnRenamed("construction_program_id", "g"), 2)
    with pytest.raises(Refused):
        splits.assign_folds(df.unionByName(spark.createDataFrame([(None, 1)], df.schema)), 2)


def test_out_of_fold_covers_every_row(spark):
    rows = [(f"c{i}", f"p{i % 4}", i % 11 == 0, None if i % 11 == 0 else 10.0 ** (-1 - i % 5), float(i % 5), None if i % 3 else i) for i in range(80)]
    df = spark.createDataFrame(rows, "code_id string, construction_program_id string, censored boolean, true_ler double, d double, girth_x int")
    out = model.out_of_fold_predictions(df, ["d", "girth_x"], params={"maxIter": 3, "stepSize": 0.5, "maxDepth": 3, "seed": 0}).collect()
    assert len({r["code_id"] for r in out}) == len(out) == 80 and {r["fold"] for r in out} == {0, 1, 2, 3}
    only = df.withColumn("censored", F.col("construction_program_id") != "p0").withColumn("true_ler", F.when(~F.col("censored"), 0.1))
    with pytest.raises(Refused, match="no uncensored training row"):
        model.out_of_fold_predictions(only, ["d"], nullable=[])


def test_a_one_to_one_join_of_written_tables_is_not_broadcast(spark):
    """Their size on disk is far below that of their rows; a broadcast would pass one of them through the driver."""
    rows = spark.range(50).select(F.col("id").cast("string").alias("code_id"), F.col("id").alias("n"))
    a, b = scratch.table(rows, "a"), scratch.table(rows.withColumn("x", F.col("n") + 1), "b")
    plan = reconcile.join_one_to_one(a, b, "code_id", ("n",), ())._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
