import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from rankscreen.errors import Refused
from rankscreen.operators import guards, metrics, ranks, resample
from rankscreen.functions import rates, rng


def frame(spark, truth, score, censored=None):
    censored = censored or [False] * len(truth)
    rows = [(f"c{i:03d}", float(t), float(s), c) for i, (t, s, c) in enumerate(zip(truth, score, censored))]
    return spark.createDataFrame(rows, "code_id string, rank_value double, s double, censored boolean")


def value(df, metric, column="estimate"):
    return metrics.score_report(df, ["s"], metrics=[metric]).head()[column]


def test_hand_worked_ties(spark):
    df = frame(spark, [1e-4, 2e-4, 2e-4, 3e-4, 4e-4], [10, 5, 5, 5, 1])
    assert value(df, metrics.recall_metric(3, 2)) == pytest.approx(5 / 6)


def test_recall_is_the_mean_over_tie_breaks(spark):
    truth, score, k, n = [1, 1, 2, 2, 3], [3, 2, 2, 2, 1], 3, 2
    hits = []
    for a in itertools.permutations(range(5)):
        for b in itertools.permutations(range(5)):
            t = sorted(range(5), key=lambda i: (truth[i], a[i]))[:n]
            s = sorted(range(5), key=lambda i: (-score[i], b[i]))[:k]
            hits.append(len(set(t) & set(s)) / n)
    assert value(frame(spark, truth, score), metrics.recall_metric(k, n)) == pytest.approx(np.mean(hits))


def test_perfect_and_reversed(spark):
    rates_ = [1e-4 * (i + 1) for i in range(40)]
    assert value(frame(spark, rates_, [-x for x in rates_]), metrics.spearman_metric()) == pytest.approx(1)
    assert value(frame(spark, rates_, rates_), metrics.spearman_metric()) == pytest.approx(-1)
    assert value(frame(spark, rates_, rates_), metrics.recall_metric()) == 0
    assert value(frame(spark, rates_[:39], rates_[:39]), metrics.recall_metric()) == pytest.approx(0.1)


def test_undefined_values(spark):
    few = frame(spark, [1, 2, 3, 4, 5], [5, 4, 3, 2, 1], [True] * 4 + [False])
    row = metrics.score_report(few, ["s"], metrics=[metrics.spearman_metric()]).head()
    assert row["n_censored"] == 4 and row["excl_censored"] is None and row["estimate"] == pytest.approx(1)
    flat = metrics.score_report(frame(spark, [1, 2, 3], [1, 1, 1]), ["s"], metrics=[metrics.spearman_metric()])
    assert flat.head()["estimate"] is None
    with pytest.raises(Refused):
        metrics.require_defined(flat)
    with pytest.raises(Refused):
        metrics.recall_metric(0, 1)


def test_row_order_does_not_matter_and_a_custom_metric_works(spark):
    rng = random.Random(3)
    df = frame(spark, [rng.randrange(9) for _ in range(60)], [rng.randrange(5) for _ in range(60)])
    ties = metrics.Metric("tied_share", lambda x: F.sum(F.when(x.s_tie > 1, x.weight).otherwise(0)) / F.sum(x.weight))
    chosen = [*metrics.default_metrics(), ties]
    a = sorted(map(tuple, metrics.score_report(df, ["s"], metrics=chosen).collect()))
    b = sorted(map(tuple, metrics.score_report(df.orderBy(F.rand(5)).repartition(5), ["s"], metrics=chosen).collect()))
    assert len(a) == 3 and [r[:2] for r in a] == [r[:2] for r in b]
    assert [r[2] for r in a] == pytest.approx([r[2] for r in b])
    assert resample.bootstrap_replicates(df, "s", "s", n_resamples=3, metrics=chosen).filter("difference != 0").count() == 0


def test_shape_guards(spark):
    good = [("h", False, 0.1, 0.2), ("h", True, None, 0.3)]
    schema = "protocol_hash string, censored boolean, true_ler double, true_ler_ub double"
    checks = {**guards.single_protocol(), **guards.censoring_shape()}
    guards.enforce(guards.counts(spark.createDataFrame(good, schema), checks))
    for bad in (("g", False, 0.1, 0.2), (None, False, 0.1, 0.2), ("h", None, 0.1, 0.2), ("h", True, 0.1, 0.2),
                ("h", True, None, float("inf")), ("h", False, None, 0.2), ("h", False, float("nan"), 0.2)):
        with pytest.raises(Refused):
            guards.enforce(guards.counts(spark.createDataFrame([*good, bad], schema), checks))
    with pytest.raises(Refused):
        guards.enforce(guards.counts(spark.createDataFrame([], schema), guards.single_protocol()))


def test_bootstrap_paths_agree_and_ignore_partitioning(spark):
    rng = random.Random(4)
    df = frame(spark, [rng.randrange(30) for _ in range(80)], [rng.randrange(12) for _ in range(80)]).withColumn("t", F.col("rank_value") * -1)
    run = lambda d, rows: {tuple(r[:2]): r[2:] for r in resample.bootstrap_replicates(d, "s", "t", n_resamples=6, task_rows=rows).collect()}
    a, b, c = run(df, 1000), run(df, 0), run(df.repartition(6), 1000)
    assert a.keys() == b.keys() == c.keys() and len(a) == 12
    for k in a:
        assert a[k] == pytest.approx(b[k]) and a[k] == pytest.approx(c[k])


def test_beta_draws_have_the_right_moments(spark):
    for a, b in ((0.5, 20.5), (3.5, 7.5), (100.5, 40.5)):
        rows = resample.beta_draws(spark.range(40_000).select(F.xxhash64("id").alias("counter"), F.lit(a).alias("a"), F.lit(b).alias("b")))
        rows = rows.withColumnRenamed("p", "x")
        mean, var, lo, hi = rows.agg(F.avg("x"), F.variance("x"), F.min("x"), F.max("x")).head()
        want = a * b / ((a + b) ** 2 * (a + b + 1))
        assert mean == pytest.approx(a / (a + b), rel=0.03) and var == pytest.approx(want, rel=0.06) and 0 <= lo and hi <= 1


def test_label_noise_ceiling(spark):
    rows = [(f"c{i:02d}", 40_000, 100 * (i + 1), 6, 4) for i in range(40)]
    df = spark.createDataFrame(rows, "code_id string, shots long, failures long, rounds int, k int").withColumns(rates.label_columns())
    df = df.withColumn("rank_value", rates.ranking_value())
    clear = resample.label_noise_ceiling(df, n_draws=20).head()
    assert clear["mean"] == 1.0 and clear["p05"] == 1.0
    same = resample.label_noise_draws(df, n_draws=20).orderBy("draw").collect()
    assert same == resample.label_noise_draws(df.repartition(5), n_draws=20).orderBy("draw").collect()


def test_hopeless_items_are_not_drawn(spark, monkeypatch):
    """The ceiling equals one that makes every draw in full, of which it makes less than an eighth itself."""
    rows = [(f"c{i:04d}", 30 + i % 7, 1 + i * i % 23 if i % 40 else i % 3, 1 + i % 8, 1 + i % 6) for i in range(1200)]
    df = spark.createDataFrame(rows, "code_id string, shots long, failures long, rounds int, k int").withColumns(rates.label_columns())
    df = df.withColumn("rank_value", rates.ranking_value())
    made, whole = [], resample.beta_draws

    def counted(drawn, *keep):
        made.append(drawn.count())
        return whole(drawn, *keep)
    monkeypatch.setattr(resample, "beta_draws", counted)
    got = {r["draw"]: r["recall"] for r in resample.label_noise_draws(df, n_draws=30, seed=5).collect()}
    assert sum(made) < 30 * 1200 // 8
    base = ranks.with_top_probability(df, [], "rank_value", 30, "score_p").crossJoin(spark.range(30).withColumnRenamed("id", "draw"))
    base = base.withColumns({"counter": rng.random_int(F.lit(5), F.col("code_id")) + F.col("draw") * F.lit(rng.STRIDE),
                             "a": F.col("failures") + 0.5, "b": F.col("shots") - F.col("failures") + 0.5})
    drawn = [r for r in whole(base.select("draw", "score_p", "rounds", "k", "counter", "a", "b")).withColumn("rate", rates.rate_unchecked("p", "rounds", "k")).collect()]
    for draw in range(30):
        each = sorted((r["rate"], r["score_p"]) for r in drawn if r["draw"] == draw)
        assert len(each) == 1200 and each[9][0] < each[10][0]
        assert got[draw] == pytest.approx(sum(p for _, p in each[:10]) / 10)


def test_gamma_range_holds_for_every_try(spark):
    """No accepted point of a fine grid over normals and uniforms, their extremes included, lies outside the bounds."""
    shapes = [0.5, 0.9, 1.0, 1.5, 4.5, 7.5, 30.5, 400.5]
    got = resample.gamma_range(spark.createDataFrame([(a,) for a in shapes], "a double"), "a", "least", "most").collect()
    z, u = np.linspace(-resample._FAR, resample._FAR, 200_001), 2.0 ** -32
    for r in got:
        d = (r["a"] + 1 if r["a"] < 1 else r["a"]) - 1 / 3
        v = (1 + z / np.sqrt(9 * d)) ** 3
        v, near = v[v > 0], z[v > 0]
        v = v[np.log(u) < 0.5 * near * near + d - d * v + d * np.log(v)]
        back = u ** (1 / r["a"]) if r["a"] < 1 else 1.0
        assert 0 < r["least"] <= d * v.min() * back and r["most"] >= d * v.max()
    units = rng.with_units(spark.range(200).withColumn("n", F.col("id") * 678_152_731_007 + 5), "n", {"u": F.lit(4097).cast("long")}).collect()
    assert [r["u"] for r in units] == rng.units(np.array([r["n"] for r in units]), [4097])[0].tolist()


def test_replicates_of_many_items_write_no_draws(spark):
    """Items beyond what the planner broadcasts: packs of items are looked up in place, and only items reach the disk."""
    import inspect
    assert inspect.signature(resample.bootstrap_replicates).parameters["task_rows"].default > 1_200_000
    items = spark.range(70_000).select(F.col("id").alias("row_idx"), (F.col("id") % 7).cast("double").alias("truth"),
                                       F.when(F.col("id") % 5 > 0, F.col("id") * 2.0).alias("a"), F.col("id").cast("double").alias("b"))
    weights = spark.createDataFrame([(0, i, 1) for i in (0, 65_535, 65_536, 69_999)], "rep long, row_idx long, w long")
    got = sorted(tuple(r) for r in resample._looked_up(weights, items).collect())
    assert got == [(0, i, 1, float(i % 7), i * 2.0 if i % 5 else None, float(i)) for i in (0, 65_535, 65_536, 69_999)]


def test_draws_on_arrays_are_those_of_the_columns(spark):
    for n, bound in ((7, 5), (1_234, 1_000), (130_003, 99_991)):
        want = spark.range(n).select("id", rng.random_below(bound, F.lit(20261001), F.lit(37), F.col("id")).alias("x")).orderBy("id").collect()
        assert rng.ints_below(bound, n, 20261001, 37).tolist() == [r["x"] for r in want]
    with pytest.raises(ValueError):
        rng.ints_below(5, 10, "x" * 60)


def test_replicates_are_ranked_without_sorts(spark):
    """Standings of each replicate as windows give them, nulls first and NaN last, from a plan that has no window."""
    rows = [(i, float(i % 5), None if i % 4 == 0 else float(i % 7 - 3), float("nan") if i % 6 == 0 else -float(i % 3)) for i in range(90)]
    items = spark.createDataFrame(rows, "row_idx long, truth double, a double, b double")
    got = resample._task_standings(items, 90, 5, 11)
    want = resample.resample_weights(spark, 90, 5, 11).join(items, "row_idx")
    for c in ("truth", "a", "b"):
        upto, same = (Window.partitionBy("rep").orderBy(c).rangeBetween(x, Window.currentRow) for x in (Window.unboundedPreceding, Window.currentRow))
        want = want.withColumns({f"{c}_tie": F.sum("w").over(same), f"{c}_below": F.sum("w").over(upto) - F.sum("w").over(same)})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    scored = items.withColumn("code_id", F.col("row_idx").cast("string"))
    plan = resample.bootstrap_replicates(scored, "a", "b", truth="truth", n_resamples=5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
