import math

import pytest
from pyspark.sql import functions as F

from rankscreen.errors import Refused
from rankscreen.operators import projection, sampling


def test_fill_level_is_the_even_split():
    for caps in ([3, 10, 10], [1, 1, 1], [0, 5, 9, 9], [4]):
        hist = {c: caps.count(c) for c in caps}
        for wanted in range(sum(caps) + 1):
            level, extra = sampling.fill_level(hist, wanted)
            assert sum(min(c, level) for c in caps) + extra == wanted and extra <= sum(c > level for c in caps)
        with pytest.raises(Refused):
            sampling.fill_level(hist, sum(caps) + 1)


def test_spanning(spark):
    d = [3, 3, 4, 6, 6, 8, 12]
    df = spark.createDataFrame([(f"c{i}", x, 10 + i) for i, x in enumerate(d)], "code_id string, d_upper int, n int")
    picks = [(r["code_id"], r["d_upper"]) for r in sampling.spanning(df, 3).orderBy("pick").collect()]
    assert picks[0][0] == "c0" and [x for _, x in picks] == [3, 8, 12]
    assert sampling.spanning(df, 7).count() == 7 and sampling.spanning(df, 0).count() == 0
    with pytest.raises(Refused):
        sampling.spanning(df, 8)


def test_evenly_spaced_has_both_ends(spark):
    df = spark.range(25).select(F.format_string("c%02d", "id").alias("code_id"), F.col("id").alias("n_d_upper"))
    got = sorted(r["n_d_upper"] for r in sampling.evenly_spaced(df, 12).collect())
    assert len(got) == 12 and got[0] == 0 and got[-1] == 24
    assert sampling.evenly_spaced(df, 1).head()["n_d_upper"] == 24 and sampling.evenly_spaced(df, 99).count() == 25


def test_balanced_sample_is_distinct_and_stable(spark):
    t = spark.createDataFrame([(i, f"p{i % 3}") for i in range(6)], "template long, construction_program_id string")
    grid = sampling.candidate_grid(t, 40).withColumns({"k": F.lit(1), "d_upper": F.when(F.col("construction_program_id") == "p0", F.col("l")).otherwise(5)})
    grid = grid.withColumn("cause", F.when((F.col("d_upper") < 3) | ((F.col("construction_program_id") == "p0") & (F.col("m") > 2)), "d_upper<3"))
    assert math.isclose(grid.filter("template = 0").agg(F.sum("weight")).head()[0], 1.0)
    args = (t, "construction_program_id", ["template", "l", "m"], 47, 3)
    picks, report = sampling.balanced_sample(grid, *args)
    again, _ = sampling.balanced_sample(grid.repartition(5), *args)
    key = ["template", "l", "m"]
    a = sorted(map(tuple, picks.select(*key).collect()))
    assert len(a) == len(set(a)) == 47 and a == sorted(map(tuple, again.select(*key).collect()))
    rows = {r["construction_program_id"]: r for r in report.collect()}
    capacity = grid.filter("cause is null and construction_program_id = 'p0'").count()
    assert rows["p0"]["exhausted"] == (capacity < 15) and sum(r["quota"] for r in rows.values()) == 47
    with pytest.raises(Refused):
        sampling.balanced_sample(grid, *args[:3], 10_000, 3)


CELL = "p double, decoder string, code_id string, n int, d_upper int, rounds int, shots long, failures long, decode_seconds double"


def test_projection_closed_form(spark):
    # Seconds per trial are (n d)^2 / 1e6 exactly, so the fitted law is exact.
    cells = spark.createDataFrame([(0.1, "x", "a", 10, 2, 2, 1000, 100, 0.4), (0.1, "x", "b", 30, 4, 4, 1000, 10, 14.4)], CELL)
    population = spark.createDataFrame([("p0", 10, 2), ("p1", 20, 3), ("p2", 30, 4), ("p3", 50, 4)], "code_id string, n int, d_upper int")
    rows = {r["code_id"]: r for r in projection.project_items(population, cells, caps=[20_000], shot_batch=256).collect()}
    assert rows["p1"]["seconds_per_shot"] == pytest.approx(3600 / 1e6) and rows["p1"]["donor"] == "a"
    assert rows["p2"]["donor"] == "b" and rows["p2"]["run_shots"] == 10_240 and rows["p0"]["run_shots"] == 1024
    s = projection.project_population(population, cells, caps=[20_000], shot_batch=256).head()
    assert s["population_codes"] == 4 and s["top_codes"] == 2 and s["top_d_upper_min"] == 4 and s["fit_codes"] == 2
    assert s["core_hours"] == pytest.approx(sum(r["core_hours"] for r in rows.values()))
    brackets = {r["bracket"]: r["items"] for r in projection.bracket_counts(population, cells).collect()}
    assert brackets == {"a": 1, "a .. b": 1, "b": 1, "above b": 1}
    assert [r["code_id"] for r in projection.outside_fit(population, cells).collect()] == ["p3"]


def test_flat_fit_without_two_sizes(spark):
    pts = spark.createDataFrame([("g", 5.0, 2.0), ("g", 5.0, 4.0)], "g string, size double, seconds double")
    r = projection.power_law_fit(pts, ["g"]).head()
    assert r["b"] == 0 and r["a"] == pytest.approx(math.log(3.0))


def test_cost_report_ratios(spark):
    projected = spark.createDataFrame(
        [("f1", 4, 10, 1.0, 1000, 1000 / 3600, False), ("f2", 4, 12, 1.0, 1000, 1000 / 3600, False), ("u", 3, 9, 1.0, 1000, 1000 / 3600, None)],
        "code_id string, d_upper int, n int, seconds_per_shot double, run_shots long, core_hours double, exceeds_max_shots boolean")
    measured = spark.createDataFrame([("f1", 500, 60, 1000.0, True), ("f2", 100, 1, 300.0, False)],
                                     "code_id string, shots long, failures long, seconds double, finished boolean")
    r = projection.cost_report(projected, measured, max_shots=5000).head()
    assert (r["ratio_min"], r["ratio_max"], r["ratio_median"]) == (2.0, 3.0, 2.5)
    assert r["reprojected_at_median"] == pytest.approx((1000 + 3 * 1000 + 2.5 * 1000) / 3600)
    assert r["all_unknown"] == 1 and r["all_censored"] == 2


def test_uniform_draws_judge_only_what_is_drawn_and_the_grid_is_spread(spark):
    t = spark.createDataFrame([(i, "p") for i in range(9)], "template long, construction_program_id string")
    keep = lambda rows: rows.filter("(template + l * m) % 3 != 0")
    run = lambda ok: sorted(map(tuple, sampling.uniform_draws(t, ok, "template", 50, 40, 5).select("attempt", "draw", "template", "l", "m").collect()))
    assert run(keep) == run(keep(sampling.candidate_grid(t, 40)).select("template", "l", "m"))
    many = spark.range(25_000).coalesce(1).select(F.col("id").alias("template"))
    assert sampling.candidate_grid(many, 12).rdd.getNumPartitions() == 3
