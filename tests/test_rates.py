import math

import pytest
from pyspark.sql import functions as F

from rankscreen.functions import rates


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


@pytest.mark.parametrize("p,r,k,want", [
    (0.5, 12, 12, 0.004801955655646228), (0.01, 6, 6, 0.0002791370299384255), (0.25, 4, 2, 0.0353213700396906), (0.0, 12, 12, 0.0)])
def test_rate_golden(spark, p, r, k, want):
    assert math.isclose(one(spark, rates.error_rate(F.lit(p), F.lit(r), F.lit(k)))[0], want, rel_tol=1e-12, abs_tol=0)


@pytest.mark.parametrize("p,r,k", [(1.0, 1, 1), (-0.1, 1, 1), (0.5, 0, 1), (0.5, 1, 0)])
def test_rate_refuses(spark, p, r, k):
    with pytest.raises(Exception, match="a rate needs"):
        one(spark, rates.error_rate(F.lit(p), F.lit(r), F.lit(k)))


def test_wilson_golden(spark):
    w = one(spark, rates.wilson_interval(F.lit(100), F.lit(10000)).alias("a"), rates.wilson_interval(F.lit(1), F.lit(1000)).alias("b"),
            rates.wilson_interval(F.lit(0), F.lit(21)).alias("c"))
    assert math.isclose(w["a"]["low"], 0.008229336148148417, rel_tol=1e-12)
    assert math.isclose(w["a"]["high"], 0.012146982255114645, rel_tol=1e-12)
    assert math.isclose(w["b"]["low"], 0.00017654637062607809, rel_tol=1e-12)
    assert math.isclose(w["b"]["high"], 0.0056425585979579355, rel_tol=1e-12)
    assert w["c"]["low"] == 0.0
    with pytest.raises(Exception, match="an interval needs"):
        one(spark, rates.wilson_interval(F.lit(2), F.lit(1)))


def test_label_boundary(spark):
    df = spark.createDataFrame([(1000, 99, 4, 2), (1000, 100, 4, 2)], "shots long, failures long, rounds int, k int")
    a, b = df.withColumns(rates.label_columns()).orderBy("failures").collect()
    assert a["censored"] and a["true_ler"] is None and a["true_ler_ub"] > 0
    assert not b["censored"] and b["true_ler"] > 0


def test_label_refuses_all_failed_and_over_cap(spark):
    df = spark.createDataFrame([(10, 10, 4, 2)], "shots long, failures long, rounds int, k int")
    with pytest.raises(Exception):
        df.withColumns(rates.label_columns(min_failures=1)).collect()
    with pytest.raises(Exception, match="a label needs"):
        spark.createDataFrame([(50_000, 1, 4, 2)], df.schema).withColumns(rates.label_columns()).collect()


def test_tolerant_labels(spark):
    df = spark.createDataFrame([(0, 0, 4, 2), (5, 5, 4, 2)], "shots long, failures long, rounds int, k int")
    none, all_failed = df.withColumns(rates.tolerant_label_columns()).orderBy("shots").collect()
    assert none["censored"] and none["ler_ci_low"] is None and not none["all_shots_failed"]
    assert all_failed["all_shots_failed"] and not all_failed["censored"] and all_failed["ler"] is None


@pytest.mark.parametrize("a,b,want", [(0, 0, 1.0), (10, 0, 2 * 0.5 ** 10), (5, 5, 1.0), (3, 9, 2 * (1 + 12 + 66 + 220) / 4096)])
def test_mcnemar(spark, a, b, want):
    x, y = one(spark, rates.mcnemar_exact(F.lit(a), F.lit(b)), rates.mcnemar_exact(F.lit(b), F.lit(a)))
    assert math.isclose(x, want, rel_tol=1e-9) and math.isclose(x, y, rel_tol=1e-12)


def test_mcnemar_large_counts(spark):
    x = one(spark, rates.mcnemar_exact(F.lit(9000), F.lit(9000)), rates.mcnemar_exact(F.lit(4000), F.lit(9000)))
    assert x[0] == 1.0 and 0 <= x[1] < 1e-300


def test_shots_needed_three_values(spark):
    df = spark.createDataFrame([(1000, 50), (40960, 0), (100, 0), (0, 0)], "shots long, failures long")
    got = {(r["shots"], r["failures"]): r for r in df.withColumns(rates.shots_needed_columns()).withColumns(rates.run_shots_columns()).collect()}
    assert got[1000, 50]["shots_estimate"] == 2000 and got[1000, 50]["exceeds_max_shots"] is False and got[1000, 50]["run_shots"] == 2048
    assert got[40960, 0]["exceeds_max_shots"] is True and got[40960, 0]["run_shots"] == 40960
    assert got[100, 0]["exceeds_max_shots"] is None and got[100, 0]["run_shots"] == 40960
    assert got[0, 0]["exceeds_max_shots"] is None and got[0, 0]["shots_range_low"] is None


def test_half_even_and_nan(spark):
    a, b, c = one(spark, rates.stored_p(F.lit(0.0000125)), rates.null_if_nan(F.lit(float("nan"))), rates.separated(F.lit(None), F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    assert a in (0.000012, 0.000013) and b is None and c is None
