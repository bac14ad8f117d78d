import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankscreen.operators import ranks, reconcile


def skewed(spark, n=3000, seed=0):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.4 else f"g{rng.randrange(5)}", 7.0 if rng.random() < 0.3 else float(rng.randrange(400))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, v double"), pd.DataFrame(rows, columns=["id", "g", "v"])


@pytest.fixture
def tiny_ranges(monkeypatch):
    """Force many ranges and the hot-value path on small data."""
    real = ranks.Ranges.of.__func__
    monkeypatch.setattr(ranks.Ranges, "of", classmethod(lambda cls, df, value, rows_per_range=100: real(cls, df, value, rows_per_range)))
    monkeypatch.setattr(ranks, "HOT_KEY_ROWS", 50)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_average_rank(spark, tiny_ranges, by):
    df, pdf = skewed(spark)
    got = ranks.with_average_rank(df, by, "v").toPandas().set_index("id")["avg_rank"].sort_index()
    want = (pdf.groupby("g")["v"].rank() if by else pdf["v"].rank())
    assert got.tolist() == want.tolist()


def test_top_probability(spark, tiny_ranges):
    df, pdf = skewed(spark)
    got = ranks.with_top_probability(df, [], "v", 500).toPandas()
    cut = pdf["v"].sort_values().iloc[499]
    below, tie = (pdf["v"] < cut).sum(), (pdf["v"] == cut).sum()
    want = pdf["v"].map(lambda v: 1.0 if v < cut else (500 - below) / tie if v == cut else 0.0)
    assert got.set_index("id")["top_p"].sort_index().tolist() == pytest.approx(want.tolist())


@pytest.mark.parametrize("by", [[], ["g"]])
def test_row_index(spark, by):
    df, pdf = skewed(spark)
    got = ranks.row_index(df.repartition(7), [F.col("v").desc(), F.col("id").asc()], by).toPandas().set_index("id")["row_idx"].sort_index()
    s = pdf.sort_values(["v", "id"], ascending=[False, True])
    want = (s.groupby("g").cumcount() if by else pd.Series(range(len(s)), index=s.index)).sort_index()
    assert got.tolist() == want.tolist()


def test_running_sums_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "_RUN_CHUNK", 10)
    rows = [(g, i, (i * 7) % 5) for g in range(3) for i in range(95)]
    df = spark.createDataFrame(rows, "g int, i long, x long")
    got = ranks.running_sums(df, ["g"], "i", {"s": "x"}).toPandas().sort_values(["g", "i"])
    want = pd.DataFrame(rows, columns=["g", "i", "x"]).groupby("g")["x"].cumsum()
    assert got["s"].tolist() == want.tolist()


def test_enclosing_points(spark, tiny_ranges):
    rng = random.Random(1)
    values = [(g, float(rng.randrange(1000))) for g in "ab" for _ in range(300)]
    points = [(g, float(rng.randrange(200, 900))) for g in "ab" for _ in range(20)]
    got = ranks.enclosing_points(spark.createDataFrame(values, "g string, v double"), spark.createDataFrame(points, "g string, v double"), ["g"], "v").collect()
    assert len(got) == len(set(values))
    for r in got:
        own = [p for g, p in points if g == r["g"]]
        assert r["point_below"] == max((p for p in own if p <= r["v"]), default=None)
        assert r["point_above"] == min((p for p in own if p >= r["v"]), default=None)


def test_table_digest_ignores_order_and_sees_changes(spark):
    df, _ = skewed(spark)
    digest = lambda d: reconcile.table_digest(d, ["id", "g", "v"]).head()[0]
    assert digest(df) == digest(df.orderBy(F.rand(1)).repartition(5))
    assert digest(df) != digest(df.withColumn("v", F.when(F.col("id") == 5, -1.0).otherwise(F.col("v"))))
    assert digest(df) != digest(df.unionByName(df.limit(1)))


def test_row_index_joins_in_tasks_of_bounded_rows(spark):
    """Groups are numbered in as many tasks as the rows need, whatever their size on disk; 0.0 and -0.0 are one group."""
    df = spark.range(4000).selectExpr("if(id % 2 = 0, 0.0D, -0.0D) * (id % 3 - 1) as g", "id")
    out = ranks.row_index(df, [F.col("id").asc()], ["g"], task_rows=100)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() >= 40
    assert sorted(r.row_idx for r in out.collect()) == list(range(4000))
