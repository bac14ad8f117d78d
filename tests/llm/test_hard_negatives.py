import numpy as np
import pytest
from pyspark.sql import functions as F

from rankscreen.llm import hard_negatives as hn


def brute(rows, every):
    """rows: {id: (label, whole vector)}"""
    out = []
    for a in (i for i in rows if i % every == 0):
        dot = {i: int(sum(int(x) * int(y) for x, y in zip(rows[a][1], v))) for i, (_, v) in rows.items() if i != a}
        order = sorted(dot, key=lambda i: (-dot[i], i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:5]:
            fit = [i for i in order if rows[i][0] != rows[a][0] and 30 * dot[p] <= 100 * dot[i] <= 90 * dot[p]][:10]
            out += [(a, p, r, i, dot[p], dot[i]) for r, i in enumerate(fit, 1)]
    return sorted(out)


def mined(df, every, **options):
    got = hn.mine(hn.candidates(df), F.col("id") % every == 0, **options)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize("clustered", [True, False])
def test_matches_brute_force(spark, monkeypatch, clustered):
    monkeypatch.setattr(hn, "TREE", 150)
    monkeypatch.setattr(hn, "LEAF", 8)
    monkeypatch.setattr(hn, "TURN", 20)
    rng = np.random.default_rng(2)
    n = 900
    x = rng.normal(size=(n, 8)) * 0.3
    if clustered:
        x = rng.normal(size=(6, 8))[rng.integers(0, 6, n)] + x * rng.uniform(0, 1, (n, 1))
    x[200:320] = x[7]                          # copies: ties by id
    label = rng.integers(0, 3, n)
    ids = np.arange(n) * 3 - 30
    rows = {int(i): (int(c), np.floor(256 * v)) for i, c, v in zip(ids, label, x)}
    df = spark.createDataFrame([(int(i), int(c), v.tolist(), "x") for i, c, v in zip(ids, label, x)],
                               "vec_id long, label int, embedding array<double>, rank string")
    assert mined(df, 20) == brute(rows, 20)


def test_tree_covers_and_bounds():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(700, 6)) * 40, np.tile(rng.normal(size=6) * 20, (300, 1))]).round()
    tree = hn.CoverTree.build(x, np.arange(1000), np.zeros(1000, np.int64))
    assert sorted(tree.ids) == list(range(1000))
    q = rng.normal(size=(20, 6)) * 30
    for node in range(len(tree.centre)):
        low, high = tree.bounds(q, np.sqrt((q**2).sum(axis=1)), np.full(20, node))
        below = q @ tree.x[tree.start[node]:tree.stop[node]].T
        assert (below.min(axis=1) >= low).all() and (below.max(axis=1) <= high).all()
        if tree.last[node]:
            kids = range(tree.first[node], tree.last[node])
            assert [tree.start[node], *(tree.stop[c] for c in kids)] == [*(tree.start[c] for c in kids), tree.stop[node]]


def test_search_skips_nodes(monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 16)) * 300
    x = (centre[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 5).round()
    tree = hn.CoverTree.build(x, np.arange(8000), np.zeros(8000, np.int64))
    seen = []
    inner = hn.CoverTree.bounds
    monkeypatch.setattr(hn.CoverTree, "bounds", lambda self, q, length, node: seen.append(len(node)) or inner(self, q, length, node))
    q = x[:50]
    wide = np.full(50, 2**62)
    ids, _ = tree.search(q, np.full(50, -1), np.zeros(50, np.int64), True, -wide, wide, 3)
    assert sum(seen) < 50 * len(tree.centre) / 3
    top = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, 0]
    at = {int(i): j for j, i in enumerate(tree.ids)}
    assert all((x[i] == tree.x[at[int(f)]]).all() or q[j] @ x[i] == q[j] @ tree.x[at[int(f)]] for j, (i, f) in enumerate(zip(top, ids[:, 0])))


def test_defined_cases(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 2, [0.5, 0.0]), (3, None, [0.5, 0.0]), (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]),
            (7, 2, [0.5]), (8, 2, [0.0, 0.0]), (2, 2, [0.5, 0.0]), (9, 2, [0.5, 0.9]), (None, 2, [0.5, 0.0]), (20, 7, [1.0, 1.0]), (40, 1, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    keep = {i: (c, np.floor(256 * np.float32(v).astype(float))) for i, c, v in rows if i in (0, 1, 2, 8, 9, 20, 40)}
    assert mined(df, 20) == brute(keep, 20) != []
    assert mined(df.limit(0), 20) == []


def test_large_whole_numbers(spark):
    rows = [(i, i % 2, [1e5 * (i + 1), 2e5 + i]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(df, 10) == brute({i: (c, np.floor(256 * np.array(v))) for i, c, v in rows}, 10)
