import numpy as np
import pytest

from rankscreen.llm import onebit_ann as ann


def exact(ids, x, k=20, every=20):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 24))
    x = (centre[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 24))) * rng.uniform(0.5, 2, (3000, 1))
    x[100:900] = x[5]   # one very common vector
    ids = np.arange(3000) * 3 + 1
    table = spark.createDataFrame([(int(i), v.tolist(), "q") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, rank string")
    got: dict = {}
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(ids, x)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want]
    assert np.mean(hits) / 20 >= 0.9
    full: dict = {}
    for r in ann.search(table, visits=10**6).orderBy("query_id", "rank").collect():
        full.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = [len({a for a, _ in full[q]} & {a for a, _ in want[q]}) for q in want]
    assert np.mean(hits) / 20 >= 0.99
    for q in want:
        assert all(s == pytest.approx(float((x[list(ids).index(v)] * x[list(ids).index(q)]).sum()), rel=1e-12) for v, s in got[q][:3])
        assert got[q] == sorted(got[q], key=lambda t: (-t[1], t[0]))


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (40, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 20, 0.5), (20, 1, 1, 1.0), (20, 2, 0, 0.5)]
    assert ann.search(table.limit(0)).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(3)
    x, q, c = rng.normal(size=(2000, 64)), rng.normal(size=(50, 64)), rng.normal(size=64)
    turn = ann.rotation(64)
    near, bound = ann.estimate(*ann.encode(x, c, turn), 64, q @ turn.T)
    assert np.mean(np.abs(near - (x - c) @ q.T) <= bound) > 0.99


def test_recall_without_clusters(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(24_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.search(table, every=400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(ids, x.astype(np.float32).astype(np.float64), every=400)
    hits = [len(got[q] & {a for a, _ in want[q]}) / 20 for q in want]
    assert len(want) == 60 and np.mean(hits) >= 0.97 and min(hits) >= 0.9
