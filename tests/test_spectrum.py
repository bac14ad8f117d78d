import math

import numpy as np
import pytest

from rankscreen.operators import graph, spectrum


def table(spark, graphs):
    """Edges and vertices of {name: matrix}."""
    e = [(name, "x", int(c), int(q)) for name, h in graphs.items() for c, q in zip(*np.nonzero(h))]
    v = [(name, "x", kind, i) for name, h in graphs.items() for kind, n in zip("cq", np.shape(h)) for i in range(n)]
    return (spark.createDataFrame(e, "item string, side string, chk long, qub long"),
            spark.createDataFrame(v, "item string, side string, kind string, v long"))


def dense(h):
    m, n = np.shape(h)
    a = np.zeros((m + n, m + n))
    a[:m, m:], a[m:, :m] = h, np.transpose(h)
    d = a.sum(axis=1)
    return np.linalg.eigvalsh(np.eye(m + n) - a / np.sqrt(np.outer(d, d)))[1]


def ring(s):
    return np.eye(s) + np.roll(np.eye(s), 1, axis=1)


def test_closed_forms_and_dense_values(spark):
    rng = np.random.default_rng(3)
    graphs = {"k32": np.ones((3, 2)), "k11": np.ones((1, 1)), "star": np.ones((1, 4)), "star2": np.ones((4, 1)), "octagon": ring(4), "ring9": ring(9),
              "two": np.kron(np.eye(2), np.ones((2, 2))), "alone": np.array([[1, 1, 0], [1, 1, 0]])}
    want = {"k32": 1.0, "k11": 2.0, "star": 1.0, "star2": 1.0, "octagon": 1 - math.cos(math.pi / 4), "ring9": 1 - math.cos(math.pi / 9), "two": 0.0, "alone": 0.0}
    for i in range(6):
        h = rng.random((12 + i, 15)) < 0.3
        h[:, 0] = h[0] = True
        graphs[f"random{i}"], want[f"random{i}"] = h, dense(h.astype(float))
    e, v = table(spark, graphs)
    got = {r["item"]: r.lambda2 for r in spectrum.second_eigenvalue(e, graph.components(e, v)).collect()}
    assert got == {k: pytest.approx(w, abs=1e-8) for k, w in want.items()}
    with pytest.raises(RuntimeError, match="did not settle"):
        spectrum.second_eigenvalue(*table(spark, {"ring9": ring(9)})[:1], graph.components(*table(spark, {"ring9": ring(9)})), max_steps=2)


def test_largest_of_three_diagonals():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20):
        a, b = rng.random(n), rng.random(n - 1) + 0.1
        values, vectors = np.linalg.eigh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
        theta, last = spectrum.largest(a, b)
        assert theta == pytest.approx(values[-1]) and last == pytest.approx(abs(vectors[-1, -1]), rel=1e-3, abs=1e-9)


def test_in_the_feature_row(spark):
    pair = "struct<i:int,j:int>"
    df = spark.createDataFrame([("a", 3, 3, [(1, 0), (0, 1), (0, 2)], [(0, 1), (1, 0), (2, 0)], 2, 3)],
                               f"code_id string, l int, m int, a_exps array<{pair}>, b_exps array<{pair}>, k int, d_upper int")
    row = graph.code_features(df, spectral=True).head()
    e = graph.expand(df).collect()
    for side in "xz":
        h = np.zeros((9, 18))
        for r in e:
            if r.side == side:
                h[r.chk, r.qub] = 1
        assert row[f"lambda2_{side}"] == pytest.approx(dense(h) if row[f"n_components_{side}"] == 1 else 0.0, abs=1e-8)
    assert "lambda2_x" not in graph.code_features(df).columns
