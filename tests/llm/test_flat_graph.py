import numpy as np
import pytest

from rankscreen.llm import flat_graph as fg


def brute(ids, x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(ids))
    order = np.argsort(ids)
    for s in order:
        if root[s] != s or (near[s] & (ids < ids[s])).any() and root[s] != s:
            continue
        stack, seen = [s], {s}
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    stack.append(int(j))
        least = min(seen, key=lambda j: ids[j])
        for j in seen:
            root[j] = least
    return {int(i): (int(n), int(ids[r])) for i, n, r in zip(ids, near.sum(axis=1), root)}


def planted(rng, n, dim, spread=0.3):
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for start, size in ((10, 160), (200, 7), (300, 2), (400, 2), (500, 3)):
        x[start:start + size] = x[start] + spread * rng.normal(size=(size, dim)) / np.sqrt(dim)
    x[600:620] = 2.5 * x[12]      # copies of one direction, in the large group
    x[700:703] = x[699]
    return x


def run(spark, ids, x, **options):
    df = spark.createDataFrame([(int(i), v.tolist(), "x", 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, node string, links int")
    return {r.vec_id: (r.n_links, r.component_id, r.kept, r.audited_recall) for r in fg.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("shard, visitors", [(10_000, 10_000), (300, 200), (60, 50)])
def test_all_links_found(spark, monkeypatch, shard, visitors):
    monkeypatch.setattr(fg, "SHARD", shard)
    monkeypatch.setattr(fg, "VISITORS", visitors)
    rng = np.random.default_rng(4)
    x = planted(rng, 1500, 32)
    ids = rng.permutation(1500) * 2 - 100
    cells = None if shard > 60 else 3          # few cells, so that each is cut into blocks
    got, want = run(spark, ids, x, cells=cells), brute(ids, x)
    wrong = [i for i in want if got[i][:2] != want[i]]
    assert not wrong, (len(wrong), [(got[i], want[i]) for i in wrong[:5]])
    assert all(kept == (i == c) for i, (_, c, kept, _) in got.items()) and next(iter(got.values()))[3] == 1.0


def test_pruned_graph():
    rng = np.random.default_rng(1)
    u = fg.unit(np.concatenate([rng.normal(size=(400, 16)), rng.normal(size=16) + 0.05 * rng.normal(size=(200, 16))]))
    a, b = fg.build_graph(u)
    assert (a != b).all() and fg.reach(a, b, 600, fg.medoid(u)).all()
    kept = fg.robust_prune(u, np.arange(600), np.tile(np.arange(600), (600, 1)))
    for i in range(0, 600, 37):
        mine = [j for j in kept[i] if j >= 0]
        gap = lambda p, q: 2 - 2 * u[p] @ u[q]
        assert mine[0] == max((j for j in range(600) if j != i), key=lambda j: u[i] @ u[j])
        assert all(fg.ALPHA * gap(p, q) > gap(i, q) - 1e-9 for k, q in enumerate(mine) for p in mine[:k])
    graph = fg.padded(a, b, 600)
    best = fg.greedy(u, graph, u[::7], fg.medoid(u))
    assert np.mean([i in row for i, row in zip(range(0, 600, 7), best)]) > 0.9


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (1, [0.0, 0.0]), (2, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 0.0]),
            (7, [1e300, 1e299]), (3, [2.0, 0.0]), (8, [0.0, -1.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in fg.near_duplicates(df).collect())
    alone = [(False, i, 0, i, True) for i in (1, 2, 4, 5, 6, 8, 9)]
    group = [(False, 0, 2, 0, True), (False, 3, 2, 0, False), (False, 3, 2, 0, False), (False, 7, 2, 0, False)]
    assert got == sorted(alone + group + [(True, 0, 0, None, False)])
    assert fg.near_duplicates(df.limit(0)).count() == 0
    assert [r.n_links for r in fg.near_duplicates(df.filter("vec_id in (1, 2)")).collect()] == [0, 0]
