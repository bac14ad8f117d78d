import numpy as np
import pytest

from rankscreen.errors import Refused
from rankscreen.operators import boosting, model


def tree(x, r, depth, min_rows):
    """One tree on rows x (nulls as -inf) and residuals r: a function from rows to leaf values."""
    best = None
    if depth:
        for j in range(x.shape[1]):
            for c in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= c
                n, m = left.sum(), (~left).sum()
                if n >= min_rows and m >= min_rows:
                    gain = round(r[left].sum() ** 2 / n + r[~left].sum() ** 2 / m - r.sum() ** 2 / len(r), 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, j, c
    if best is None:
        return lambda q: np.full(len(q), r.mean())
    _, j, c = best
    left = x[:, j] <= c
    low, high = tree(x[left], r[left], depth - 1, min_rows), tree(x[~left], r[~left], depth - 1, min_rows)
    return lambda q: np.where(q[:, j] <= c, low(q), high(q))


def boosted(x, y, trees, depth, rate, min_rows):
    pred, grown = np.full(len(y), y.mean()), []
    for _ in range(trees):
        t = tree(x, y - pred, depth, min_rows)
        # A tree without any split ends the model.
        if np.ptp(t(x)) == 0:
            break
        pred = pred + rate * t(x)
        grown.append(t)
    return lambda q: y.mean() + rate * sum(t(q) for t in grown)


@pytest.mark.parametrize("block", [4_000_000, 700])
def test_folds_match_separate_models(spark, monkeypatch, block):
    monkeypatch.setattr(boosting, "BLOCK_CELLS", block)
    monkeypatch.setattr(boosting, "CUT", 3)
    rng = np.random.default_rng(1)
    n = 400
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 4, n), rng.integers(0, 30, n)], axis=1).astype(float)
    y = x[:, 0] * 0.3 - (x[:, 1] > 1) * x[:, 2] * 0.05 + 0.1 * rng.normal(size=n)
    x[rng.random(n) < 0.1, 2] = -np.inf
    fold, train = rng.integers(0, 5, n), rng.random(n) < 0.9
    rows = [(f"c{i:03d}", int(f), bool(t), float(v) if t else None, int(a), float(b), None if c == -np.inf else float(c))
            for i, (f, t, v, (a, b, c)) in enumerate(zip(fold, train, y, x))]
    df = spark.createDataFrame(rows, "id string, fold int, train boolean, y double, a int, b double, c double")
    options = {"trees": 7, "depth": 3, "rate": 0.3, "min_rows": 10}
    got = {r.id: (r.fold, r.pred) for r in boosting.out_of_fold(df, ["a", "b", "c"], key="id", **options).collect()}
    assert len(got) == n
    for f in range(5):
        fit = train & (fold != f)
        want = boosted(x[fit], y[fit], **options)(x[fold == f])
        assert [got[f"c{i:03d}"] for i in np.flatnonzero(fold == f)] == [(f, pytest.approx(v, abs=1e-9)) for v in want]


def test_nothing_to_split(spark):
    rows = [(f"c{i}", f"p{i % 2}", False, 10.0 ** -(1 + i % 2), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "code_id string, construction_program_id string, censored boolean, true_ler double, d double")
    out = model.out_of_fold_predictions(df, ["d"])
    assert {(r.construction_program_id, r.pred_log10_ler) for r in out.join(df, "code_id").collect()} == {("p0", -2.0), ("p1", -1.0)}
    with pytest.raises(Refused, match="d is null"):
        model.out_of_fold_predictions(df.withColumn("d", df.d.cast("int") * None), ["d"])


def test_rows_of_equal_bins_are_one_cell(spark):
    """The work of a pass follows the distinct bins, not the rows: 6,000 rows of twelve cells and three folds."""
    rows = [(f"c{i}", i % 3, i % 7 > 0, float(i % 5), float(i % 12)) for i in range(6_000)]
    df = spark.createDataFrame(rows, "id string, fold int, train boolean, y double, a double")
    cuts = boosting.bin_cuts(df.filter("train"), ["a"], 64)
    blocks = boosting._blocks(boosting._binned(df, ["a"], cuts, "id"), 3, 64).collect()
    assert sum(len(b.bins) // 2 for b in blocks) == 12
    own = sum(np.frombuffer(b.n, np.int64).reshape(-1, 3).sum(axis=0) for b in blocks)
    assert own.tolist() == [sum(r[2] for r in rows if r[1] == f) for f in range(3)]
    assert boosting.out_of_fold(df, ["a"], key="id", trees=2, depth=2, rate=0.3, min_rows=10).count() == 6_000


def test_few_cells_are_grown_without_a_pass(spark, monkeypatch):
    """A fold a task over broadcast blocks: the predictions of the passes, though no pass can be made."""
    rng = np.random.default_rng(9)
    rows = [(f"c{i}", int(rng.integers(0, 4)), bool(i % 9), float(a * (b > 2) + 0.1 * rng.normal()), float(a), float(b) if i % 11 else None)
            for i, (a, b) in enumerate(rng.integers(0, 7, (900, 2)))]
    df = spark.createDataFrame(rows, "id string, fold int, train boolean, y double, a double, b double")
    run = lambda: {r.id: (r.fold, pytest.approx(r.pred, abs=1e-9)) for r in boosting.out_of_fold(
        df, ["a", "b"], key="id", trees=4, depth=3, rate=0.3, min_rows=10).collect()}
    few = boosting.FEW_CELLS
    monkeypatch.setattr(boosting, "FEW_CELLS", 0)
    passes = run()
    monkeypatch.setattr(boosting, "FEW_CELLS", few)
    monkeypatch.setattr(boosting, "CUT", 0)     # a tree of the passes would divide by it
    assert run() == passes and len(passes) == 900


def test_the_query_grows_all_trees(spark, monkeypatch):
    from rankscreen.catalog import ENTRIES
    seen = []
    monkeypatch.setattr(boosting, "out_of_fold", lambda df, features, key, **options: seen.append(options["trees"]) or df.selectExpr(key, "0.0 AS pred", "fold"))
    ENTRIES["out_of_fold_predictions"].run(spark, "/root/testdata/sf0.001")
    assert seen == [model.BOOST_PARAMS["maxIter"]]
