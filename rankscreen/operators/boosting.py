"""Gradient-boosted regression trees for all folds at once.

Every fold is a model of its own, trained on the rows of the other folds, but all of them grow together: one pass over
the data serves a tree level of every fold. Rows of equal bins have equal predictions, so they are one cell: its training rows and
their sum of targets by fold, and one prediction per fold. Cells, at most one a row and often far fewer, are packed into blocks. A pass sends each task's sums of residuals per (fold, node, feature, bin), already
added up inside the task, to one group per fold, which picks the best split of each node; the driver sees the splits
only, at most ``folds * 2**depth`` rows. The number of passes is ``trees * depth``, whatever the number of folds. Up to ``FEW_CELLS``
predictions the blocks are broadcast instead, and each task grows the trees of its fold over all cells without a pass.

Nulls have a bin below all others. Splits need ``min_rows`` training rows on both sides; equal gains go to the earlier
feature and the smaller cut. Predictions are cached between passes and written out every ``CUT`` trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .. import scratch

#: Predictions (cells times folds) in one block, and trees between two written states.
BLOCK_CELLS = 4_000_000
CUT = 10
#: Predictions up to which the blocks, 16 bytes each, are broadcast to a task for each fold.
FEW_CELLS = 4_000_000
# As types, not text: a pass is short enough for the parsing of a schema to show.
_BLOCK = T.StructType([T.StructField(c, T.BinaryType()) for c in ("bins", "n", "s", "pred")])
_SUMS = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("s", T.BinaryType()), T.StructField("n", T.BinaryType())])
_SPLIT = T.StructType([T.StructField(c, t()) for c, t in (
    ("fold", T.IntegerType), ("node", T.IntegerType), ("feature", T.IntegerType), ("cut", T.IntegerType), ("n_left", T.LongType),
    ("s_left", T.DoubleType), ("n_right", T.LongType), ("s_right", T.DoubleType))])


def bin_cuts(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Ascending cut points per feature: quantiles, so a frequent value always is one. A row's bin counts the cuts below it."""
    probs = [i / max_bins for i in range(1, max_bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), probs, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).head()
    return [sorted(set(row[f"q{i}"] or [])) for i in range(len(features))]


def _bins(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(c, v)) for v, c in zip(columns, cuts)], axis=1).astype(np.uint16)


def _binned(df: DataFrame, features: Sequence[str], cuts: list[list[float]], key: str) -> DataFrame:
    """(key, fold, train, y, bins): ``bins`` holds two bytes a feature."""
    cut_arrays = [np.array(c) for c in cuts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = [batch[f"f{i}"].to_numpy(dtype=np.float64, na_value=np.nan) for i in range(len(features))]
            bins = _bins(columns, cut_arrays)
            yield batch[["key", "fold", "train", "y"]].assign(bins=[b.tobytes() for b in bins])
    named = df.select(F.col(key).cast("string").alias("key"), "fold", "train", "y", *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    return named.mapInPandas(run, "key string, fold int, train boolean, y double, bins binary")


def _blocks(binned: DataFrame, n_folds: int, rows: int) -> DataFrame:
    """Blocks of some ``rows`` cells: a cell's training rows and sums by fold, in the order of its bins."""
    y = F.when(F.col("train"), F.coalesce("y", F.lit(0.0))).otherwise(0.0)
    cells = scratch.table(binned.groupBy("bins", "fold").agg(F.count_if("train").alias("n"), F.sum(y).alias("s")), "boost-cells")
    total = cells.select("bins").distinct().count()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        where, bins = pd.factorize(group["bins"], sort=True)
        n, s = np.zeros((len(bins), n_folds), np.int64), np.zeros((len(bins), n_folds))
        n[where, group["fold"]], s[where, group["fold"]] = group["n"], group["s"]
        return pd.DataFrame({"bins": [b"".join(bins)], "n": [n.tobytes()], "s": [s.tobytes()], "pred": [b""]})
    block = F.pmod(F.xxhash64("bins"), F.lit(max(1, -(-total // rows))))
    return scratch.table(cells.groupBy(block.alias("block")).applyInPandas(pack, _BLOCK), "boost-blocks")


class _Block:
    """One row of the packed table as arrays."""

    def __init__(self, row, n_features: int, base: np.ndarray):
        self.bins = np.frombuffer(row.bins, np.uint16).reshape(-1, n_features)
        shape = len(self.bins), len(base)
        # A fold's model is trained on the rows of the other folds.
        n, s = np.frombuffer(row.n, np.int64).reshape(shape), np.frombuffer(row.s).reshape(shape)
        self.n, self.s = n.sum(axis=1, keepdims=True) - n, s.sum(axis=1, keepdims=True) - s
        self.pred = np.frombuffer(row.pred).reshape(shape) if row.pred else np.broadcast_to(base, shape)

    def nodes(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where each row stands in each fold's tree after some levels; a node that is not split keeps its rows on the left."""
        folds = np.arange(self.pred.shape[1])
        at = np.zeros(self.pred.shape, np.int64)
        for feature, cut in levels:
            f = feature[folds, at]
            at = 2 * at + ((f >= 0) & (np.take_along_axis(self.bins, np.maximum(f, 0), 1) > cut[folds, at]))
        return at


def best_splits(s: np.ndarray, n: np.ndarray, min_rows: int) -> list[tuple]:
    """(node, feature, cut, n_left, s_left, n_right, s_right) of every node that can be split. Sums by (node, feature, bin)."""
    sl, nl = s.cumsum(axis=2), n.cumsum(axis=2)
    st, nt = sl[:, :, -1:], nl[:, :, -1:]
    sr, nr = st - sl, nt - nl
    ok = (nl >= min_rows) & (nr >= min_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, sl**2 / nl + sr**2 / nr - st**2 / nt, -np.inf)
    flat = np.round(gain, 9).reshape(len(s), -1)
    out = []
    for node, best in enumerate(flat.argmax(axis=1)):
        if flat[node, best] > 0:
            feature, cut = divmod(int(best), s.shape[2])
            at = node, feature, cut
            out.append((node, feature, cut, int(nl[at]), float(sl[at]), int(nr[at]), float(sr[at])))
    return out


def _fold_predictions(bins: np.ndarray, n: np.ndarray, s: np.ndarray, base: float, n_bins: int, trees: int, depth: int, rate: float, min_rows: int) -> np.ndarray:
    """One prediction per cell by the model of one fold, from the training rows of each cell and their sum of targets."""
    pred = np.full(len(bins), base)
    columns = [np.ascontiguousarray(bins[:, j], np.int64) for j in range(bins.shape[1])]
    for _ in range(trees):
        rest, at, value = s - n * pred, np.zeros(len(bins), np.int64), np.zeros(1)
        for level in range(depth):
            place, shape = at * n_bins, (2**level, n_bins)
            sums, counts = (np.stack([np.bincount(place + c, w, 2**level * n_bins).reshape(shape) for c in columns], axis=1) for w in (rest, n))
            found = best_splits(sums, counts, min_rows)
            if not found:
                break
            feature, cut, value = np.full(2**level, -1), np.zeros(2**level, np.int64), np.repeat(value, 2)
            for node, j, c, n_left, s_left, n_right, s_right in found:
                feature[node], cut[node] = j, c
                value[2 * node:2 * node + 2] = s_left / n_left, s_right / n_right
            f = feature[at]
            at = 2 * at + ((f >= 0) & (bins[np.arange(len(bins)), f] > cut[at]))
        if len(value) == 1:
            break                               # nor would it be split after this tree
        pred += rate * value[at]
    return pred


def _grown_in_tasks(blocks: DataFrame, n_features: int, base: np.ndarray, **options) -> DataFrame:
    """(bins, fold, pred) of every cell and fold: a fold a task, which reads the broadcast blocks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, list] = {}
        for batch in batches:
            for row in batch.itertuples():
                block = _Block(row, n_features, base)
                parts.setdefault(row.own, []).append((block.bins, block.n[:, row.own], block.s[:, row.own]))
        for fold, part in parts.items():
            bins, n, s = (np.concatenate(x) for x in zip(*part))
            order = np.lexsort(bins.T)          # blocks come in any order; sums are added in one
            bins = bins[order]
            pred = _fold_predictions(bins, n[order].astype(np.float64), s[order], base[fold], **options)
            yield pd.DataFrame({"bins": [b.tobytes() for b in bins], "fold": np.int32(fold), "pred": pred})
    folds = blocks.sparkSession.range(0, len(base), 1, len(base)).withColumnRenamed("id", "own")
    return folds.crossJoin(F.broadcast(blocks)).mapInPandas(run, "bins binary, fold int, pred double")


def out_of_fold(df: DataFrame, features: Sequence[str], *, key: str, trees: int, depth: int, rate: float, min_rows: int, max_bins: int = 64) -> DataFrame:
    """(key, fold, pred): each row predicted by the model of its own fold. ``df``: key, fold, train, y and the features."""
    df = scratch.table(df, "boost-input")
    stats = df.groupBy("fold").agg(F.count_if("train").alias("n"), F.sum(F.when(F.col("train"), F.col("y"))).alias("s")).collect()
    n_folds = 1 + max(r.fold for r in stats)
    n, s = np.zeros(n_folds), np.zeros(n_folds)
    for r in stats:
        n[r.fold], s[r.fold] = r.n, r.s or 0.0
    base = (s.sum() - s) / (n.sum() - n)
    cuts = bin_cuts(df.filter("train"), features, max_bins)
    n_bins, n_features = 2 + max(map(len, cuts)), len(features)
    binned = scratch.table(_binned(df, features, cuts, key), "boost-binned")
    state = _blocks(binned, n_folds, max(64, min(4096, BLOCK_CELLS // n_folds)))
    cells = state.agg(F.sum(F.octet_length("bins")) / (2 * n_features)).head()[0]
    if cells * n_folds <= FEW_CELLS:
        preds = scratch.table(_grown_in_tasks(state, n_features, base, n_bins=n_bins, trees=trees, depth=depth, rate=rate, min_rows=min_rows), "boost-predictions")
        return scratch.table(binned.join(scratch.shuffled(preds), ["bins", "fold"]).select(F.col("key").alias(key), "fold", "pred"), "boost-out")

    def histogram(levels: list) -> object:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nodes = 2 ** len(levels)
            size = n_folds * nodes * n_bins
            sums, counts = np.zeros((n_features, size)), np.zeros((n_features, size), np.int64)
            for batch in batches:
                for row in batch.itertuples():
                    block = _Block(row, n_features, base)
                    cell, fold = np.nonzero(block.n)
                    place = (fold * nodes + block.nodes(levels)[cell, fold]) * n_bins
                    n = block.n[cell, fold]
                    rest = block.s[cell, fold] - n * block.pred[cell, fold]
                    for j in range(n_features):
                        at = place + block.bins[cell, j]
                        sums[j] += np.bincount(at, rest, size)
                        counts[j] += np.bincount(at, n, size).astype(np.int64)
            shape = (n_features, n_folds, nodes, n_bins)
            sums, counts = (np.ascontiguousarray(a.reshape(shape).transpose(1, 2, 0, 3)) for a in (sums, counts))
            some = np.flatnonzero(counts.any(axis=(1, 2, 3)))
            yield pd.DataFrame({"fold": some.astype(np.int32), "s": [sums[f].tobytes() for f in some], "n": [counts[f].tobytes() for f in some]})
        return run

    def choose(level: int) -> object:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shape, sums, counts = (2**level, n_features, n_bins), {}, {}
            for batch in batches:
                for fold, s, n in zip(batch["fold"], batch["s"], batch["n"]):
                    sums[fold] = sums.get(fold, 0) + np.frombuffer(s).reshape(shape)
                    counts[fold] = counts.get(fold, 0) + np.frombuffer(n, np.int64).reshape(shape)
            out = [(fold, *split) for fold in sums for split in best_splits(sums[fold], counts[fold], min_rows)]
            yield pd.DataFrame(out, columns=_SPLIT.names)
        return run

    def grown(levels: list, value: np.ndarray) -> object:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                pred = []
                for row in batch.itertuples():
                    block = _Block(row, n_features, base)
                    pred.append((block.pred + rate * value[np.arange(n_folds), block.nodes(levels)]).tobytes())
                yield batch.assign(pred=pred)
        return run

    held = []
    for tree in range(trees):
        levels, value = [], np.zeros((n_folds, 1))
        for level in range(depth):
            # A fold's sums of all tasks meet in one task, which holds the folds it was dealt and nothing else.
            sums = state.mapInPandas(histogram(levels), _SUMS).repartition("fold")
            found = sums.mapInPandas(choose(level), _SPLIT).collect()
            while len(held) > 1:
                held.pop(0).unpersist()     # the present state has been computed from it
            feature, cut = np.full((n_folds, 2**level), -1), np.zeros((n_folds, 2**level), np.int64)
            below = np.repeat(value, 2, axis=1)
            for r in found:
                feature[r.fold, r.node], cut[r.fold, r.node] = r.feature, r.cut
                below[r.fold, 2 * r.node:2 * r.node + 2] = r.s_left / r.n_left, r.s_right / r.n_right
            levels, value = [*levels, (feature, cut)], below
            if not found:
                break
        if not levels[0][0].max(initial=-1) >= 0:
            break                           # no fold can be split any more, nor would it after this tree
        state = state.mapInPandas(grown(levels, value), _BLOCK)
        if (tree + 1) % CUT == 0:
            state = scratch.table(state, "boost-state")
            while held:
                held.pop().unpersist()
        else:
            state = state.persist()
            held.append(state)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                block = _Block(row, n_features, base)
                yield pd.DataFrame({"bins": [b.tobytes() for b in block.bins], "preds": list(block.pred)})
    preds = scratch.table(state.mapInPandas(unpack, "bins binary, preds array<double>"), "boost-predictions")
    own = F.get("preds", F.col("fold"))
    out = scratch.table(binned.join(preds, "bins").select(F.col("key").alias(key), "fold", own.alias("pred")), "boost-out")
    for kept in held:
        kept.unpersist()
    return out
