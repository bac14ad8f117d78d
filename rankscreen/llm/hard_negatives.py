"""Hard negatives by inner product, on cover trees over norm-augmented candidates.

Candidates get one more component that brings all of a tree to the same norm, so inner products with a query become
angles on a sphere. Coarse cells, from centroids of a bounded sample, are cut by a hash into trees of bounded size. A
tree is built level by level: a node picks far-apart members of its own as children until they cover it, and keeps the
covering radius it measured. Radius and angle to a node's centre bound every inner product below it from both sides.

A search dives to its most promising leaf, then walks down level by level and drops nodes wholly outside the wanted
window of scores, of the wrong labels, or below the k-th best so far. The leaves left are verified exactly, best bound first, in rounds that double. The first
search finds positives; every positive then is a window of its own for the second. Cells wholly outside a window are
skipped before anything is sent; every other tree gets the anchor, at most ``TURN`` of them at a time, and sends back
one row per anchor with at most k results for each of its windows.

Scores are integers: components are floored to multiples of a scale, and a tree computes in doubles while no sum can
pass 2**53, in 64-bit integers beyond that.

Defined results: rows with a null id, label or vector, with a null or non-finite component, or of another dimension
than the most common one take no part; zero vectors do; rows that share an id are one, the least by label and vector;
equal scores rank by the smaller id; an anchor without positives, or a positive without negatives, gives no rows; an
empty table gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from .onebit_ann import centroids_of, nearest

TREE = 8192
LEAF = 128
FAN = 16
TURN = 16_384
MAX_CELLS = 4096
SAMPLE_ROWS = 20_000
SAMPLE_VALUES = 4_000_000
SCALE = 256
#: Below every score.
NONE = np.iinfo(np.int64).min
_TREE = "cell int, block int, x binary, ids binary, labels binary, centre binary, radius binary, first binary, last binary, start binary, stop binary"


def candidates(table: DataFrame, label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding",
               label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """id, label, x (array of doubles that hold integers), one row per id."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = table.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"),
                        F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(~F.exists("v", bad))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).first()
    rows = rows.filter(F.size("v") == (common.dim if common else 0))
    whole = F.transform("v", lambda c: F.floor(c * scale).cast("double"))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", F.col("r.v").alias("v"))
    return one.select("id", "label", whole.alias("x"))


class CoverTree:
    """Points in tree order, and per node: centre (a point), covering radius, children or points as ranges."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, centre: np.ndarray, radius: np.ndarray,
                 first: np.ndarray, last: np.ndarray, start: np.ndarray, stop: np.ndarray):
        self.x, self.ids, self.labels, self.centre, self.radius = x, ids, labels, centre, radius
        self.first, self.last, self.start, self.stop = first, last, start, stop
        self.low = np.array([labels[a:b].min() for a, b in zip(start, stop)], np.int64)
        self.high = np.array([labels[a:b].max() for a, b in zip(start, stop)], np.int64)
        self.reach = float(np.sqrt((x**2).sum(axis=1)).max(initial=0.0))

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> CoverTree:
        square = (x**2).sum(axis=1)
        lift = np.sqrt(np.maximum(0.0, square.max(initial=0.0) - square))
        y = np.concatenate([x, lift[:, None]], axis=1)
        order = np.arange(len(x))
        nodes: list[list] = []   # centre, radius, first, last, start, stop
        level = [(int(((y - y.mean(axis=0))**2).sum(axis=1).argmin()), 0, len(x))] if len(x) else []
        while level:
            base, below = len(nodes), []
            for centre, a, b in level:
                members = order[a:b]
                gap = np.sqrt(((y[members] - y[centre])**2).sum(axis=1))
                nodes.append([centre, float(gap.max()), 0, 0, a, b])
                if b - a <= LEAF or gap.max() == 0:
                    continue
                # Farthest-first: the centre stays a child, others are picked until all are covered or the fan is full.
                owner, cover, picked = np.zeros(b - a, np.int64), gap, [centre]
                while len(picked) < FAN and cover.max() > 0.5 * gap.max():
                    far = members[int(cover.argmax())]
                    distance = np.sqrt(((y[members] - y[far])**2).sum(axis=1))
                    owner = np.where(distance < cover, len(picked), owner)
                    cover = np.minimum(cover, distance)
                    picked.append(far)
                # The slots keep their fixed meaning: children are contiguous, and their points are too.
                rank = np.argsort(owner, kind="stable")
                order[a:b] = members[rank]
                ends = a + np.cumsum(np.bincount(owner, minlength=len(picked)))
                child = [(int(c), int(s), int(e)) for c, s, e in zip(picked, np.r_[a, ends[:-1]], ends) if e > s]
                nodes[-1][2] = len(below)
                nodes[-1][3] = len(below) + len(child)
                below += child
            for node in nodes[base:]:
                if node[3]:
                    node[2] += len(nodes)
                    node[3] += len(nodes)
            level = below
        at = np.empty(len(x), np.int64)
        at[order] = np.arange(len(x))
        table = [np.array(c) for c in zip(*nodes)] if nodes else [np.zeros(0, np.int64)] * 6
        centre, radius, first, last, start, stop = table
        return cls(x[order], ids[order], labels[order], at[centre.astype(np.int64)], radius.astype(np.float64), *(c.astype(np.int64) for c in (first, last, start, stop)))

    def bounds(self, q: np.ndarray, length: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of queries with all points of nodes, pair by pair."""
        size = np.maximum(length * self.reach, 1e-300)
        angle = np.arccos(np.clip((q * self.x[self.centre[node]]).sum(axis=1) / size, -1, 1))
        spread = 2 * np.arcsin(np.clip(self.radius[node] / max(2 * self.reach, 1e-300), 0, 1))
        slack = 0.5 + 1e-6 * size
        return size * np.cos(np.minimum(np.pi, angle + spread)) - slack, size * np.cos(np.maximum(0, angle - spread)) + slack

    def search(self, q: np.ndarray, who: np.ndarray, label: np.ndarray, same: bool, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (NONE: no more) of the k best points per query with lo <= score <= hi, of the same or of other labels."""
        n = len(q)
        best_id, best = np.zeros((n, k), np.int64), np.full((n, k), NONE, np.int64)
        if not len(self.x) or not n:
            return best_id, best
        peak = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * q.shape[1]
        points, asks = (self.x, q) if peak < 2**53 else (self.x.astype(np.int64), q.astype(np.int64))
        length = np.sqrt((q**2).sum(axis=1))

        def fits(ask: np.ndarray, node: np.ndarray) -> np.ndarray:
            if same:
                return (self.low[node] <= label[ask]) & (label[ask] <= self.high[node])
            return (self.low[node] != label[ask]) | (self.high[node] != label[ask])

        def verify(ask: np.ndarray, leaf: int) -> None:
            a, b = self.start[leaf], self.stop[leaf]
            score = (asks[ask] @ points[a:b].T).astype(np.int64)
            ok = (score >= lo[ask, None]) & (score <= hi[ask, None]) & (self.ids[a:b] != who[ask, None])
            ok &= ((self.labels[a:b] == label[ask, None]) == same) & (score >= best[ask, -1:])
            some = np.flatnonzero(ok.any(axis=1))
            if len(some):
                ask = ask[some]
                ids = np.concatenate([best_id[ask], np.where(ok[some], self.ids[a:b], 0)], axis=1)
                scores = np.concatenate([best[ask], np.where(ok[some], score[some], NONE)], axis=1)
                order = np.lexsort((ids, ~scores), axis=1)[:, :k]
                best_id[ask], best[ask] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

        def below(ask: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            width = self.last[node] - self.first[node]
            inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            return np.repeat(ask, width), np.repeat(self.first[node], width) + inner

        def by_leaf(ask: np.ndarray, node: np.ndarray) -> None:
            order = np.argsort(node, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else []:
                verify(ask[part], int(node[part[0]]))

        # The most promising leaf first: what it holds lets the walk from the root drop nodes at every level.
        dive = np.zeros(n, np.int64)
        while len(open_ := np.flatnonzero(self.last[dive] > 0)):
            ask, node = below(open_, dive[open_])
            low, high = self.bounds(q[ask], length[ask], node)
            promise = np.where((high >= lo[ask]) & (low <= hi[ask]) & fits(ask, node), np.minimum(high, hi[ask]), -np.inf)
            order = np.lexsort((-promise, ask))
            dive[open_] = node[order[np.searchsorted(ask[order], open_)]]
        by_leaf(np.arange(n), dive)
        ask, node = np.arange(n), np.zeros(n, np.int64)
        leaves: list[tuple] = []
        while len(ask):
            low, high = self.bounds(q[ask], length[ask], node)
            high = np.minimum(high, hi[ask])
            keep = (high >= np.maximum(lo[ask], best[ask, -1])) & (low <= hi[ask]) & fits(ask, node)
            ask, node, high = ask[keep], node[keep], high[keep]
            leaf = self.last[node] == 0
            fresh = leaf & (node != dive[ask])
            leaves.append((ask[fresh], node[fresh], high[fresh]))
            ask, node = below(ask[~leaf], node[~leaf])
        ask, node, key = (np.concatenate(c) for c in zip(*leaves))
        order = np.lexsort((node, -key, ask))
        ask, node, key = ask[order], node[order], key[order]
        turn = np.arange(len(ask)) - np.searchsorted(ask, ask)   # how many better leaves the query has
        done, step = 0, 1
        while done <= turn.max(initial=-1):
            here = np.flatnonzero((turn >= done) & (turn < done + step))
            here = here[key[here] >= best[ask[here], -1]]
            by_leaf(ask[here], node[here])
            done, step = done + step, step * 2
        return best_id, best

    def row(self, cell: int, block: int) -> tuple:
        parts = (self.x, self.ids, self.labels, self.centre, self.radius, self.first, self.last, self.start, self.stop)
        return (cell, block, *(np.ascontiguousarray(p).tobytes() for p in parts))

    @classmethod
    def load(cls, row, dim: int) -> CoverTree:
        whole = lambda name: np.frombuffer(getattr(row, name), np.int64).copy()
        return cls(np.frombuffer(row.x).reshape(-1, dim), whole("ids"), whole("labels"), whole("centre"), np.frombuffer(row.radius),
                   whole("first"), whole("last"), whole("start"), whole("stop"))


class Forest:
    """The trees of all candidates as a table, with what decides which anchors a tree has to see."""

    def __init__(self, rows: DataFrame, cells: int | None = None):
        self.rows = rows
        total = rows.count()
        self.dim = dim = max(1, rows.select(F.size("x").alias("d")).first().d) if total else 1
        k = cells or int(min(MAX_CELLS, max(1, -(-total // TREE))))
        size = min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // dim))
        sample = rows.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(size).collect()
        self.centre = centroids_of(np.array([r.x for r in sample]).reshape(len(sample), -1), k) if sample else np.zeros((1, dim))
        centre = self.centre

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.stack(batch["x"].to_numpy())
                cell = nearest(x, centre)
                yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "cell": cell, "x": [r.tobytes() for r in x],
                                    "away": np.sqrt(((x - centre[cell])**2).sum(axis=1))})
        placed = scratch.table(rows.mapInPandas(place, "id long, label long, cell int, x binary, away double"), "cover-cells")
        self.placed = placed
        # One row per cell, at most MAX_CELLS.
        stats = {r.cell: (r.n, r.away) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()}
        self.blocks = np.array([-(-stats.get(c, (0, 0.0))[0] // TREE) for c in range(len(centre))], np.int64)
        self.away = np.array([stats.get(c, (0, 0.0))[1] for c in range(len(centre))])
        counts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TREE).cast("int").alias("blocks"))
        placed = placed.join(F.broadcast(counts), "cell")   # one row per cell
        placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

        def grow(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("id")
            tree = CoverTree.build(np.stack([np.frombuffer(v) for v in group["x"]]), group["id"].to_numpy(), group["label"].to_numpy())
            return pd.DataFrame([tree.row(group["cell"].iloc[0], group["block"].iloc[0])], columns=[c.split()[0] for c in _TREE.split(", ")])
        self.trees = scratch.table(placed.groupBy("cell", "block").applyInPandas(grow, _TREE), "cover-trees")

    def ask(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """anchor, window, id, score: up to k per window and tree. ``anchors``: anchor, label, x, lo, hi (arrays of windows)."""
        centre, blocks, away, dim = self.centre, self.blocks, self.away, self.dim

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                q = np.stack([np.frombuffer(v) for v in batch["x"]])
                mid, wide = q @ centre.T, np.sqrt((q**2).sum(axis=1))[:, None] * away * (1 + 1e-9) + 1
                least = np.array([min(v, default=0) for v in batch["lo"]], float)[:, None]
                most = np.array([max(v, default=-1) for v in batch["hi"]], float)[:, None]
                who, cell = np.nonzero((mid + wide >= least) & (mid - wide <= most) & (blocks > 0))
                times = blocks[cell]
                who, cell = np.repeat(who, times), np.repeat(cell, times)
                block = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                for lo in range(0, len(who), 4096):
                    part = slice(lo, lo + 4096)
                    yield batch.iloc[who[part]].assign(cell=cell[part], block=block[part])
        sent = anchors.mapInPandas(send, "anchor long, label long, x binary, lo array<long>, hi array<long>, cell int, block int")
        turns = max(1, -(-anchors.count() // TURN))
        sent = sent.withColumn("turn", F.pmod(F.xxhash64("anchor"), F.lit(turns)).cast("int"))
        trees = self.trees.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

        def descend(tree: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(tree) and len(asks):
                grown = CoverTree.load(next(tree.itertuples()), dim)
                asks = asks.sort_values("anchor")
                times = asks["lo"].str.len().to_numpy()
                row = np.repeat(np.arange(len(asks)), times)
                window = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                q = np.stack([np.frombuffer(v) for v in asks["x"]])
                who, label = asks["anchor"].to_numpy(), asks["label"].to_numpy()
                lo, hi = (np.concatenate(asks[c].to_numpy()).astype(np.int64) for c in ("lo", "hi"))
                for at in range(0, len(row), 2048):
                    r = row[at:at + 2048]
                    ids, scores = grown.search(q[r], who[r], label[r], same, lo[at:at + 2048], hi[at:at + 2048], k)
                    for j in np.flatnonzero(scores[:, 0] != NONE):
                        ok = scores[j] != NONE
                        out.append((who[r[j]], int(window[at + j]), ids[j][ok], scores[j][ok]))
            return pd.DataFrame(out, columns=["anchor", "window", "ids", "scores"])
        found = sent.groupBy("cell", "block", "turn").cogroup(trees.groupBy("cell", "block", "turn")).applyInPandas(
            lambda a, t: descend(t, a), "anchor long, window int, ids array<long>, scores array<long>")
        return found.select("anchor", "window", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score"))).alias("f")).select(
            "anchor", "window", "f.id", "f.score")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window over all trees, with their rank."""
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90),
         cells: int | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. ``rows``: as from ``candidates``."""
    rows = scratch.table(rows, "cover-rows")
    forest = Forest(rows, cells)
    asks = forest.placed.filter(anchors).select(F.col("id").alias("anchor"), "label", "x")
    all_scores = asks.select("*", F.array(F.lit(1 - 2**63)).alias("lo"), F.array(F.lit(2**63 - 1)).alias("hi"))
    first = best(forest.ask(all_scores, True, positives), positives)
    first = scratch.table(first.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "cover-positives")
    low, high = percent
    # Whole scores between two percentages of the positive's: the bounds rounded inwards, in integers.
    exact = F.col("positive_score").cast("decimal(20,0)")
    lo, hi = (f(exact * F.lit(part / 100).cast("decimal(5,2)")).cast("long") for f, part in ((F.ceil, low), (F.floor, high)))
    windows = first.select("anchor", F.struct("place", lo.alias("lo"), hi.alias("hi")).alias("w")).groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("w"))
    windows = windows.select("anchor", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    again = scratch.table(asks.join(windows, "anchor").select("anchor", "label", "x", "lo", "hi"), "cover-windows")
    found = best(forest.ask(again, False, negatives), negatives)
    found = found.select("anchor", (F.col("window") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(first, ["anchor", "place"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
