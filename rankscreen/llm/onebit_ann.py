"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Index: coarse centroids, fitted on a bounded sample, divide all vectors into cells; the residual to the centroid is
rotated by a random orthogonal matrix and kept as one sign bit per dimension, with its length and the inner product of
the residual's direction and its code as correction scalars. Every valid vector is indexed.

Search: a query first visits its most promising cells (by centroid product plus a share of the cell's radius), as many as
hold the wanted number of vectors. The k-th best score found there decides the rest: every other cell whose centroid
product plus the query's length times its largest residual reaches that score is visited too, so no cell is left out by
its number or by the size of the table. On data without clusters these are nearly all cells. In a cell the packed bits and
the scalars give an estimate of every inner product and a bound of its error; vectors whose upper bound reaches the k-th best lower bound are reranked on the original vectors
in double precision. Cells and the queries of a cell are cut into blocks of bounded size by a hash of the id, so a
cell with a third of all vectors is many groups.

Defined results: vectors that are null, zero, of another dimension than the most common one, or hold a null or
non-finite component take no part; rows that share an id are one vector; equal products rank by the smaller id; a query
has fewer than k rows only if there are fewer candidates; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

SAMPLE_ROWS = 20_000
SAMPLE_VALUES = 4_000_000
MAX_CELLS = 16_384
CELL_ROWS = 2048
BLOCK = 4096
QUERY_BLOCK = 2048
#: Standard deviations of the estimate that the error bound spans.
SPAN = 3.0
RESULT = "query_id long, vec_id long, score double"


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double), one row per id."""
    v = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).first()
    rows = rows.filter(F.size("v") == (common.dim if common else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def centroids_of(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, centre)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centre))
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(centre, axis=0)


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre**2).sum(axis=1) / 2
    return np.concatenate([(half - x[i:i + 2048] @ centre.T).argmin(axis=1) for i in range(0, len(x), 2048)] or [np.zeros(0, int)])


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual lengths, and inner products of residual direction and code."""
    rest = (x - centre) @ turn.T
    length = np.linalg.norm(rest, axis=1)
    agree = np.abs(rest).sum(axis=1) / np.sqrt(rest.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(rest > 0, axis=1), length, np.where(length > 0, agree, 1.0)


def estimate(bits: np.ndarray, length: np.ndarray, agree: np.ndarray, dim: int, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated products of residuals (rows) and rotated queries (columns), and the bound of their error."""
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    raw = (signs @ turned.T.astype(np.float32)) / np.sqrt(dim)
    spread = np.sqrt(np.maximum(0, 1 - agree**2)) / agree * length / np.sqrt(max(1, dim - 1)) * SPAN
    return raw * (length / agree)[:, None], spread[:, None] * np.linalg.norm(turned, axis=1)


def search(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           cells: int | None = None, visits: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each vector whose id is divisible by ``every``."""
    vectors = scratch.table(valid_vectors(table, id_col, vec_col), "ann-vectors")
    total = vectors.count()
    if not total:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim = vectors.select(F.size("v").alias("d")).first().d
    cells = cells or int(min(MAX_CELLS, max(1, -(-total // CELL_ROWS))))
    rows = min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // dim))
    sample = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).collect()
    centre, turn = centroids_of(np.array([r.v for r in sample]), cells), rotation(dim)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["v"].to_numpy())
            cell = nearest(x, centre)
            bits, length, agree = encode(x, centre[cell], turn)
            yield pd.DataFrame({"cell": cell, "vec_id": batch["vec_id"], "bits": [b.tobytes() for b in bits], "length": length,
                                "agree": agree, "v": [r.tobytes() for r in x]})
    coded = vectors.mapInPandas(index, "cell int, vec_id long, bits binary, length double, agree double, v binary")
    coded = scratch.table(coded, "ann-codes")
    # One row per cell, at most MAX_CELLS.
    stats = {r.cell: (r.n, r.radius, r.reach) for r in coded.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.avg("length").alias("radius"), F.max("length").alias("reach")).collect()}
    count, radius, reach = (np.array([stats.get(c, (0, 0.0, 0.0))[i] for c in range(len(centre))]) for i in range(3))

    def promising(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of each query in order, how many of them hold k + 1 vectors, and an upper bound of the products in each cell."""
        product, size = q @ centre.T, np.linalg.norm(q, axis=1)[:, None]
        order = np.argsort(np.where(count > 0, -(product + 0.5 * size * radius), np.inf), axis=1, kind="stable")
        first = (np.cumsum(count[order], axis=1) - count[order] < k + 1).sum(axis=1)
        return order, first, product + size * reach + 1e-9 * (np.abs(product) + size * reach)

    def visit(later: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                order, first, most = promising(np.stack([np.frombuffer(v) for v in batch["q"]]))
                chosen = [o[n:visits] if later else o[:n] for o, n in zip(order, first)]
                chosen = [o[(count[o] > 0) & (m[o] >= least)].tolist() for o, m, least in zip(chosen, most, batch["least"])]
                yield batch.assign(cell=chosen)
        return run
    queries = coded.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    queries = queries.withColumn("least", F.lit(float("-inf")))
    kind = "query_id long, q binary, least double, cell array<int>"

    def asked(rows: DataFrame, later: bool) -> DataFrame:
        rows = rows.mapInPandas(visit(later), kind).withColumn("cell", F.explode("cell"))
        return scratch.table(_compared(coded, scratch.table(rows, "ann-visits"), centre, turn, dim, k), "ann-found")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = asked(queries, False)
    kth = near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("found"))
    rest = queries.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("found", "least").alias("least"))
    found = near.unionByName(asked(rest, True))
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _compared(coded: DataFrame, queries: DataFrame, centre: np.ndarray, turn: np.ndarray, dim: int, k: int) -> DataFrame:
    """The k best of each visited block, at or above the query's ``least``, by estimate, bound and exact rerank."""
    sizes = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("turns"))
    plan = scratch.table(sizes.join(asked, "cell"), "ann-plan")
    here = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = coded.join(plan, "cell").withColumn("block", here("vec_id", "blocks")).withColumn("turn", each("turns")).drop("blocks", "turns")
    asks = queries.join(plan, "cell").withColumn("turn", here("query_id", "turns")).withColumn("block", each("blocks")).drop("blocks", "turns")

    def compare(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(a):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        d = d.sort_values("vec_id")
        ids, x = d["vec_id"].to_numpy(), np.stack([np.frombuffer(v) for v in d["v"]])
        bits = np.stack([np.frombuffer(b, np.uint8) for b in d["bits"]])
        q, c, floor = np.stack([np.frombuffer(v) for v in a["q"]]), centre[d["cell"].iloc[0]], a["least"].to_numpy()
        out = []
        for lo in range(0, len(q), 128):
            part = q[lo:lo + 128]
            near, bound = estimate(bits, d["length"].to_numpy(), d["agree"].to_numpy(), dim, part @ turn.T)
            # Estimates leave out the centroid's share, which all vectors of the cell have in common.
            known = floor[lo:lo + 128] - part @ c
            for j, (query, qid) in enumerate(zip(part, a["query_id"].to_numpy()[lo:lo + 128])):
                lower = np.where(ids == qid, -np.inf, near[:, j] - bound[:, j])
                least = max(known[j], np.partition(lower, -k)[-k] if len(lower) > k else -np.inf)
                pick = np.flatnonzero((near[:, j] + bound[:, j] >= least) & (ids != qid))
                score = (x[pick] * query).sum(axis=1)
                pick, score = pick[score >= floor[lo + j]], score[score >= floor[lo + j]]
                best = np.lexsort((ids[pick], -score))[:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[pick][best], "score": score[best]}))
        return pd.concat(out).astype({"query_id": "int64", "vec_id": "int64"})
    return data.groupBy("cell", "block", "turn").cogroup(asks.groupBy("cell", "block", "turn")).applyInPandas(compare, RESULT)
