"""Near-duplicate vectors on a flat graph, robustly pruned, built on overlapping cluster shards.

1. Vectors of one direction collapse to one node with a count. Centroids of a bounded sample make cells; every node
   belongs to its two nearest cells, so neighbouring shards overlap. A cell too large for a task is cut by a hash of
   the node into blocks; a shard is one block of a cell.
2. A shard picks candidate neighbours of each of its nodes, prunes them robustly (a candidate goes when a chosen
   neighbour is closer to it, by a factor, than the node is), adds the reverse edges that fit, and links what its
   medoid cannot reach to the nearest node it can.
3. The adjacency lists of a node's shards are united.
4. Every node searches the shards of its nearest cells. In a shard that it belongs to it starts at itself, in others
   a greedy search starts at the medoid. From where it stands the search expands as long as it meets nodes within the
   range (and a margin below it), however many they are; cosines are in double precision.
5. A pair is visible in several shards and is counted in the first of them only; which one that is follows from the
   cells of both its nodes. Counts per node and a spanning forest leave a task, never its pairs.
6. Audit: the links of a bounded sample of nodes are counted against all nodes by brute force. While the recall is
   below the target and cells are left, the search is repeated with twice as many cells per node.

Defined results: vectors that are null, zero, of another dimension than the most common one, or hold a null or
non-finite component have no links and are their own component; rows that share an id are one vector and get the same
result; a row without id is kept, with no links and no component; an empty table gives no rows; other columns play no
part. Equal vectors are linked like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .hashing import mix
from .minhash import components
from .onebit_ann import centroids_of, valid_vectors

THRESHOLD = 0.9
#: How far below the range the expansion still walks.
MARGIN = 0.05
SHARD = 8192
OVERLAP = 2
MAX_CELLS = 16_384
SAMPLE_ROWS = 20_000
SAMPLE_VALUES = 4_000_000
#: Candidates by nearness and at random, edges kept, and the factor of the robust prune (on squared distances).
NEAR, FAR, DEGREE, ALPHA = 48, 16, 20, 1.44
#: Width of the greedy search.
BEAM = 16
PROBES = 4
VISITORS = 32_768
AUDIT = 256
TARGET = 0.98
_VISIT = "cell int, block int, turn int, node long, u binary, copies long, near array<int>, member boolean, nbrs array<long>"


def block_of(node: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (mix(node.astype(np.int64).view(np.uint64)) % np.maximum(blocks, 1).astype(np.uint64)).astype(np.int64)


def nearest_cells(u: np.ndarray, centre: np.ndarray, p: int) -> np.ndarray:
    """The p nearest centroids of each row, nearest first."""
    half = (centre**2).sum(axis=1) / 2
    out = [np.argsort(half - u[i:i + 1024] @ centre.T, axis=1, kind="stable")[:, :p] for i in range(0, len(u), 1024)]
    return np.concatenate(out) if out else np.zeros((0, p), np.int64)


def robust_prune(u: np.ndarray, node: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each of ``node`` the kept ones of its row of ``pool`` (-1: none), nearest first."""
    away = 2 - 2 * np.einsum("nd,ncd->nc", u[node], u[pool])
    order = np.argsort(away, axis=1, kind="stable")
    pool, away = np.take_along_axis(pool, order, 1), np.take_along_axis(away, order, 1)
    repeated = np.zeros(pool.shape, bool)
    ranked = np.argsort(pool, axis=1, kind="stable")
    again = np.diff(np.take_along_axis(pool, ranked, 1), axis=1) == 0
    np.put_along_axis(repeated, ranked[:, 1:], again, 1)
    alive = (pool != node[:, None]) & ~repeated
    v = u[pool]
    between = 2 - 2 * (v @ v.transpose(0, 2, 1))
    kept, rows = np.full((len(node), degree), -1, np.int64), np.arange(len(node))
    for j in range(degree):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        kept[some, j] = pool[rows, pick][some]
        alive &= ~((alpha * between[rows, pick] <= away) & some[:, None])
        alive[rows, pick] = False
    return kept


def build_graph(u: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the pruned graph of one shard's unit vectors; its medoid reaches every node."""
    n = len(u)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    f, rng = u.astype(np.float32), np.random.default_rng(seed)
    heads, tails = [], []
    for lo in range(0, n, 512):
        node = np.arange(lo, min(n, lo + 512))
        near = f[node] @ f.T
        near[np.arange(len(node)), node] = -np.inf
        k = min(NEAR, n - 1)
        pool = np.argpartition(-near, k - 1, axis=1)[:, :k]
        pool = np.concatenate([pool, rng.integers(0, n, (len(node), FAR))], axis=1)
        kept = robust_prune(f, node, pool)
        at = kept >= 0
        heads.append(np.repeat(node, at.sum(axis=1)))
        tails.append(kept[at])
    a, b = np.concatenate(heads), np.concatenate(tails)
    # Reverse edges, the nearest of each node.
    away = 2 - 2 * np.einsum("nd,nd->n", f[a], f[b])
    order = np.lexsort((away, b))
    back, to = b[order], a[order]
    fits = np.arange(len(back)) - np.searchsorted(back, back) < DEGREE
    a, b = unique_edges(np.r_[a, back[fits]], np.r_[b, to[fits]], n)
    while True:
        reached = reach(a, b, n, medoid(u))
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return a, b
        known = np.flatnonzero(reached)
        best = np.concatenate([(f[lost[i:i + 512]] @ f[known].T).argmax(axis=1) for i in range(0, len(lost), 512)])
        gain = np.einsum("nd,nd->n", f[lost], f[known[best]])
        order = np.lexsort((-gain, best))
        first = order[np.r_[True, np.diff(best[order]) > 0]]   # the closest lost node of each known one
        a, b = unique_edges(np.r_[a, known[best[first]], lost[first]], np.r_[b, lost[first], known[best[first]]], n)


def unique_edges(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(a * n + b)
    return key // n, key % n


def medoid(u: np.ndarray) -> int:
    return int((u @ u.mean(axis=0)).argmax())


def reach(a: np.ndarray, b: np.ndarray, n: int, start: int) -> np.ndarray:
    """Which nodes the sorted edges lead to from ``start``."""
    seen, front = np.zeros(n, bool), np.array([start])
    seen[start] = True
    begin, end = np.searchsorted(a, np.arange(n)), np.searchsorted(a, np.arange(n), "right")
    while len(front):
        width = end[front] - begin[front]
        at = np.repeat(begin[front], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        front = np.unique(b[at][~seen[b[at]]])
        seen[front] = True
    return seen


def padded(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The adjacency lists of sorted edges as rows, filled with -1."""
    width = np.bincount(a, minlength=n)
    out = np.full((n, max(1, int(width.max(initial=0)))), -1, np.int64)
    out[a, np.arange(len(a)) - np.searchsorted(a, a)] = b
    return out


def greedy(u: np.ndarray, graph: np.ndarray, q: np.ndarray, start: int, width: int = BEAM) -> np.ndarray:
    """The ``width`` best nodes that a greedy search from ``start`` ends with, per query (-1: none)."""
    n, rows = len(q), np.arange(len(q))
    best, score = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, u.dtype)
    best[:, 0], score[:, 0] = start, q @ u[start]
    done = np.ones((n, width), bool)
    done[:, 0] = False
    seen = np.zeros((n, len(u)), bool)
    seen[:, start] = True
    while True:
        pick = (~done).argmax(axis=1)     # rows are sorted, so the first open slot is the best open node
        live = np.flatnonzero(~done[rows, pick])
        if not len(live):
            return best
        done[live, pick[live]] = True
        step = graph[best[live, pick[live]]]
        ok = (step >= 0) & ~seen[live[:, None], step]
        who, where = np.nonzero(ok)
        seen[live[who], step[who, where]] = True
        gain = np.full(step.shape, -np.inf, u.dtype)
        gain[who, where] = np.einsum("nd,nd->n", q[live[who]], u[step[who, where]])
        ids = np.concatenate([best[live], np.where(ok, step, -1)], axis=1)
        all_ = np.concatenate([score[live], gain], axis=1)
        flags = np.concatenate([done[live], ~ok], axis=1)
        order = np.argsort(-all_, axis=1, kind="stable")[:, :width]
        best[live], score[live], done[live] = (np.take_along_axis(c, order, 1) for c in (ids, all_, flags))


def expand(u: np.ndarray, graph: np.ndarray, q: np.ndarray, starts: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) of all nodes of at least ``low`` that such nodes lead to from the starts of each query."""
    seen = np.zeros((len(q), len(u)), bool)
    who, slot = np.nonzero(starts >= 0)
    node, found = starts[who, slot], []
    while len(who):
        fresh = np.zeros_like(seen)
        fresh[who, node] = True
        who, node = np.nonzero(fresh & ~seen)
        seen |= fresh
        cosine = np.concatenate([np.einsum("nd,nd->n", q[who[i:i + 65536]], u[node[i:i + 65536]]) for i in range(0, len(who), 65536)] or [np.zeros(0)])
        keep = cosine >= low
        who, node = who[keep], node[keep]
        found.append((who, node, cosine[keep]))
        near = graph[node]
        at, slot = np.nonzero(near >= 0)
        who, node = who[at], near[at, slot]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest member) after joining a and b pairwise."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def first_place(near_x: np.ndarray, near_y: np.ndarray) -> np.ndarray:
    """The smallest cell in which a pair is visible: one of it belongs there, the other searches there."""
    big = np.iinfo(np.int64).max
    out = np.full(len(near_x), big, np.int64)
    for mine, other in ((near_x, near_y), (near_y, near_x)):
        for j in range(min(OVERLAP, mine.shape[1])):
            cell = mine[:, j]
            out = np.minimum(out, np.where((other == cell[:, None]).any(axis=1), cell, big))
    return out


def search_shard(cell: int, block: int, blocks: int, rows: pd.DataFrame, threshold: float, turn: int) -> pd.DataFrame:
    """node, links, root for the nodes of one shard and its visitors that have links counted or joined here."""
    rows = rows.sort_values("node")
    inside, visit = rows[rows["member"]], rows[~rows["member"]]
    near = np.stack(rows["near"].to_numpy()).astype(np.int64)
    is_member = rows["member"].to_numpy()
    names, copies = np.r_[inside["node"].to_numpy(), visit["node"].to_numpy()], np.r_[inside["copies"].to_numpy(), visit["copies"].to_numpy()]
    near = np.concatenate([near[is_member], near[~is_member]])
    n = len(inside)
    if not n:
        return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
    u = np.stack([np.frombuffer(v) for v in inside["u"]])
    width = inside["nbrs"].str.len().fillna(0).to_numpy().astype(np.int64)
    to = np.concatenate([np.asarray(v, np.int64) for v in inside["nbrs"] if v is not None] or [np.zeros(0, np.int64)])
    own = names[:n]
    place = np.minimum(np.searchsorted(own, to), n - 1)
    here = own[place] == to
    graph = padded(*unique_edges(np.repeat(np.arange(n), width)[here], place[here], n), n)
    links, label = np.zeros(len(names), np.int64), np.arange(len(names))

    def counts_here(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs (visitor or member x, member y) this shard is to count."""
        ok = first_place(near[x], near[y]) == cell
        # Members of one cell in different blocks meet in both blocks; the later one counts.
        both = (near[x][:, :OVERLAP] == cell).any(axis=1) & (x >= n)
        return ok & (~both | (block_of(names[x], np.full(len(x), blocks)) < block))
    if turn == 0:
        linked = np.zeros((n, n), bool)
        for lo in range(0, n, 256):
            who, node, cosine = expand(u, graph, u[lo:lo + 256], np.arange(lo, min(n, lo + 256))[:, None], threshold - MARGIN)
            hit = (cosine >= threshold) & (who + lo != node)
            linked[who[hit] + lo, node[hit]] = True
        linked |= linked.T
        for lo in range(0, n, 256):
            x, y = np.nonzero(linked[lo:lo + 256])
            x += lo
            label = hook(label, x, y)
            mine = counts_here(x, y)
            links += np.bincount(x[mine], copies[y[mine]], len(names)).astype(np.int64)
    f, f_start = u.astype(np.float32), medoid(u)
    for lo in range(0, len(visit), 256):
        q = np.stack([np.frombuffer(v) for v in visit["u"].iloc[lo:lo + 256]])
        starts = greedy(f, graph, q.astype(np.float32), f_start)
        who, node, cosine = expand(u, graph, q, starts, threshold - MARGIN)
        hit = cosine >= threshold
        x, y = who[hit] + lo + n, node[hit]
        label = hook(label, x, y)
        mine = counts_here(x, y)
        links += np.bincount(x[mine], copies[y[mine]], len(names)).astype(np.int64) + np.bincount(y[mine], copies[x[mine]], len(names)).astype(np.int64)
    out = (links > 0) | (label != np.arange(len(names)))
    return pd.DataFrame({"node": names[out], "links": links[out], "root": names[label[out]]}).astype("int64")


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v**2).sum(axis=1, keepdims=True))


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None,
                    probes: int = PROBES, target: float = TARGET) -> DataFrame:
    """``vec_id, n_links, component_id, kept, audited_recall``, one row per input row."""
    spark = table.sparkSession

    def turn_to_unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u = unit(np.stack(batch["v"].to_numpy()))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "u": [r.tobytes() for r in u]})
    units = valid_vectors(table, id_col, vec_col).mapInPandas(turn_to_unit, "vec_id long, u binary")
    units = scratch.table(units.withColumn("key", F.sha2("u", 256)), "graph-units")
    nodes = units.groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("u").alias("u"))
    nodes = scratch.table(nodes, "graph-nodes")
    total = nodes.count()
    ids = table.select(F.col(id_col).cast("long").alias("vec_id"))
    if not total:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                          F.col("vec_id").isNotNull().alias("kept"), F.lit(1.0).alias("audited_recall"))
    dim = nodes.select((F.octet_length("u") / 8).cast("int").alias("d")).first().d
    k = cells or int(min(MAX_CELLS, max(1, -(-OVERLAP * total // SHARD))))
    rows = min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // dim))
    sample = nodes.select("node", "u").orderBy(F.xxhash64("node"), "node").limit(rows).collect()
    centre = centroids_of(np.stack([np.frombuffer(r.u) for r in sample]), k)
    k = len(centre)

    def locate(p: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                near = nearest_cells(np.stack([np.frombuffer(v) for v in batch["u"]]), centre, p)
                yield batch.assign(near=list(near.astype(np.int32)))
        return nodes.select("node", "u", "copies").mapInPandas(run, "node long, u binary, copies long, near array<int>")

    def per_cell(near: DataFrame, first: int) -> np.ndarray:
        """Nodes per cell among the first cells of each node: one row per cell, at most MAX_CELLS."""
        got = near.select(F.explode(F.slice("near", 1, first)).alias("cell")).groupBy("cell").count().collect()
        out = np.zeros(k, np.int64)
        out[[r.cell for r in got]] = [r["count"] for r in got]
        return out
    own = locate(min(OVERLAP, k))
    blocks = -(-per_cell(own, OVERLAP) // SHARD)

    def into_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = np.stack(batch["near"].to_numpy())
            for j in range(near.shape[1]):
                cell = near[:, j].astype(np.int64)
                yield pd.DataFrame({"cell": cell, "block": block_of(batch["node"].to_numpy(), blocks[cell]), "node": batch["node"], "u": batch["u"]})

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        names = group["node"].to_numpy()
        a, b = build_graph(np.stack([np.frombuffer(v) for v in group["u"]]), int(group["cell"].iloc[0]))
        ends = np.cumsum(np.bincount(a, minlength=len(names)))
        return pd.DataFrame({"node": names, "nbrs": np.split(names[b], ends[:-1])})
    shards = own.mapInPandas(into_shards, "cell int, block int, node long, u binary")
    lists = scratch.table(shards.groupBy("cell", "block").applyInPandas(grow, "node long, nbrs array<long>"), "graph-lists")
    # The united adjacency list of a node: bounded, as it comes from at most OVERLAP shards.
    graph = scratch.table(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs")), "graph-union")

    def search(p: int) -> DataFrame:
        located = scratch.table(locate(p), "graph-located")
        turns = np.maximum(1, -(-per_cell(located, p) // VISITORS))

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                near, node = np.stack(batch["near"].to_numpy()).astype(np.int64), batch["node"].to_numpy()
                for j in range(p):
                    cell = near[:, j]
                    times = blocks[cell]
                    at = np.repeat(np.arange(len(batch)), times)
                    block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    member = (j < OVERLAP) & (block == block_of(node[at], times[at]))
                    # A member is in every turn of its shard, a visitor in one.
                    times = np.where(member, turns[cell[at]], 1)
                    turn = np.where(member, 0, block_of(node[at] + 1, turns[cell[at]]))
                    pick = np.repeat(np.arange(len(at)), times)
                    turn = turn[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
                    rows, of = at[pick], member[pick]
                    for lo in range(0, len(rows), 4096):
                        part = slice(lo, lo + 4096)
                        some = batch.iloc[rows[part]]
                        yield pd.DataFrame({"cell": cell[rows[part]], "block": block[pick[part]], "turn": turn[part], "node": some["node"].to_numpy(),
                                            "u": some["u"].to_numpy(), "copies": some["copies"].to_numpy(), "near": some["near"].to_numpy(),
                                            "member": of[part], "nbrs": [v if m else None for v, m in zip(some["nbrs"], of[part])]})

        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            return search_shard(key[0], key[1], int(blocks[key[0]]), group, threshold, key[2])
        sent = located.join(graph, "node").mapInPandas(visits, _VISIT)
        found = sent.groupBy("cell", "block", "turn").applyInPandas(run, "node long, links long, root long")
        return scratch.table(found, "graph-found")

    p = min(probes, k)
    while True:
        found = search(p)
        links = scratch.table(found.groupBy("node").agg(F.sum("links").alias("links")), "graph-links")
        recall = audit(nodes, links, threshold)
        if recall >= target or p >= k:
            break
        p = min(k, 2 * p)
    edges = found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    labels = components(edges).withColumnRenamed("component", "class")
    one = nodes.join(links, "node", "left").join(labels, "node", "left")
    one = one.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("class", "node").alias("class"))
    known = units.select("vec_id", "key").join(one, "key").select("vec_id", "n", "class")
    out = ids.join(known, "vec_id", "left")
    component = F.coalesce("class", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("audited_recall"))


def audit(nodes: DataFrame, links: DataFrame, threshold: float, size: int = AUDIT) -> float:
    """Found links over links by brute force, of nodes chosen by a hash: half of all nodes, half of those with links."""
    by_hash = lambda df: df.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(size // 2)
    chosen = by_hash(nodes.select("node")).unionByName(by_hash(links.filter("links > 0").select("node"))).distinct()
    chosen = nodes.join(chosen, "node").join(links, "node", "left").select("node", "u", F.coalesce("links", F.lit(0)).alias("links")).collect()
    q, who = np.stack([np.frombuffer(r.u) for r in chosen]), np.array([r.node for r in chosen])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(who), np.int64)
        for batch in batches:
            near = np.stack([np.frombuffer(v) for v in batch["u"]]) @ q.T >= threshold
            near &= batch["node"].to_numpy()[:, None] != who
            total += batch["copies"].to_numpy() @ near
        yield pd.DataFrame({"node": who, "links": total})
    true = nodes.select("node", "u", "copies").mapInPandas(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).collect()
    true = {r.node: r.links for r in true}
    wanted = sum(true.values())
    return 1.0 if not wanted else sum(min(r.links, true[r.node]) for r in chosen) / wanted
