"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact sets, star components.

1. A text becomes the set of its distinct five-word shingles (64-bit hashes), of which 128 multiply-shift hashes keep
   the minima. Texts with equal sets collapse to their smallest id first, so a group of copies is one node from here on.
2. 32 bands of 4 minima make buckets; a pair of similarity 0.75 shares none with probability (1 - 0.75**4)**32 < 1e-5.
   In each bucket every member is paired with the smallest one only.
3. Pairs whose signatures agree in fewer than 72 of 128 places, five standard deviations below 0.75, are dropped; the
   others are decided on the full shingle sets of both texts.
4. Components by alternating large-star and small-star.
5. A bucket whose members are not all in one component may still hide links between members other than the smallest.
   Its members are compared by signature, in blocks of bounded size, and only a spanning forest of the pairs that pass
   leaves the task: it joins components into clusters. Every cluster then gets the full sets of its members once,
   again in blocks, and decides all pairs of different components; only the links that join components come out. No
   member is left out however large a bucket or cluster is, and no list of pairs is ever written.

Defined results: null, empty and wordless texts have no shingles, no links and stay; rows that share a doc_id are one
document; a row without doc_id is kept, has no component and links to nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .hashing import mix, shingle_set

SHINGLE = 5
HASHES = 128
ROWS_PER_BAND = 4
PERCENT = 75
LEAST_AGREEMENT = 72
BLOCK = 512
BLOCK_BYTES = 16 << 20

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the smallest a*x + b (mod 2**64) for each hash function."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        block = shingles[at:at + 1024]
        np.minimum(low, (_A[:, None] * block + _B[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (128 bits that name the set), sig (null without shingles)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                s = shingle_set(text if isinstance(text, str) else "", shingle)
                k1, k2 = (int(np.sum(mix(s ^ np.uint64(c))).view(np.int64)) for c in (0x5555, 0xAAAA0000)) if len(s) else (0, 0)
                out.append((doc, len(s), k1, k2, minima(s) if len(s) else None))
            frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "k1", "k2", "sig"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInPandas(run, "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>")


def buckets(sets: DataFrame) -> DataFrame:
    """key, rep, leader of every bucket with two members or more."""
    bands = HASHES // ROWS_PER_BAND
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * ROWS_PER_BAND + 1, ROWS_PER_BAND)))
    placed = sets.select("rep", F.explode(keys).alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("leader")).filter(F.col("members") > 1)
    return placed.join(shared, "key")


def alike(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the wanted similarity."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.filter(sizes & (agree >= LEAST_AGREEMENT)).select("a", "b")


def confirmed(pairs: DataFrame, members: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs that reach the similarity on full shingle sets. ``members``: rep, text and more."""
    for side in ("a", "b"):
        pairs = pairs.join(members.select(F.col("rep").alias(side), F.col("text").alias(f"text_{side}")), side)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = None, None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (a, ta, tb) in enumerate(zip(batch["a"], batch["text_a"], batch["text_b"])):
                if a != last:
                    last, known = a, shingle_set(ta, shingle)
                keep[i] = reaches(known, shingle_set(tb, shingle), percent)
            yield batch.loc[keep, ["a", "b"]]
    return pairs.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    x, y = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


class Forest:
    """Disjoint sets of 0..n-1; ``links`` are the unions that joined two of them."""

    def __init__(self, groups: np.ndarray):
        first: dict = {}
        self.parent = np.array([first.setdefault(g, i) for i, g in enumerate(groups)])
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = int(self.parent[x])
        return x

    def roots(self, of: np.ndarray) -> np.ndarray:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent[of]

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a, b), by alternating stars.

    Each star is a minimum per node and a join back, so a node with very many neighbours is partially aggregated and
    its join can be split. Rounds end when a round changes no edge.
    """
    now = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "star-0")
    nodes = scratch.table(now.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "star-nodes")
    sign = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = sign(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.filter("u != v").distinct(), "star-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star-small")
        after = sign(now)
        if after == before:
            break
        before = after
    return nodes.join(now.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def in_blocks(placed: DataFrame, blocks: Column) -> DataFrame:
    """Each row for every pair of blocks of its group that it belongs to: columns i <= j, and its own block."""
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def _candidates(x: int, block: np.ndarray, within: bool, n: np.ndarray, sig: np.ndarray, forest: Forest, percent: int) -> np.ndarray:
    """Later rows that this block pair compares with row ``x``, not yet joined to it, best agreement first."""
    ys = np.arange(x + 1, len(n))
    ys = ys[(within | (block[ys] != block[x])) & (100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x]))]
    ys = ys[forest.roots(ys) != forest.root(x)]
    agree = (sig[ys] == sig[x]).sum(axis=1)
    return ys[np.argsort(-agree, kind="stable")][:int((agree >= LEAST_AGREEMENT).sum())]


def candidate_forest(buckets_: DataFrame, labels: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that span the signature-alike members of every bucket whose members are in different components."""
    placed = buckets_.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = (placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo != hi").select("key"))
    placed = placed.filter("rep != leader").join(open_, "key", "left_semi")
    placed = in_blocks(placed, F.ceil(F.col("members") / BLOCK).cast("int")).select("key", "i", "j", "block", "rep", "component")
    placed = placed.join(members.select("rep", "n_shingles", "sig"), "rep")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        rep, block, n = (group[c].to_numpy() for c in ("rep", "block", "n_shingles"))
        within, sig, forest = group["i"].iloc[0] == group["j"].iloc[0], np.stack(group["sig"].to_numpy()), Forest(group["component"].to_numpy())
        for x in range(len(rep) - 1):
            for y in _candidates(x, block, within, n, sig, forest, percent):
                forest.join(x, int(y))
        return pd.DataFrame([(rep[x], rep[y]) for x, y in forest.links], columns=["a", "b"]).astype("int64")
    return placed.groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def cluster_links(clusters: DataFrame, members: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) between the components of each cluster. ``clusters``: rep, cluster, component."""
    several = (clusters.groupBy("cluster").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"),
                                               F.sum("bytes").alias("total")).filter("lo != hi").select("cluster", "m", "total"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_BYTES)).cast("int")
    placed = in_blocks(clusters.join(several, "cluster"), blocks).select("cluster", "i", "j", "block", "rep", "component")
    placed = placed.join(members.select("rep", "n_shingles", "sig", "text"), "rep")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        rep, block, n = (group[c].to_numpy() for c in ("rep", "block", "n_shingles"))
        within, sig, forest = group["i"].iloc[0] == group["j"].iloc[0], np.stack(group["sig"].to_numpy()), Forest(group["component"].to_numpy())
        sets = [shingle_set(t, shingle) for t in group["text"]]
        for x in range(len(rep) - 1):
            for y in _candidates(x, block, within, n, sig, forest, percent):
                if forest.root(x) != forest.root(int(y)) and reaches(sets[x], sets[y], percent):
                    forest.join(x, int(y))
        return pd.DataFrame([(rep[x], rep[y]) for x, y in forest.links], columns=["a", "b"]).astype("int64")
    return placed.groupBy("cluster", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row."""
    found = scratch.table(sketches(docs, id_col, text_col, shingle), "minhash-sketches")
    sets = (found.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2")
            .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))
    sets = scratch.table(sets, "minhash-sets")
    shared = scratch.table(buckets(sets), "minhash-buckets")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    # The one join that moves whole texts: those of documents that share a bucket, once.
    some = sets.join(shared.select("rep").distinct(), "rep", "left_semi")
    members = texts.join(some.select("rep", "n_shingles", "sig").hint("merge"), "rep").dropDuplicates(["rep"])
    members = scratch.table(members, "minhash-members")
    first = shared.filter("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    edges = scratch.table(confirmed(scratch.table(alike(first, members, percent), "minhash-pairs"), members, shingle, percent), "minhash-edges")
    labels = scratch.table(components(edges), "minhash-labels")
    loose = scratch.table(candidate_forest(shared, labels, members, percent), "minhash-loose")
    if not loose.isEmpty():
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        clusters = components(stars.unionByName(loose)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
        clusters = clusters.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        clusters = clusters.join(members.select("rep", F.octet_length("text").alias("bytes")), "rep")
        more = cluster_links(scratch.table(clusters, "minhash-clusters"), members, shingle, percent)
        labels = scratch.table(components(stars.unionByName(more)), "minhash-labels")
    named = (sets.select("k1", "k2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
             .select("k1", "k2", F.coalesce("component", "rep").alias("class")))
    out = found.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class"))).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, and one row of each document; rows without an id stay."""
    stay = near_duplicates(docs, id_col, text_col, **options).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    one = docs.filter(F.col(id_col).isNotNull()).join(stay, id_col, "left_semi").dropDuplicates([id_col])
    return one.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
