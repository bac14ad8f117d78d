"""Suffix-array deduplication: bytes covered by a LENGTH-byte string that also starts earlier are removed.

1. Anchors. Every LENGTH-byte window elects the leftmost smallest hash among its GRAM-byte strings, a choice that its
   bytes alone decide. Windows with the same anchor form one stretch; equal windows always lie in stretches whose anchor
   strings are equal, at the same distance. Chunks of the corpus send their distinct anchor hashes to buckets and learn
   which of them occur twice in the corpus; stretches of other anchors hold no repeated window and are done.
2. Stretches with equal bytes are one class; chunks send the first one of each class they hold, so a passage in every
   document arrives once per chunk. All but the first of the corpus are removed as a whole. Classes meet in buckets of
   anchor and bytes, so an anchor with a class in every document is spread over all of them.
3. Anchors with several classes, the borders of repeats, go to shards. A shard is one text, sorted by its suffixes with
   common-prefix values by external induced sorting (``induced_sort``); runs of suffixes that share LENGTH bytes are equal
   windows, of which the first stays. The stretches of an anchor too large for a shard are cut into single windows and
   spread by their content; a task sends the first place of each distinct window it holds, the others are later ones.
   Shards are counted from the bytes that this leaves.
4. Removed intervals go back to their documents.

Text is joined twice, for the bytes of classes in shards and for the result; all other traffic is hashes and positions.
Classes and anchors are compared by 64-bit hashes each, 128 bits together.

Defined results: null is the empty text; rows without doc_id rank last; rows that share a doc_id rank as one document, equal
places in them are the same place; a text of fewer than LENGTH bytes loses nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .common import discard, free_shuffles
from .hashing import _power, mix
from .induced_sort import sorted_suffixes
from .pitman_yor import squeeze, unsqueeze

LENGTH = 100
GRAM = 32
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
SHARD_BYTES = 1 << 20
#: Beyond this an anchor's stretches are cut into windows.
CUT_BYTES = 4 << 20
#: Distinct windows that a task compares before it sends them.
CUT_WINDOWS = 100_000
_LAST = 2**63 - 1
_TABLE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = "chunk long, bucket int, grams binary, twice binary, docs array<long>, counts binary, which binary, start binary, windows binary, hash binary"
_PLACES = "bucket int, gram binary, hash binary, doc binary, start binary, windows binary"
_JUDGED = "doc_id long, start long, end long, windows int, gram long, hash long"
_PARTS = "key long, doc_id long, start long, size int, bytes binary"
_INTERVAL = "doc_id long, start long, end long"


def stretches(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Per stretch: anchor hash, first window, number of windows, hash of its bytes."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint32, np.uint8, np.uint64))
    h, width, base = _TABLE[data], 1, 0x9E3779B97F4A7C15
    while width < gram:
        h = h[:-width] * np.uint64(pow(base, width, 2**64)) + h[width:]
        width *= 2
    low = mix(h)
    grams, at, span, wide = low, np.arange(len(low), dtype=np.uint32), 1, length - gram + 1
    while span < wide:
        step = min(span, wide - span)
        later = low[step:] < low[:-step]
        low, at = np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step])
        span += step
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    windows = np.diff(np.append(first, len(at)))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(n, True), out=prefix[1:])
    whole = mix((prefix[first + windows + length - 1] - prefix[first]) * _power(n, False)[first])
    # An anchor is a minimum of hashes, so its top bits are mostly zero; mixed once more, they deal anchors out evenly.
    return mix(grams[at[first]]), first.astype(np.uint32), windows.astype(np.uint8), whole


def messages(docs: DataFrame, bits: int) -> DataFrame:
    """Per chunk one row (bucket -1) with all its stretches, and one row for each bucket of its distinct anchor hashes."""
    def close(chunk: int, ids: list, parts: list) -> pd.DataFrame:
        gram, start, windows, whole = (np.concatenate(x) for x in zip(*parts))
        distinct, which, n = np.unique(gram, return_inverse=True, return_counts=True)
        edge = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
        rows = [(chunk, b, squeeze(distinct[lo:hi]), squeeze(np.packbits(n[lo:hi] > 1)), *[None] * 6)
                for b, (lo, hi) in enumerate(zip(edge, edge[1:])) if lo < hi]
        rows.append((chunk, -1, None, None, ids, squeeze(np.array([len(p[0]) for p in parts], np.uint32)), squeeze(which.astype(np.uint32)),
                     squeeze(start), squeeze(windows), squeeze(whole)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _CHUNK.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, ids, parts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"", np.uint8)
                if len(data) < LENGTH:
                    continue
                ids.append(int(doc))
                parts.append(stretches(data))
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield close(chunk, ids, parts)
                    chunk, ids, parts, size = chunk + 1, [], [], 0
        if parts:
            yield close(chunk, ids, parts)
    return docs.mapInPandas(run, _CHUNK)


def first_and_later(gram: np.ndarray, whole: np.ndarray, docs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first stretch of each class by document and place, and those at other places."""
    order = np.lexsort((start, docs, whole, gram))
    first = np.ones(len(order), bool)
    first[1:] = (gram[order][1:] != gram[order][:-1]) | (whole[order][1:] != whole[order][:-1])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    return order[first], order[(docs[order] != docs[head]) | (start[order] != start[head])]


def repeated_stretches(sent: DataFrame, bits: int) -> DataFrame:
    """The stretches whose anchor hash occurs twice or more in the corpus, by buckets of that hash.

    Of each class a chunk sends only its first stretch there; the others are surely later ones and go to bucket -1.
    """
    def judge(group: pd.DataFrame) -> pd.DataFrame:
        grams = [unsqueeze(b, "<u8") for b in group["grams"]]
        twice = [np.unpackbits(unsqueeze(b, "u1"), count=len(g)).astype(bool) for b, g in zip(group["twice"], grams)]
        every, at, n = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        again = n > 1
        again[at[np.concatenate(twice)]] = True
        out = [(c, b, squeeze(np.packbits(again[np.searchsorted(every, g)])), len(g)) for c, b, g in zip(group["chunk"], group["bucket"], grams)]
        return pd.DataFrame(out, columns=["chunk", "bucket", "again", "size"])
    asked = sent.filter("bucket >= 0").select("chunk", "bucket", "grams", "twice")
    answers = asked.groupBy("bucket").applyInPandas(judge, "chunk long, bucket int, again binary, size int")
    answers = answers.join(asked.select("chunk", "bucket", "grams"), ["chunk", "bucket"])
    held = sent.filter("bucket < 0").select("chunk", "docs", "counts", "which", "start", "windows", "hash")

    def place(group: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        group, row = group.sort_values("bucket"), next(chunk.itertuples())
        again = np.concatenate([np.unpackbits(unsqueeze(b, "u1"), count=k).astype(bool) for b, k in zip(group["again"], group["size"])])
        gram = np.concatenate([unsqueeze(b, "<u8") for b in group["grams"]])
        which = unsqueeze(row.which, "<u4")
        keep = again[which]
        gram, whole = gram[which[keep]], unsqueeze(row.hash, "<u8")[keep]
        docs = np.repeat(np.asarray(row.docs, np.int64), unsqueeze(row.counts, "<u4"))[keep]
        start, windows = unsqueeze(row.start, "<u4")[keep], unsqueeze(row.windows, "u1")[keep]
        first, later = first_and_later(gram, whole, docs, start)
        bucket = (mix(gram[first] ^ whole[first]) >> np.uint64(64 - bits)).astype(np.int64)
        out = []
        for b, at in [*((b, first[bucket == b]) for b in np.unique(bucket)), *([(-1, later)] if len(later) else [])]:
            out.append((b, *[squeeze(x[at]) for x in (gram, whole, docs, start, windows)]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PLACES.split(", ")])
    return answers.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInPandas(place, _PLACES)


def judged(places: DataFrame) -> DataFrame:
    """Rows with ``gram`` null: intervals removed as a whole; the others: the first stretch of each class."""
    def rows(docs: np.ndarray, start: np.ndarray, windows: np.ndarray, gram=None, whole=None) -> pd.DataFrame:
        none = [pd.array([None] * len(docs), "Int64") for _ in range(2)]
        gram, whole = none if gram is None else (gram.view(np.int64), whole.view(np.int64))
        start, windows = start.astype(np.int64), windows.astype(np.int32)
        return pd.DataFrame({"doc_id": docs, "start": start, "end": start + windows + LENGTH - 1, "windows": windows, "gram": gram, "hash": whole})

    def load(group: pd.DataFrame) -> list[np.ndarray]:
        return [np.concatenate([unsqueeze(b, k) for b in group[c]]) for c, k in zip(("gram", "hash", "doc", "start", "windows"), ("<u8", "<u8", "<i8", "<u4", "u1"))]

    def later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield rows(*load(batch)[2:])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        gram, whole, docs, start, windows = load(group)
        head, gone = first_and_later(gram, whole, docs, start)
        return pd.concat([rows(docs[gone], start[gone], windows[gone]), rows(docs[head], start[head], windows[head], gram[head], whole[head])])
    return (places.filter("bucket < 0").mapInPandas(later, _JUDGED)
            .unionByName(places.filter("bucket >= 0").groupBy("bucket").applyInPandas(meet, _JUDGED)))


def border_stretches(found: DataFrame) -> DataFrame:
    """The first stretches of anchors with several classes; ``cut`` if the anchor is too large for a shard."""
    heads = found.filter("gram IS NOT NULL").select("doc_id", "gram", "hash", "start", "windows")
    per = heads.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"), F.sum(F.col("windows") + LENGTH - 1).alias("total")).filter("classes > 1")
    per = scratch.table(per.select("gram", (F.col("total") > CUT_BYTES).alias("cut")), "suffix-anchors")
    # Large anchors are at most the bytes of all stretches / CUT_BYTES; the rest have few rows each.
    large = F.broadcast(per.filter("cut"))
    some = heads.join(large.select("gram"), "gram", "left_anti").join(per.filter("NOT cut").hint("merge"), "gram")
    return some.unionByName(heads.join(large, "gram"))


def shard_texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """key, doc_id, start, size, bytes of the stretches in ``members``; ``bytes`` null: windows that start earlier too.

    Equal keys go to one shard: the anchor, or of cut stretches the content of the window.
    """
    wanted = members.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "hash", "start", "windows", "cut")).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: dict[bytes, tuple[int, int]] = {}

        def frame(out: list) -> pd.DataFrame:
            kinds = {"key": "int64", "doc_id": "int64", "start": "int64", "size": "int32"}
            return pd.DataFrame(out, columns=[c.split()[0] for c in _PARTS.split(", ")]).astype(kinds)

        def sent() -> list:
            out = [(int.from_bytes(hashlib.blake2b(w, digest_size=6).digest()), *place, LENGTH, w) for w, place in least.items()]
            least.clear()
            return out

        for batch in batches:
            out = []
            for doc, text, parts in zip(batch["doc_id"], batch["text"], batch["parts"]):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"", np.uint8)
                for p in parts:
                    at, n = p["start"], p["windows"]
                    piece = data[at:at + n + LENGTH - 1]
                    # Another row of the same id may hold other bytes here.
                    if len(piece) < n + LENGTH - 1 or int(mix(np.array([np.sum(_TABLE[piece] * _power(len(piece), True))]))[0].view(np.int64)) != p["hash"]:
                        continue
                    piece = piece.tobytes()
                    if not p["cut"]:
                        out.append((p["gram"], doc, at, len(piece), piece))
                        continue
                    since = None
                    for j in range(n):
                        place = (doc, at + j)
                        other = least.setdefault(piece[j:j + LENGTH], place)
                        if place < other:
                            least[piece[j:j + LENGTH]] = place
                            out.append((0, *other, LENGTH, None))
                        if place > other:
                            since = j if since is None else since
                        elif since is not None:
                            out.append((0, doc, at + since, j - 1 - since + LENGTH, None))
                            since = None
                    if since is not None:
                        out.append((0, doc, at + since, n - 1 - since + LENGTH, None))
                    if len(least) >= CUT_WINDOWS:
                        out += sent()
            yield frame(out)
        yield frame(sent())
    return docs.join(wanted.hint("merge"), "doc_id").mapInPandas(run, _PARTS)


def later_windows(parts: Iterator[tuple[int, int, bytes]], folder: str, **limits) -> pd.DataFrame:
    """Intervals of the windows that also start earlier. ``parts``: (doc_id, start, bytes) in the order of both."""
    docs, starts, sizes, raw = [], [], [], []
    for doc, start, data in parts:
        docs.append(doc)
        starts.append(start)
        sizes.append(len(data))
        raw.append(np.frombuffer(data, np.uint8))
    if not docs:
        return pd.DataFrame({"doc_id": [], "start": [], "end": []}).astype("int64")
    sizes = np.array(sizes)
    at = np.cumsum(sizes + 1) - sizes - 1   # a separator after each part
    text = np.ones(int((sizes + 1).sum()) + 1, np.uint16)
    for a, part in zip(at, raw):
        text[a:a + len(part)] = part.astype(np.uint16) + 2
    text[-1] = 0
    raw.clear()
    window = np.zeros(len(text) + 1, np.int8)
    np.add.at(window, at, 1)
    np.add.at(window, at + sizes - LENGTH + 1, -1)
    window = np.cumsum(window[:-1], dtype=np.int8).astype(bool)
    group = np.zeros(len(text), np.int32)
    first = np.full(len(text), np.iinfo(np.int32).max, np.int32)
    number = 0
    for suffix, shared in sorted_suffixes(text, LENGTH, folder, **limits):
        ids = number + np.cumsum(shared < LENGTH)
        number = int(ids[-1])
        mine = window[suffix]
        group[suffix[mine]] = ids[mine]
        np.minimum.at(first, ids[mine], suffix[mine].astype(np.int32))
    position = np.flatnonzero(window)
    position = position[first[group[position]] != position]
    part = np.searchsorted(at, position, side="right") - 1
    head = np.append(True, (np.diff(position) != 1) | (np.diff(part) != 0)) if len(position) else np.zeros(0, bool)
    lo = np.flatnonzero(head)
    hi = np.append(lo[1:], len(position)) - 1
    docs, starts = np.array(docs, np.int64)[part[lo]], np.array(starts, np.int64)[part[lo]] - at[part[lo]]
    return pd.DataFrame({"doc_id": docs, "start": starts + position[lo], "end": starts + position[hi] + LENGTH})


def removed_intervals(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (exclusive, may overlap) of all removed bytes. ``docs``: doc_id, text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, size / BUCKET_BYTES)))))
    sent = scratch.table(messages(docs, bits), "suffix-messages")
    places = scratch.table(repeated_stretches(sent, bits), "suffix-places")
    discard(sent)
    free_shuffles(spark)
    found = scratch.table(judged(places), "suffix-judged")
    discard(places)
    whole = found.filter("gram IS NULL").select("doc_id", "start", "end")
    texts = scratch.table(shard_texts(border_stretches(found), docs), "suffix-shards")
    total = texts.filter("bytes IS NOT NULL").agg(F.sum("size")).first()[0] or 0
    shards = max(8, int(np.ceil(total / SHARD_BYTES)))
    free_shuffles(spark)
    repeated = texts.filter("bytes IS NULL").select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"))

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = ((d, s, b) for batch in batches for d, s, b in zip(batch["doc_id"], batch["start"], batch["bytes"]))
        with tempfile.TemporaryDirectory() as folder:   # the queues of this task alone; nobody else reads them
            yield later_windows(parts, folder)
    parts = texts.filter("bytes IS NOT NULL").withColumn("shard", F.pmod("key", F.lit(shards)))
    some = parts.repartition(shards, "shard").sortWithinPartitions("doc_id", "start").select("doc_id", "start", "bytes").mapInPandas(sort, _INTERVAL)
    return whole.unionByName(repeated).unionByName(scratch.table(some, "suffix-sorted"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per input row."""
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = removed_intervals(named).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = scratch.table(spans, "suffix-intervals")
    free_shuffles(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, cut in zip(batch["doc_id"], batch["text"], batch["spans"]):
                data = text.encode("utf-8", "surrogatepass")
                keep, at, removed, runs, last = hashlib.sha256(), 0, 0, 0, -1
                for s, e in sorted((c["start"], min(c["end"], len(data))) for c in (cut if cut is not None else ())):
                    if s >= e:
                        continue
                    runs += s > last
                    keep.update(data[at:max(at, s)])
                    removed += max(0, e - max(s, at))
                    at = last = max(at, e)
                keep.update(data[at:])
                out.append((None if doc == _LAST else doc, len(data), removed, runs, keep.hexdigest()))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield frame.astype({"doc_id": "Int64"})
    return named.join(spans.hint("merge"), "doc_id", "left").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
