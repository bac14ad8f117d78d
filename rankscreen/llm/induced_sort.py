"""External induced suffix sorting of one shard, with common-prefix values.

Suffixes that start a fall-to-rise (S*) are named by their substrings; the string of names is sorted by recursion, or in
memory once it is short. Two induction scans then sort all other suffixes: a disk-backed priority queue, keyed by the
first character, takes the predecessors of the suffixes already in order. It holds a bounded number of tuples in
memory and spills the rest as sorted runs. Tuples carry the suffix and the length it shares with the tuple pushed before
it under the same character: one more than the least value passed since then. Values start from the S*
suffixes, whose neighbours are compared directly up to ``cap`` characters, which is all that callers ask about; the order
of suffixes that agree in more than ``cap`` characters is not defined.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Tuples that a queue holds in memory, and names that are sorted in memory.
QUEUE_TUPLES = 1 << 22
BASE_NAMES = 1 << 24
BLOCK = 1 << 20


@dataclass
class _Run:
    keys: np.ndarray
    ends: np.ndarray
    records: np.ndarray
    done: int = 0


class DiskQueue:
    """A priority queue of (character, suffix, shared): smallest character first, first in first out under a character."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.size = folder, limit, 0
        self.fresh: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.runs: list[_Run] = []   # oldest first

    def push(self, key: int, suffix: np.ndarray, shared: np.ndarray) -> None:
        if key not in self.fresh:
            self.fresh[key] = []
            heapq.heappush(self.heap, key)
        self.fresh[key].append(np.stack([suffix, shared], axis=1))
        self.size += len(suffix)
        if self.size > self.limit:
            self.spill()

    def spill(self) -> None:
        keys = sorted(self.fresh)
        handle, path = tempfile.mkstemp(dir=self.folder, suffix=".run")
        ends, total = [], 0
        with os.fdopen(handle, "wb") as out:
            for k in keys:
                for part in self.fresh[k]:
                    out.write(part.astype(np.int64).tobytes())
                    total += len(part)
                ends.append(total)
        self.runs.append(_Run(np.array(keys), np.array(ends), np.memmap(path, np.int64, "r", shape=(total, 2))))
        self.fresh, self.heap, self.size = {}, [], 0

    def first(self) -> int | None:
        """The smallest character that waits."""
        keys = [int(run.keys[0]) for run in self.runs if len(run.keys)]
        return min([*keys, *self.heap[:1]], default=None)

    def take(self, key: int) -> Iterator[np.ndarray]:
        """Blocks of (suffix, shared) under the smallest character, older ones first; those pushed meanwhile come last."""
        for run in self.runs:
            if len(run.keys) and run.keys[0] == key:
                start, run.done, run.keys, run.ends = run.done, int(run.ends[0]), run.keys[1:], run.ends[1:]
                for at in range(start, run.done, BLOCK):
                    yield np.array(run.records[at:min(run.done, at + BLOCK)])
        if self.heap and self.heap[0] == key:
            heapq.heappop(self.heap)
            waiting = np.concatenate(self.fresh.pop(key))
            self.size -= len(waiting)
            for at in range(0, len(waiting), BLOCK):
                yield waiting[at:at + BLOCK]


def falling(text: np.ndarray) -> np.ndarray:
    """True where a suffix is larger than the next one (L type); the last character is the unique smallest one."""
    n = len(text)
    kind = np.int32 if n < 2**31 else np.int64
    where = np.where(text[1:] != text[:-1], np.arange(n - 1, dtype=kind), kind(n))
    nxt = np.minimum(np.minimum.accumulate(where[::-1])[::-1], n - 2)
    out = np.zeros(n, bool)
    out[:-1] = text[nxt + 1] < text[nxt]
    return out


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix length of the suffixes a[i] and b[i], at most ``cap``."""
    if len(a) == 1:
        x, y = text[a[0]:a[0] + cap], text[b[0]:b[0] + cap]
        n = min(len(x), len(y))
        apart = np.flatnonzero(x[:n] != y[:n])
        return np.array([apart[0] if len(apart) else n])
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    if text.dtype == np.uint16:
        # Four characters at a time while they agree; the last few below, one by one.
        padded = np.append(text, np.zeros(4, np.uint16)).astype(np.uint64)
        four = padded[:-4] | padded[1:-3] << np.uint64(16) | padded[2:-2] << np.uint64(32) | padded[3:-1] << np.uint64(48)
        todo, at = live, 0
        while len(todo) and at + 4 <= cap:
            x, y = a[todo] + at, b[todo] + at
            inside = (x + 4 <= len(text)) & (y + 4 <= len(text))
            same = inside & (four[np.minimum(x, len(text) - 1)] == four[np.minimum(y, len(text) - 1)])
            todo, at = todo[same], at + 4
            out[todo] = at
    for _ in range(min(cap, 4) if text.dtype == np.uint16 else cap):
        at = out[live]
        live, at = live[at < cap], at[at < cap]
        x, y = a[live] + at, b[live] + at
        inside = (x < len(text)) & (y < len(text))
        same = inside.copy()
        same[inside] = text[x[inside]] == text[y[inside]]
        live = live[same]
        if not len(live):
            break
        out[live] += 1
    return out


def names(text: np.ndarray, fall: np.ndarray, star: np.ndarray) -> np.ndarray:
    """Order-preserving names of the substrings from one S* position to the next one, four characters at a time."""
    ends = np.append(star[1:], star[-1]) + 1
    code = text.astype(np.uint64) * np.uint64(2) + (~fall).astype(np.uint64) + np.uint64(1)
    name = np.zeros(len(star), np.int64)
    wide = int(code.max()) >= 1 << 16
    step, shift = (1, 0) if wide else (4, 16)
    at, live = 0, np.arange(len(star))
    while len(live):
        word = np.zeros(len(live), np.uint64)
        for k in range(step):
            p = star[live] + at + k
            word = (word << np.uint64(shift)) | np.where(p < ends[live], code[np.minimum(p, len(text) - 1)], np.uint64(0))
        order = np.lexsort((word, name[live]))
        moved = np.ones(len(live), bool)
        moved[1:] = (np.diff(name[live][order]) != 0) | (word[order][1:] != word[order][:-1])
        # A name is the number of smaller substrings: the base of its group plus its place in the group.
        first = np.maximum.accumulate(np.where(moved, np.arange(len(live)), 0))
        group = np.ones(len(live), bool)
        group[1:] = np.diff(name[live][order]) != 0
        base = np.maximum.accumulate(np.where(group, np.arange(len(live)), 0))
        fresh = name[live].copy()
        fresh[order] = name[live][order] + first - base
        name[live] = fresh
        at += step
        sizes = np.bincount(name[live], minlength=len(star) + 1)[name[live]]
        live = live[(sizes > 1) & (star[live] + at < ends[live])]
    return np.unique(name, return_inverse=True)[1]


def short_order(name: np.ndarray, cap: int) -> np.ndarray:
    """Suffix order of a string of names by doubling, up to ``cap`` names."""
    rank, width = name.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while width < cap:
        second = np.zeros(len(rank), np.int64)
        second[:-width] = rank[width:] + 1
        key = rank * (len(rank) + 2) + second
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(len(rank), np.int64)
        fresh[order] = np.cumsum(np.append(False, np.diff(key[order]) != 0))
        rank, width = fresh, width * 2
        if rank.max() == len(rank) - 1 or width >= len(rank):
            break
    return order


class _Scan:
    """One induction scan: passes sorted suffixes and pushes their predecessors of the wanted type.

    ``carry`` holds, per character, the least shared value passed since the last push under it.
    """

    def __init__(self, text: np.ndarray, fall: np.ndarray, want_fall: bool, queue: DiskQueue, cap: int):
        self.text, self.fall, self.want, self.queue, self.cap = text, fall, want_fall, queue, cap
        self.carry = np.full(int(text.max()) + 1 if cap else 1, cap)
        self.last = -1

    def feed(self, suffix: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Pass a block and return its shared values, the first one compared directly with the suffix passed before."""
        if self.cap and len(suffix):
            shared = shared.copy()
            shared[0] = shared_prefix(self.text, np.array([self.last]), suffix[:1], self.cap)[0] if self.last >= 0 else 0
            self.last = int(suffix[-1])
        at = np.flatnonzero(suffix > 0)
        at = at[self.fall[suffix[at] - 1] == self.want]
        keys = self.text[suffix[at] - 1].astype(np.int64)
        order = np.argsort(keys, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)), len(order)) if len(order) else [0]
        before = self.carry.copy()
        if self.cap and len(suffix):
            self.carry = np.minimum(self.carry, shared.min())
        for lo, hi in zip(edges, edges[1:]):
            key, place = int(keys[order[lo]]), at[order[lo:hi]]
            value = np.zeros(len(place), np.int64)
            if self.cap:
                spans = np.minimum.reduceat(shared, np.append(0, place[:-1] + 1)) if len(place) > 1 else np.array([shared[:place[0] + 1].min()])
                if len(place) > 1:
                    spans[-1] = shared[place[-2] + 1:place[-1] + 1].min()
                spans[0] = min(spans[0], before[key])
                value = np.minimum(spans + 1, self.cap)
                rest = shared[place[-1] + 1:]
                self.carry[key] = rest.min() if len(rest) else self.cap
            self.queue.push(key if self.want else -key, suffix[place] - 1, value)
        return shared


def sorted_suffixes(text: np.ndarray, cap: int, folder: str, tuples: int = QUEUE_TUPLES, base: int = BASE_NAMES,
                    share: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (suffix, shared with the suffix before) of ``text`` in order.

    ``text`` ends with its unique smallest character. Sorted S* and L suffixes wait on disk between the scans.
    """
    n = len(text)
    fall = falling(text)
    star = np.flatnonzero(~fall[1:] & fall[:-1]) + 1
    if n < 3 or not len(star):
        order = np.array(sorted(range(n), key=lambda i: text[i:i + cap + 1].tolist()))
        yield order, np.append(0, shared_prefix(text, order[:-1], order[1:], cap)) if share else np.zeros(n, np.int64)
        return
    name = names(text, fall, star)
    if name.max() == len(name) - 1:
        order = np.argsort(name)
    elif len(name) <= base:
        order = short_order(name, cap)
    else:
        deeper = sorted_suffixes(np.append(name + 1, 0), cap, folder, tuples, base, share=False)
        order = np.concatenate([s for s, _ in deeper])
        order = order[order < len(name)]
    limit = cap if share else 0
    star = star[order]
    heads = text[star]
    shared = np.append(0, shared_prefix(text, star[:-1], star[1:], limit)) if limit else np.zeros(len(star), np.int64)

    # Rising scan: L suffixes from S* suffixes and smaller L suffixes.
    queue, kept = DiskQueue(folder, tuples), _Parked(folder, tuples)
    scan, at = _Scan(text, fall, True, queue, limit), 0
    while True:
        waiting = queue.first()
        if waiting is None and at >= len(star):
            break
        if waiting is not None and (at >= len(star) or waiting <= int(heads[at])):
            while queue.first() == waiting:
                for block in queue.take(waiting):
                    kept.add(block[:, 0], scan.feed(block[:, 0], block[:, 1]))
        else:
            end = min(int(np.searchsorted(heads, heads[at], side="right")), at + BLOCK)
            scan.feed(star[at:end], shared[at:end])
            at = end
    # Falling scan: S suffixes from L suffixes, largest first, and larger S suffixes.
    queue, out = DiskQueue(folder, tuples), _Parked(folder, tuples)
    scan = _Scan(text, fall, False, queue, limit)
    back = kept.backwards()
    pending = next(back, None)
    while True:
        waiting = queue.first()
        top = None if pending is None else -int(text[pending[0][0]])
        if waiting is None and top is None:
            break
        if waiting is not None and (top is None or waiting <= top):
            while queue.first() == waiting:
                for block in queue.take(waiting):
                    out.add(block[:, 0], scan.feed(block[:, 0], block[:, 1]))
        else:
            # A parked block may hold several characters: pass those of its largest one, the rest waits.
            suffix, links = pending
            head = text[suffix]
            end = int(np.argmax(head != head[0])) if (head != head[0]).any() else len(head)
            out.add(suffix[:end], scan.feed(suffix[:end], links[:end]))
            pending = (suffix[end:], links[end:]) if end < len(suffix) else next(back, None)
    # The falling scan passed all suffixes but the last character, largest first.
    yield np.array([n - 1]), np.zeros(1, np.int64)
    previous = n - 1
    for suffix, links in out.backwards():
        if limit:
            links = links.copy()
            links[0] = shared_prefix(text, np.array([previous]), suffix[:1], limit)[0]
            previous = int(suffix[-1])
        yield suffix, links


class _Parked:
    """Suffixes and shared values in the order they came, on disk beyond a bounded buffer, read back from the end."""

    def __init__(self, folder: str, limit: int):
        handle, path = tempfile.mkstemp(dir=folder, suffix=".parked")
        self.file, self.path, self.limit, self.size, self.buffer, self.total = os.fdopen(handle, "wb"), path, limit, 0, [], 0

    def add(self, suffix: np.ndarray, shared: np.ndarray) -> None:
        self.buffer.append(np.stack([suffix, shared], axis=1).astype(np.int64))
        self.size += len(suffix)
        self.total += len(suffix)
        if self.size > self.limit:
            self.flush()

    def flush(self) -> None:
        for part in self.buffer:
            self.file.write(part.tobytes())
        self.buffer, self.size = [], 0

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the last suffix to the first; each value then belongs to the suffix after it in this direction."""
        self.flush()
        self.file.close()
        if not self.total:
            return
        records = np.memmap(self.path, np.int64, "r", shape=(self.total, 2))
        for end in range(self.total, 0, -BLOCK):
            lo = max(0, end - BLOCK)
            suffix = np.array(records[lo:end, 0])[::-1]
            links = np.append(np.zeros(1, np.int64), np.array(records[lo + 1:end, 1])[::-1])
            yield suffix, links
