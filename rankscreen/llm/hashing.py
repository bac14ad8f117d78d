"""Vectorised 64-bit hashes of words and word runs of one text, by polynomials modulo 2**64 and a final mixer."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _power(n: int, up: bool) -> np.ndarray:
    """The first ``n`` powers of the base (or of its inverse); the table doubles on demand."""
    table = _powers[up]
    while len(table) < n:
        step = np.uint64(pow(_BASE if up else _INVERSE, len(table), 2**64))
        table = np.concatenate([table, table * step])
    _powers[up] = table if len(table) < 1 << 22 else _powers[up]
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of a byte array: runs of anything but 0x20 and 0x09 to 0x0D."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(len(data), True), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _power(len(data), False)[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words; of the whole sequence as one run if it is shorter, none if it is empty."""
    k = min(length, len(words))
    if k == 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += words[i:len(words) - k + 1 + i] * np.uint64(pow(_INVERSE, 3 * i + 1, 2**64))
    return mix(total + np.uint64(k))


def shingle_set(text: str | None, length: int) -> np.ndarray:
    """Sorted distinct hashes of the word runs of a text, A-Z in lower case."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    starts, ends = word_spans(data)
    return np.unique(run_hashes(word_hashes(data, starts, ends), length))
