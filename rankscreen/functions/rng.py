"""Counter-based random numbers: a pure function of (seed, counters), so no draw depends on partitioning or retries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_BITS = 60


def random_int(*parts) -> Column:
    """A uniform integer in [0, 2^60) from the first 15 hex digits of the md5 of the joined counters."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def random_below(bound, *parts) -> Column:
    """A uniform integer in [0, bound); never null, so a join on it does not hash twice to filter nulls."""
    drawn = F.pmod(random_int(*parts), bound if isinstance(bound, Column) else F.lit(bound).cast("long"))
    return F.coalesce(drawn, F.lit(0).cast("long"))


# The same integers inside a task, for counters that follow each other: md5 on arrays of four-byte words, one message block each.
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [turns[i % 4] for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_WORD_AT = [(mul * i + add) % 16 for mul, add in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Digits that are written as arrays, the others being the same for a whole array, and numbers in an array: what a core's cache holds.
_DIGITS, _STEP = 5, 25_000


def _digest_heads(prefix: bytes, last: np.ndarray, digits: int) -> np.ndarray:
    """The first 60 bits of the md5 of ``prefix`` and each number of ``last``, written with ``digits`` digits."""
    size = len(prefix) + digits
    if size > 55:
        raise ValueError(f"a message of {size} bytes does not fit one block")
    block = prefix + b"0" * digits + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
    words: list = [int.from_bytes(block[i:i + 4], "little") for i in range(0, 64, 4)]
    for at in range(digits):
        w, shift = divmod(len(prefix) + at, 4)
        words[w] = words[w] + (last // 10 ** (digits - 1 - at) % 10 << 8 * shift)
    words = [w.astype(np.uint32) if isinstance(w, np.ndarray) else w for w in words]
    a, b, c, d = (np.full(len(last), x, np.uint32) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f); f &= b; f ^= d  # noqa: E702
        elif i < 32:
            np.bitwise_xor(b, c, out=f); f &= d; f ^= c  # noqa: E702
        elif i < 48:
            np.bitwise_xor(b, c, out=f); f ^= d  # noqa: E702
        else:
            np.invert(d, out=f); f |= b; f ^= c  # noqa: E702
        word = words[_WORD_AT[i]]
        if isinstance(word, np.ndarray):
            f += word
            word = 0
        a += np.uint32((_SINES[i] + word) % 2**32)
        a += f
        np.left_shift(a, _TURNS[i], out=t)
        a >>= np.uint32(32 - _TURNS[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    head = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()
    return (head >> np.uint64(64 - _BITS)).astype(np.int64)


def ints_below(bound: int, n: int, *parts) -> np.ndarray:
    """``random_below(bound, *parts, slot)`` of the slots 0 to ``n`` - 1."""
    out = np.empty(n, np.int64)
    prefix = "".join(f"{p}|" for p in parts)
    for digits in range(1, _DIGITS + 1):
        first, last = 10 ** (digits - 1) if digits > 1 else 0, min(10 ** digits, n)
        if first < last:
            out[first:last] = _digest_heads(prefix.encode(), np.arange(first, last), digits)
    for first in range(10 ** _DIGITS, n, _STEP):
        head, rest = divmod(first, 10 ** _DIGITS)
        run = np.arange(rest, rest + min(_STEP, n - first))
        out[first:first + len(run)] = _digest_heads(f"{prefix}{head}".encode(), run, _DIGITS)
    out -= out // bound * bound
    return out


def random_unit(*parts) -> Column:
    """A uniform double strictly inside (0, 1)."""
    return (random_int(*parts).cast("double") + F.lit(0.5)) / F.lit(float(1 << _BITS))


# Many draws per row: whole-number arithmetic below 2^62 only, so that SQL engines agree on every bit.
_PRIME = (1 << 31) - 1
_STEPS = ((1_103_515_245, 12_345), (1_597_334_677, 69_069))
#: What a counter grows by from one draw of a row to the next.
STRIDE = 678_152_731_007


def bind(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once.

    The optimizer repeats a plain column at each of its uses, and an expression that uses its parts twice doubles at
    every step until no compiler takes it. What a generator returns stays as it is.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def with_units(rows: DataFrame, counter: str, uses: dict[str, Column]) -> DataFrame:
    """Uniform doubles strictly inside (0, 1), in steps of 2^-31, from a 62-bit counter and the number of each use."""
    prime = F.lit(_PRIME)
    fold = lambda x: x.bitwiseXOR(F.shiftright(x, 15))
    (m1, a1), (m2, a2) = _STEPS
    inner = list(uses)
    step = lambda x, m, a: (x * F.lit(m) + F.lit(a)) % prime
    rows = bind(rows, __low=F.pmod(F.col(counter), prime), __high=F.pmod(F.shiftright(F.col(counter), 31), prime))
    rows = bind(rows, **{f"__a{u}": step((F.col("__low") + uses[u] * F.lit(40_503_161)) % prime, m1, a1) for u in inner})
    rows = bind(rows, **{f"__b{u}": step(fold(F.col(f"__a{u}")), m2, a2) for u in inner})
    rows = bind(rows, **{f"__c{u}": step((fold(F.col(f"__b{u}")) + F.col("__high")) % prime, m1, a1) for u in inner})
    rows = bind(rows, **{f"__d{u}": step(fold(F.col(f"__c{u}")), m2, a2) for u in inner})
    rows = bind(rows, **{u: (fold(F.col(f"__d{u}")).cast("double") + F.lit(0.5)) / F.lit(float(1 << 31)) for u in inner})
    return rows.drop("__low", "__high", *[f"__{k}{u}" for k in "abcd" for u in inner])


def units(counter, uses: list[int]) -> list:
    """The same numbers inside a task: an array of uniforms for each use, from an array of counters."""
    (m1, a1), (m2, a2) = _STEPS
    fold = lambda x: x ^ (x >> 15)
    low, high, out = counter % _PRIME, (counter >> 31) % _PRIME, []
    for use in uses:
        x = ((low + use * 40_503_161) % _PRIME * m1 + a1) % _PRIME
        x = (fold(x) * m2 + a2) % _PRIME
        x = ((fold(x) + high) % _PRIME * m1 + a1) % _PRIME
        x = (fold(x) * m2 + a2) % _PRIME
        out.append((fold(x) + 0.5) / float(1 << 31))
    return out


def units_sql(source: str, name: str, counter: str, uses: dict[str, str]) -> str:
    """The same numbers as SQL: table expressions, the last of them ``name``, that add them to ``source``."""
    (m1, a1), (m2, a2) = _STEPS
    fold = lambda c: f"xor({c}, {c} >> 15)"
    steps = [{u: f"(({counter} % {_PRIME} + ({use})::BIGINT * 40503161) % {_PRIME} * {m1} + {a1}) % {_PRIME}" for u, use in uses.items()},
             {u: f"({fold('__a' + u)} * {m2} + {a2}) % {_PRIME}" for u in uses},
             {u: f"(({fold('__b' + u)} + ({counter} >> 31) % {_PRIME}) % {_PRIME} * {m1} + {a1}) % {_PRIME}" for u in uses},
             {u: f"({fold('__c' + u)} * {m2} + {a2}) % {_PRIME}" for u in uses}]
    out = []
    for k, step in zip("abcd", steps):
        out.append(f"{name}_{k} AS (SELECT *, {', '.join(f'{x} AS __{k}{u}' for u, x in step.items())} FROM {source})")
        source = f"{name}_{k}"
    drop = ", ".join(f"__{k}{u}" for k in "abcd" for u in uses)
    last = ", ".join(f"({fold('__d' + u)}::DOUBLE + 0.5) / 2147483648.0::DOUBLE AS {u}" for u in uses)
    return ", ".join([*out, f"{name} AS (SELECT * EXCLUDE ({drop}), {last} FROM {source})"])
