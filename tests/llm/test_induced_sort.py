import numpy as np
import pytest

from rankscreen.llm import induced_sort as ind


def naive(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    lcp = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


@pytest.mark.parametrize("tuples,base", [(1 << 20, 1 << 20), (7, 3), (50, 1)])
def test_order_and_shared_lengths(tmp_path, tuples, base, monkeypatch):
    monkeypatch.setattr(ind, "BLOCK", 5 if tuples < 100 else 1 << 20)
    rng = np.random.default_rng(tuples)
    for size, letters in [(1, 1), (2, 1), (5, 1), (12, 2), (40, 2), (200, 3), (200, 1), (300, 26), (120, 200)] * 3:
        text = np.append(rng.integers(1, letters + 1, size), 0).astype(np.int64)
        if size >= 200 and letters == 3:
            text[100:150] = text[10:60]
        got = list(ind.sorted_suffixes(text, 400, str(tmp_path), tuples, base))
        order, lcp = naive(text, 400)
        assert np.concatenate([g[0] for g in got]).tolist() == order
        assert np.concatenate([g[1] for g in got]).tolist() == lcp


def test_groups_are_right_under_a_cap(tmp_path):
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 3, 3000), 0).astype(np.int64)
    text[1500:2500] = text[100:1100]
    seen = np.full(len(text), -1)
    group = -1
    for suffix, shared in ind.sorted_suffixes(text, 20, str(tmp_path), 100, 10):
        for s, k in zip(suffix, shared):
            group += k < 20
            seen[s] = group
    want = {}
    for i in range(len(text) - 20):
        want.setdefault(text[i:i + 20].tobytes(), set()).add(seen[i])
    assert all(len(v) == 1 for v in want.values()) and len({min(v) for v in want.values()}) == len(want)
