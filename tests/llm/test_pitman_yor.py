import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rankscreen.llm import pitman_yor as py


def corpus():
    rnd = random.Random(3)
    follow = {w: rnd.sample([f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"], 4) for w in [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]}
    rows = []
    for i in range(400):
        w, text = rnd.choice(list(follow)), []
        for _ in range(rnd.randrange(5, 60)):
            text.append(w if rnd.random() < 0.9 else w.upper())
            w = rnd.choice(follow[w])
        rows.append((i, " ".join(text)))
    return rows + [(1000, None), (1001, ""), (1002, "\t \n"), (1003, "é new\x1cword Z"), (1004, "au " * 30_000)]


def test_scores(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows + rows[:2]], "doc_id long, text string, score double")
    got = py.score(docs).collect()
    assert len(got) == len(rows) + 2
    toks = {d: [bytes(w).lower() for w in (t or "").encode().split()] + [b"\n"] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in toks}
    count = Counter()
    for d, _ in rows + rows[:2]:
        if not held[d]:
            count.update(toks[d])
    n, v = sum(count.values()), len(count)
    for r in got:
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(count[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
        assert math.isfinite(r.score) and r.score <= 0
    new = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.score for r in new) > 0.75 * sum(r.base_score for r in new)   # contexts help where there are any
    assert {(r.doc_id, r.score) for r in py.score(docs).collect()} == {(r.doc_id, r.score) for r in got}
    assert py.score(docs.limit(0)).count() == 0


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    word = np.arange(50, dtype=np.uint64)
    ctx = np.array([97, 98, 25 * 256 + 97])
    pair = np.sort(((np.arange(50)[:, None] << 16) | ctx).reshape(-1))
    b = py.Bucket(0, word, pair, rng.poisson(2, len(pair)))
    for _ in range(4):
        row = b.row()
        c, t = np.zeros(py.MAX_CONTEXTS, np.int64), np.zeros(py.MAX_CONTEXTS, np.int64)
        c[row[9]], t[row[9]] = row[10], row[11]
        p = b.predictive(c, t)[2]
        spare = 1.0
        for level, at in ((2, 97), (1, py.ONE + 97), (0, py.ROOT)):
            spare *= (py.STRENGTH[level] + py.DISCOUNT[level] * t[at]) / (py.STRENGTH[level] + c[at])
        unknown = (t[py.SIZES] + 1 - 50) * spare / (t[py.SIZES] + 1)
        assert p[(pair & 0xFFFF) == 97].sum() + unknown == pytest.approx(1)
        b.sweep(c, t, rng)
        assert (b.t2 <= b.n).all() and ((b.t2 > 0) == (b.n > 0)).all() and (b.t1 <= b.c1()).all() and (b.t0 <= b.c0()).all()


def test_seating_has_the_distribution_of_the_restaurant():
    """Tables of 30 customers of one dish, against the same restaurant simulated customer by customer."""
    rng = np.random.default_rng(2)
    got = py.seat(np.full(4000, 30), np.full(4000, 5), 2, np.full(4000, 0.3), rng)
    slow = []
    for _ in range(4000):
        t = s = 1
        while s < 30:
            a = (py.STRENGTH[2] + py.DISCOUNT[2] * (5 + t)) * 0.3
            t += rng.random() < a / (a + s - py.DISCOUNT[2] * t)
            s += 1
        slow.append(t)
    assert got.mean() == pytest.approx(np.mean(slow), rel=0.03) and got.std() == pytest.approx(np.std(slow), rel=0.08)


def test_contexts_are_whole_words(spark):
    """Words that differ only before their last two bytes are different contexts, and what follows each is learnt apart."""
    words, ctx = py.tokens("xaone yaone xaone")
    assert len(set(ctx.tolist())) == 3 and ctx[1] == ctx[3] != ctx[2] and ctx[0] == 0 and len(words) == 4
    follow = {f"{a}{b}one": f"{b}{a}" for a in "abcdefgh" for b in "stuvwxyz"}
    rnd = random.Random(8)
    rows = [(i, " ".join(x for w in rnd.choices(list(follow), k=40) for x in (w, follow[w]))) for i in range(300)]
    got = [r for r in py.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    # A word costs log10(64) by chance and its follower next to nothing.
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_totals_of_contexts_are_those_of_all_buckets(spark):
    rng = np.random.default_rng(6)
    contexts = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64) << np.uint64(1))
    rows, want = [], np.zeros(40, np.int64)
    for number in range(3):
        mine = np.sort(rng.choice(40, 25, replace=False))
        b = py.Bucket(number, np.arange(4, dtype=np.uint64), np.sort((np.arange(4)[:, None] << 32 | np.arange(25)).reshape(-1)), rng.poisson(2, 100), contexts=contexts[mine])
        want[mine] += np.bincount(b.ctx2, b.n, 25).astype(np.int64)
        rows.append((mine, b.row()))
    state = spark.createDataFrame([tuple(r[i] for i in (0, 12, 13, 14)) for _, r in rows], "bucket int, ctxs binary, own_c binary, own_t binary")
    got = py._context_totals(state, 3).collect()
    for number, (mine, _) in enumerate(rows):
        c = np.concatenate([py.unsqueeze(r["c"], "<i8") for r in sorted(got, key=lambda r: r["shard"]) if r["bucket"] == number])
        assert c.tolist() == want[mine].tolist()
