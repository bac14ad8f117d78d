import random
import re
import zlib

from rankscreen.llm import spelling


def counted(rows):
    n: dict = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(rows):
    n = counted(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        last = w
        while form[last] is not None:
            last = form[last]
        out[w] = (form[w], last, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}


def sample(rng, n):
    base = ["retrieval", "candidate", "señores", "ünderline", "abcdefg", "aaaaaaa", "bananas", "restore", "reports"]
    words = list(base)
    for w in base * 12:
        at, kind, letter = rng.randrange(len(w)), rng.randrange(3), rng.choice("aeiouñ")
        words.append(w[:at] + (letter if kind < 2 else "") + w[at + (kind != 1):])
    text = [(rng.choice(base) if rng.random() < 0.8 else rng.choice(words)) for _ in range(n)]
    return [(i // 40, " ".join(w.upper() if rng.random() < 0.1 else w for w in text[i:i + 40])) for i in range(0, n, 40)]


def test_matches_brute_force(spark, monkeypatch):
    rows = sample(random.Random(4), 9000) + [(None, "retrieval " * 3), (5, None), (6, ""), (7, "x" * 5000 + " " + "x" * 5000), (7, "bananas×÷bananas ")] * 2
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = expected(rows)
    assert found(df) == want
    assert any(v[1] not in (w, v[0]) for w, v in want.items())   # a form of a form
    monkeypatch.setattr(spelling, "BLOCK", 7)                    # every group in blocks
    assert found(df) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(df).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short words only here")], "doc_id long, text string")).count() == 0


def test_index_against_pairs():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(5, 9))) for _ in range(150)})
    index = spelling.PositionIndex(words)
    for w in words + ["", "a", "abababababab"]:
        assert {words[b] for b in spelling._places(index.near(w))} == {v for v in words if one_edit(w, v)}
