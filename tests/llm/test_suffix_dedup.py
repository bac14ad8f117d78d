import hashlib
import random

import pytest

from rankscreen.llm import suffix_dedup as sd


def brute(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9)))
    para = [" ".join(word() for _ in range(rnd.randrange(8, 70))) for _ in range(60)]
    rows = []
    for i in range(150):
        parts = [rnd.choice(para) if rnd.random() < 0.3 else " ".join(word() for _ in range(rnd.randrange(5, 40))) for _ in range(rnd.randrange(1, 7))]
        text = rnd.choice(["\n", " ", ""]).join(parts)
        rows.append((i * 3 % 449, text[rnd.randrange(0, 5):]))
    rows += [(1000, None), (1001, ""), (1002, "x" * 99), (1003, "x" * 100), (1004, "x" * 1000), (1005, "ab" * 400), (1006, "y" + "ab" * 90 + "z"), (None, para[0] * 2)]
    rows += [(2000 + i, rows[5][1]) for i in range(20)]
    return rows


@pytest.mark.parametrize("shard", [4 << 20, 3000])
def test_against_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    monkeypatch.setattr(sd, "CUT_BYTES", shard)
    monkeypatch.setattr(sd, "CHUNK_BYTES", 20_000)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.without_repeats(docs).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "q" * 50 + "w" * 80), (1, "q" * 50 + "w" * 80), (2, None)], "doc_id long, text string")
    assert sd.without_repeats(docs.limit(0)).count() == 0
    assert sorted((r.doc_id, r.n_removed) for r in sd.without_repeats(docs).collect()) == [(1, 0), (1, 0), (2, 0)]


def test_windows_of_a_hot_passage_reach_a_shard_once_per_task(spark, monkeypatch):
    """A passage between different surroundings: as many border stretches as documents, no row per document and window."""
    monkeypatch.setattr(sd, "CUT_BYTES", 3000)
    rnd = random.Random(12)
    near = lambda: "".join(rnd.choice("abcdefghij ") for _ in range(120))
    passage = near() + near()
    rows = [(i, near() + passage + near()) for i in range(200)]
    seen = []
    keep = sd.shard_texts
    monkeypatch.setattr(sd, "shard_texts", lambda members, docs: seen.append(keep(members, docs).cache()) or seen[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.without_repeats(docs).collect()}
    assert got == brute(rows)
    sent = [bytes(r.bytes).decode() for r in seen[0].filter("bytes IS NOT NULL").collect()]
    tasks = seen[0].rdd.getNumPartitions()
    inside = [w for w in sent if w in passage]
    assert inside and len(inside) <= tasks * len(set(inside)) and len(set(inside)) < 200


def test_classes_of_one_anchor_meet_in_many_buckets(spark, monkeypatch):
    rnd = random.Random(13)
    near = lambda: "".join(rnd.choice("abcdefghij ") for _ in range(120))
    passage = near()
    docs = spark.createDataFrame([(i, near() + passage + near()) for i in range(300)], "doc_id long, text string")
    sent = sd.messages(docs, 3).cache()
    grams = {}
    for r in sd.repeated_stretches(sent, 3).filter("bucket >= 0").collect():
        for g in sd.unsqueeze(r.gram, "<u8").tolist():
            grams.setdefault(g, set()).add(r.bucket)
    assert max(map(len, grams.values())) == 8
