"""The pipeline against plain Python on its own stages, and its handling of odd tables."""

import collections
import re
import zlib

import pytest

import corpus_pipeline
from rankscreen.llm import byte_cnn, mixing, packing, queries, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from rankscreen import scratch
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.table(stage(spark, out[-1], SMALL), "test-stage"))
    return out


def test_columns_and_decisions(spark, stages):
    docs, good, unique, clean, mixed, packed = stages
    assert [d.columns for d in stages[1:5]] == [docs.columns] * 4
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scored = {r.doc_id for r in byte_cnn.quality_scores(docs, labels).collect() if r.predicted}
    assert sorted(r.doc_id for r in good.collect()) == sorted(scored)
    texts = {r.doc_id: r.text for r in good.collect()}
    from test_minhash import brute
    classes = collections.defaultdict(set)
    for d, (_, c) in brute(sorted(texts.items())).items():
        classes[c].add(d)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(min(c) for c in classes.values())
    owners = collections.defaultdict(set)
    for r in unique.collect():
        for s, k, e, a, b in secret_scan.scan(r.text):
            owners[r.text[a:b]].add(r.source)
    before = {r.doc_id: r for r in unique.collect()}
    for r in clean.collect():
        old = before[r.doc_id].text
        live = [(s, e) for s, k, e, a, b in secret_scan.scan(old) if len(owners[old[a:b]]) < secret_scan.WIDE and (k < 3 or len(owners[old[a:b]]) == 1)]
        new, at = "", 0
        for s, e in live:
            new, at = (new + old[at:s] + "[secret]", e) if s >= at else (new, max(at, e))
        assert r.text == new + old[at:] and r.n_chars == (len(r.text) if live else before[r.doc_id].n_chars)
    taken = collections.Counter(r.doc_id for r in mixed.collect())
    plan = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert taken == collections.Counter({d: c for d, c in plan.items() if c})
    check_pieces(mixed, packed)


def check_pieces(docs, packed):
    encode = packing.byte_bpe(queries.vocabulary())
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(queries.vocabulary())
    ids = {r.doc_id: exact.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.select("doc_id", "text").distinct().collect()}
    assert all(encode([r.text or ""])[0].tolist() + [1] == ids[r.doc_id] for r in docs.limit(20).collect())
    import numpy as np
    copies = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    total = collections.Counter()
    by_sequence = collections.defaultdict(list)
    for r in packed.collect():
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes())
        total[r.doc_id] += r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert total == collections.Counter({d: len(ids[d]) * n for d, n in copies.items()})
    for number, pieces in by_sequence.items():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 2048 or number == max(by_sequence)


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "word " * 9000), (5, "\U0001F600 é\n\n  x"), (5, "\U0001F600 é\n\n  x")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, length int")
    check_pieces(docs, packing.pack(docs, queries.vocabulary()))
    assert packing.pack(docs.limit(0), queries.vocabulary()).count() == 0


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (4, "#$ 1", None), (None, "q", "b"), (6, "w " * 500, "c"), (7, "w " * 70, "b")]
    docs = spark.createDataFrame([(d, t, s, 9) for d, t, s in rows], "doc_id long, text string, source string, size int")
    out = mixing.mix(docs).collect()
    size = {s: sum(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    share = {"a": 1, "b": 2, "c": 3, None: 1}
    target, open_ = {}, set(size)
    rest = sum(size.values())
    while True:
        level = rest / sum(share[s] for s in open_)
        over = {s for s in open_ if level * share[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        open_ -= over
    target |= {s: level * share[s] for s in open_}
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size
    for s in size:
        taken = sum(r.taken for r in out if r.source == s)
        assert abs(taken - target[s]) <= max(len(WORD.findall(t or "")) for _, t, x in rows if x == s) / 2 + 1e-6
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.repeat_documents(docs).columns == docs.columns
    assert {r.taken for r in mixing.mix(docs.limit(1)).collect()} == {0}


def test_very_long_runs_pack_like_the_tokenizers_library():
    from tokenizers import Tokenizer
    encode, exact = packing.byte_bpe(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())
    for unit in (" ", "\n", "a", "#", "\t "):
        text = unit * (2_000_000 // len(unit))
        assert encode([text])[0].tolist() == exact.encode(text, add_special_tokens=False).ids
