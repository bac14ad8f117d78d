import random
import zlib

import numpy as np

from rankscreen.llm import byte_cnn


def texts(rnd, n):
    good = [" ".join(rnd.choice(["the", "river", "stone", "over", "light"]) for _ in range(rnd.randrange(20, 120))) for _ in range(n)]
    bad = [" ".join(rnd.choice(["###", "BUY!!", "$$$", "NOW%%"]) for _ in range(rnd.randrange(20, 120))) for _ in range(n)]
    return good, bad


def test_held_out_accuracy_and_defined_cases(spark):
    good, bad = texts(random.Random(2), 150)
    rows = [(i, t, "quality") for i, t in enumerate(good + bad)] + [(900, None, "x"), (901, "", "x"), (902, "a" * 300_000 + " ### $$$ " * 5, "x"), (None, "the", "x")]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(900, None, 1), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = byte_cnn.quality_scores(docs, labels).collect()
    assert len(out) == len(rows) + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert np.mean([(r.score > 0.5) == (r.doc_id < 150) for r in held]) > 0.97
    left = byte_cnn.drop_low_quality(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {r.doc_id for r in out if r.predicted and r.doc_id is not None}
    assert byte_cnn.quality_scores(docs.limit(0), labels).count() == 0
    none = byte_cnn.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_blocks_cover_the_whole_text(monkeypatch):
    good, bad = texts(random.Random(5), 20)
    model = byte_cnn.fit([t.encode() for t in good + bad], [1] * 20 + [0] * 20, epochs=2)
    long = " ".join(good) * 40
    whole = byte_cnn.probability(model, long)
    monkeypatch.setattr(byte_cnn, "BLOCK", 1)
    assert abs(byte_cnn.probability(model, long) - whole) < 1e-6


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    model = {k: v.astype(np.float64) for k, v in byte_cnn.fit([b"abc def ghi" * 9, b"### !!" * 20], [1, 0], epochs=1).items()}
    text = bytes(rng.integers(97, 122, 3000, dtype=np.uint8))
    loss = lambda: -np.log(byte_cnn.probability(model, text.decode()))
    grads = {k: np.zeros_like(v) for k, v in model.items()}
    byte_cnn._gradient(model, text, 1, 1.0, grads)
    for name in model:
        at = tuple(rng.integers(0, s) for s in model[name].shape) if name != "embed" else (100, 3)
        model[name][at] += 1e-5
        up = loss()
        model[name][at] -= 2e-5
        down = loss()
        model[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-3 + 0.05 * abs(grads[name][at]), name
