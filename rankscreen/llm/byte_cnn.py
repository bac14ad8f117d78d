"""A byte-level convolutional network in numpy that scores every whole text for quality.

Bytes are embedded, learned filters slide over them, and each chunk of CHUNK windows (chunks overlap by a filter's
width, together they cover the text) keeps the maximum of each filter. The mean and the maximum of the chunk vectors
are combined into one probability. Scoring walks through a text in blocks, so memory does not grow with its length.

The network is fitted on at most PER_CLASS labelled texts of each class of at most MAX_BYTES bytes, chosen by a hash of
the id among the folds left for training; that bound is the only one, scoring reads every byte of every text.
Both classes weigh the same in the loss, so 0.3 asks for clear evidence before a document is rejected.

Defined results: null and empty texts are scored as one window of padding; without labels of both classes every
score is (ones + 1) / (labels + 2); repeated rows score alike; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of

DIM, WIDTH, STRIDE, FILTERS, CHUNK = 8, 8, 2, 32, 512
PER_CLASS = 1000
MAX_BYTES = 16384
FOLDS = 5
THRESHOLD = 0.3
EPOCHS = 8
BLOCK = 64

Model = dict[str, np.ndarray]


def padded(data: bytes) -> np.ndarray:
    """The bytes as an array that ends with a whole window."""
    n = max(len(data), WIDTH)
    out = np.zeros(n + (n - WIDTH) % STRIDE, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out


def _windows(model: Model, data: np.ndarray) -> np.ndarray:
    flat = model["embed"][data].reshape(-1)
    n = (len(data) - WIDTH) // STRIDE + 1
    return np.lib.stride_tricks.as_strided(flat, (n, WIDTH * DIM), (STRIDE * DIM * flat.itemsize, flat.itemsize))


def _chunk_maxima(model: Model, data: np.ndarray) -> np.ndarray:
    z = _windows(model, data) @ model["filters"]
    return np.maximum(np.maximum.reduceat(z, np.arange(0, len(z), CHUNK)) + model["bias"], 0)


def probability(model: Model, text: str | None) -> float:
    if "constant" in model:
        return float(model["constant"][0])
    data = padded((text or "").encode("utf-8", "surrogatepass"))
    total, top, chunks, step = np.zeros(FILTERS), np.zeros(FILTERS), 0, CHUNK * STRIDE * BLOCK
    for at in range(0, max(1, len(data) - WIDTH + 1), step):
        m = _chunk_maxima(model, data[at:at + step + WIDTH - STRIDE])
        total, top, chunks = total + m.sum(axis=0), np.maximum(top, m.max(axis=0)), chunks + len(m)
    x = float(total / chunks @ model["mean"] + top @ model["top"] + model["offset"][0])
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _gradient(model: Model, text: bytes, label: int, weight: float, grads: Model) -> None:
    data = padded(text)
    windows = _windows(model, data)
    z = windows @ model["filters"] + model["bias"]
    n, chunks = len(z), -(-len(z) // CHUNK)
    z = np.concatenate([z, np.full((chunks * CHUNK - n, FILTERS), -np.inf, np.float32)]).reshape(chunks, CHUNK, FILTERS)
    at = z.argmax(axis=1)
    m = np.maximum(np.take_along_axis(z, at[:, None], axis=1)[:, 0], 0)
    mean, best = m.mean(axis=0), m.argmax(axis=0)
    top = m[best, np.arange(FILTERS)]
    p = 1 / (1 + np.exp(-np.clip(mean @ model["mean"] + top @ model["top"] + model["offset"][0], -40, 40)))
    d = np.float32(weight * (p - label))
    grads["mean"] += d * mean
    grads["top"] += d * top
    grads["offset"] += d
    g = np.repeat((d * model["mean"] / chunks)[None], chunks, axis=0)
    g[best, np.arange(FILTERS)] += d * model["top"]
    g *= m > 0
    grads["bias"] += g.sum(axis=0)
    where = at + np.arange(chunks)[:, None] * CHUNK
    grads["filters"] += np.einsum("cf,cfk->kf", g, windows[where])
    back = (g[:, :, None] * model["filters"].T).reshape(-1, DIM)
    source = data[where[:, :, None] * STRIDE + np.arange(WIDTH)].reshape(-1)
    np.add.at(grads["embed"], source, back)


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on the log loss, both classes weighing the same."""
    ones = sum(labels)
    if not 0 < ones < len(labels):
        return {"constant": np.array([(ones + 1) / (len(labels) + 2)])}
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    model: Model = {"embed": draw(256, DIM) * 0.5, "filters": draw(WIDTH * DIM, FILTERS) / 4, "bias": np.zeros(FILTERS, np.float32),
                    "mean": draw(FILTERS) * 0.2, "top": draw(FILTERS) * 0.1, "offset": np.zeros(1, np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    weights = {1: len(labels) / (2 * ones), 0: len(labels) / (2 * (len(labels) - ones))}
    batch, step = 16, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            part = order[lo:lo + batch]
            grads = {k: np.zeros_like(v) for k, v in model.items()}
            for i in part:
                _gradient(model, texts[i], labels[i], weights[labels[i]] / len(part), grads)
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k, g in grads.items():
                g += 1e-5 * model[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                model[k] -= np.float32(rate) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + np.float32(1e-7))
    return model


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                    per_class: int = PER_CLASS) -> tuple[list[bytes], list[int]]:
    """At most ``per_class`` texts of each class from the training folds, in the order of their ids."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter("label IN (0, 1) AND doc_id IS NOT NULL").filter(fold_of(F.col("doc_id"), FOLDS) != 0)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.filter(F.octet_length("text").between(1, MAX_BYTES))
    # At most 2 * per_class rows of two numbers, by the limits above.
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text.encode("utf-8", "surrogatepass") for r in rows], [r.label for r in rows]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` rows as doc_id, score."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = [probability(model, t if isinstance(t, str) else None) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": p})
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInPandas(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row."""
    scored = score(docs, fit(*training_sample(docs, labels)))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, with their columns; the score is computed where the row is."""
    model = fit(*training_sample(docs, labels, text_col=text_col))

    @F.pandas_udf("double")
    def probabilities(texts: pd.Series) -> pd.Series:
        return pd.Series([probability(model, t if isinstance(t, str) else None) for t in texts], dtype="float64")
    return docs.filter(probabilities(F.col(text_col).cast("string")) >= threshold)
