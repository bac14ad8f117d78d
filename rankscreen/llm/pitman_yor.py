"""Hierarchical Pitman-Yor language model over words, with Chinese-restaurant seating sampled by Gibbs.

A restaurant belongs to a context, the whole word before; its parent is the restaurant of that word's last
byte, shared by all contexts that end so, whose parent is the restaurant of no context over a uniform base.
Customers of a restaurant are the words seen there, customers of a parent are the tables of its children.

The corpus meets the model in messages. Each chunk of a partition, some million tokens, sends its distinct (word,
context) pairs with training counts to buckets of words, so a word in every document arrives once per chunk and
context. A bucket has all levels of its words, so a sweep is local to it: every pair is taken from its tables and
seated again customer by customer, bottom level first (waiting times between new tables are beta-geometric, so a
frequent pair costs its tables, not its customers). The totals of the restaurants are shared, and are those of the sweep
before: a bucket sends its part of each context's totals to shards of contexts, which add them up and send them back; those of the
other levels are a few hundred numbers. Predictive probabilities are averaged over the KEPT last sweeps and go back to
the chunks, which add them up per document. Random numbers depend on seed, sweep and bucket alone.

Words are 64-bit hashes, contexts 40 bits of one and the last byte. Defined results: null and empty texts are the end token alone; repeated rows are scored each and
counted each; a word unseen in training gets the uniform base through all levels; without training documents N
and V are 0 and the model is the uniform base of one word; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .common import discard, fold_of, free_shuffles
from .hashing import word_hashes, word_spans

CHUNK_TOKENS = 1 << 21
BUCKET_BYTES = 16 << 20
SWEEPS, KEPT = 3, 2
FOLDS = 10
SEED = 41
#: Discount and strength of the levels: no context, one byte, two bytes.
DISCOUNT, STRENGTH = (0.7, 0.75, 0.8), (1.0, 1.0, 1.0)
END = 0x1F0E9A2D5C4B3A21
#: Numbers of totals: contexts (of a bucket without a list of its own), one-byte contexts, the root, and the row of vocabulary and token totals.
ONE, ROOT, SIZES, MAX_CONTEXTS = 65_536, 65_792, 65_793, 65_794

_MESSAGE = "chunk long, bucket int, words binary, runs binary, ctxs binary, ctx binary, n binary, stream binary, docs array<long>, held array<boolean>, lengths array<int>"
_STATE = ("bucket int, words binary, runs binary, ctx binary, n binary, t2 binary, t1 binary, t0 binary, acc binary, "
          "total_id array<int>, total_c array<long>, total_t array<long>, ctxs binary, own_c binary, own_t binary")
_PART = "bucket int, shard int, ctxs binary, c binary, t binary"
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, lowest bytes of all values first."""
    import zstandard
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")


def unsqueeze(blob: bytes, kind: str) -> np.ndarray:
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """Compressed bytes of ascending hashes: steps between them are shorter than they are."""
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def unsqueeze_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, "<u8"), dtype=np.uint64)


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text and the end, and the context of each: the word before, its last byte lowest, 0 at the start."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    before = (words & ~np.uint64(0xFFFFFF)) | data[ends - 1].astype(np.uint64)
    return np.append(words, np.uint64(END)), np.append(np.zeros(1, np.uint64), before)


def messages(docs: DataFrame, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per chunk one row of pairs for each bucket, and one row (bucket -1) with the pair of every token."""
    def close(chunk: int, parts: list) -> pd.DataFrame:
        ids, held, words, ctx = zip(*parts)
        lengths = np.array([len(w) for w in words])
        parts.clear()
        word, pair = np.unique(np.concatenate(words), return_inverse=True)
        del words
        contexts, context = np.unique(np.concatenate(ctx), return_inverse=True)
        del ctx
        pair <<= 32
        pair |= context
        del context
        pair, stream = np.unique(pair, return_inverse=True)
        n = np.bincount(stream, weights=np.repeat(~np.array(held), lengths), minlength=len(pair)).astype(np.uint32)
        of_word = pair >> 32
        runs = np.bincount(of_word, minlength=len(word)).astype(np.uint32)
        edge = np.searchsorted(word >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64)) if bits else np.array([0, len(word)])
        pairs = np.searchsorted(of_word, edge)
        rows = []
        for b in range(2**bits):
            if edge[b] < edge[b + 1]:
                used, at = np.unique(pair[pairs[b]:pairs[b + 1]] & 0xFFFFFFFF, return_inverse=True)
                rows.append((chunk, b, squeeze_sorted(word[edge[b]:edge[b + 1]]), squeeze(runs[edge[b]:edge[b + 1]]), squeeze_sorted(contexts[used]),
                             squeeze(at.astype(np.uint32)), squeeze(n[pairs[b]:pairs[b + 1]]), None, None, None, None))
        rows.append((chunk, -1, None, None, None, None, None, squeeze(stream.astype(np.uint32)), list(ids), list(held), lengths.tolist()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _MESSAGE.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc, held, text in zip(batch["doc_id"], batch["held"], batch["text"]):
                word, ctx = tokens(text if isinstance(text, str) else "")
                parts.append((None if pd.isna(doc) else int(doc), bool(held), word, ctx))
                size += len(word)
                if size >= CHUNK_TOKENS:
                    yield close(chunk, parts)
                    chunk, parts, size = chunk + 1, [], 0
        if parts:
            yield close(chunk, parts)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.withColumn("held", fold_of(F.col("doc_id"), FOLDS) == 0).mapInPandas(run, _MESSAGE)


class Bucket:
    """The restaurants' entries for the words of one bucket, as arrays over (word, context) pairs sorted by both.

    A pair has its word in the bits from 32 up and below the place of its context in ``contexts``; without those, from 16 up and
    the context itself. Totals are arrays of the contexts, the one-byte contexts, the root and the sizes.
    """

    def __init__(self, number: int, word: np.ndarray, pair: np.ndarray, n: np.ndarray, t2=None, t1=None, t0=None, acc=None, contexts=None):
        self.number, self.word, self.pair, self.n, self.contexts = number, word, pair, n, contexts
        bits, self.one = (16, ONE) if contexts is None else (32, len(contexts))
        self.root, self.sizes = self.one + ROOT - ONE, self.one + SIZES - ONE
        self.ctx2, self.of_word = (pair & ((1 << bits) - 1)).astype(np.int64), pair >> bits
        last = self.ctx2 & 0xFF if contexts is None else (contexts & np.uint64(0xFF)).astype(np.int64)[self.ctx2]
        one, self.up = np.unique((self.of_word << 8) | last, return_inverse=True)
        self.ctx1, self.top = (one & 0xFF) + self.one, one >> 8
        self.t2 = np.minimum(n, 1) if t2 is None else t2
        self.t1 = np.minimum(self.c1(), 1) if t1 is None else t1
        self.t0 = np.minimum(self.c0(), 1) if t0 is None else t0
        self.acc = np.zeros(len(pair), np.float32) if acc is None else acc

    def c1(self) -> np.ndarray:
        return np.bincount(self.up, weights=self.t2, minlength=len(self.ctx1)).astype(np.int64)

    def c0(self) -> np.ndarray:
        return np.bincount(self.top, weights=self.t1, minlength=len(self.word)).astype(np.int64)

    def known(self) -> np.ndarray:
        """Training count of each word."""
        return np.bincount(self.of_word, weights=self.n, minlength=len(self.word)).astype(np.int64)

    @classmethod
    def load(cls, row) -> Bucket:
        runs = unsqueeze(row.runs, "<u4")
        pair = (np.repeat(np.arange(len(runs), dtype=np.int64), runs) << 32) | unsqueeze(row.ctx, "<u4")
        counts = [unsqueeze(b, "<u4").astype(np.int64) for b in (row.n, row.t2, row.t1, row.t0)]
        return cls(row.bucket, unsqueeze_sorted(row.words), pair, *counts, unsqueeze(row.acc, "<f4"), unsqueeze_sorted(row.ctxs))

    def row(self) -> tuple:
        ids = np.concatenate([self.ctx2, self.ctx1, np.full(len(self.word), self.root)])
        c, t = np.concatenate([self.n, self.c1(), self.c0()]), np.concatenate([self.t2, self.t1, self.t0])
        c, t = (np.bincount(ids, weights=x, minlength=self.sizes + 1).astype(np.int64) for x in (c, t))
        c[self.sizes], t[self.sizes] = self.n.sum(), (self.known() > 0).sum()
        lists = [None] * 3
        if self.contexts is not None:
            lists = [squeeze_sorted(self.contexts), squeeze(c[:self.one]), squeeze(t[:self.one])]
            c[:self.one] = t[:self.one] = 0
        used = np.flatnonzero((c > 0) | (t > 0))
        four = [squeeze(x.astype(np.uint32)) for x in (self.n, self.t2, self.t1, self.t0)]
        runs = np.bincount(self.of_word, minlength=len(self.word)).astype(np.uint32)
        return (self.number, squeeze_sorted(self.word), squeeze(runs), squeeze(self.ctx2.astype(np.uint32)), *four, squeeze(self.acc),
                (used - self.one + ONE).tolist(), c[used].tolist(), t[used].tolist(), *lists)

    def predictive(self, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the words at the root, of the pairs one level down, and of the full pairs, given the totals."""
        def level(k, own, tables, ids, parent):
            rest = (STRENGTH[k] + DISCOUNT[k] * t[ids]) * parent
            return (own - DISCOUNT[k] * tables + rest) / (STRENGTH[k] + c[ids])
        root = level(0, self.c0(), self.t0, self.root, 1 / (t[self.sizes] + 1))
        one = level(1, self.c1(), self.t1, self.ctx1, root[self.top])
        return root, one, level(2, self.n, self.t2, self.ctx2, one[self.up])

    def sweep(self, c: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> None:
        root, one, _ = self.predictive(c, t)
        self.t2 = seat(self.n, t[self.ctx2] - self.t2, 2, one[self.up], rng)
        self.t1 = seat(self.c1(), t[self.ctx1] - self.t1, 1, root[self.top], rng)
        self.t0 = seat(self.c0(), t[self.root] - self.t0, 0, np.full(len(self.word), 1 / (t[self.sizes] + 1)), rng)


def seat(n: np.ndarray, others: np.ndarray, k: int, parent: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating ``n`` customers of a dish anew, with ``others`` tables of other dishes in the restaurant.

    With s seated at t tables the next one opens a table with weight a = (strength + discount * all tables) * parent
    against s - discount * t; the number of customers up to the next new table is geometric with a beta(a, s - discount
    * t) chance.
    """
    tables = np.minimum(n, 1)
    at = np.flatnonzero(n > 1)
    seated = np.ones(len(at), np.int64)
    while len(at):
        weight = (STRENGTH[k] + DISCOUNT[k] * (others[at] + tables[at])) * parent[at]
        chance = rng.beta(np.maximum(weight, 1e-12), seated - DISCOUNT[k] * tables[at])
        seated = seated + rng.geometric(np.clip(chance, 1e-9, 1.0))
        still = seated <= n[at]
        at, seated = at[still], seated[still]
        tables[at] += 1
        more = seated < n[at]
        at, seated = at[more], seated[more]
    return tables


def merged(group: pd.DataFrame) -> Bucket:
    words = [unsqueeze_sorted(b) for b in group["words"]]
    word = np.unique(np.concatenate(words))
    lists = [unsqueeze_sorted(b) for b in group["ctxs"]]
    contexts = np.unique(np.concatenate(lists))
    code = [(np.repeat(np.searchsorted(word, w), unsqueeze(r, "<u4")).astype(np.int64) << 32) | np.searchsorted(contexts, c)[unsqueeze(x, "<u4")]
            for w, r, c, x in zip(words, group["runs"], lists, group["ctx"])]
    pair, where = np.unique(np.concatenate(code), return_inverse=True)
    n = np.bincount(where, weights=np.concatenate([unsqueeze(b, "<u4") for b in group["n"]]), minlength=len(pair)).astype(np.int64)
    return Bucket(int(group["bucket"].iloc[0]), word, pair, n, contexts=contexts)


def _context_totals(state: DataFrame, bits: int) -> DataFrame:
    """(bucket, shard, c, t): the totals of each bucket's contexts over all buckets, by shards of contexts in their order."""
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                code, c, t = unsqueeze_sorted(row.ctxs), unsqueeze(row.own_c, "<u8"), unsqueeze(row.own_t, "<u8")
                edge = np.r_[np.searchsorted(code, np.arange(2**bits, dtype=np.uint64) << np.uint64(64 - bits)), len(code)]
                yield _frame([(row.bucket, s, *(f(x[edge[s]:edge[s + 1]]) for f, x in ((squeeze_sorted, code), (squeeze, c), (squeeze, t))))
                              for s in range(2**bits) if edge[s] < edge[s + 1]], _PART)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        parts = [[read(b) for b in group[x]] for x, read in (("ctxs", unsqueeze_sorted), ("c", lambda b: unsqueeze(b, "<u8")), ("t", lambda b: unsqueeze(b, "<u8")))]
        code, where = np.unique(np.concatenate(parts[0]), return_inverse=True)
        c, t = (np.bincount(where, weights=np.concatenate(x), minlength=len(code)).astype(np.int64) for x in parts[1:])
        at = np.split(where, np.cumsum([len(x) for x in parts[0]])[:-1])
        return pd.DataFrame({"bucket": group["bucket"].to_numpy(), "shard": group["shard"].to_numpy(), "c": [squeeze(c[i]) for i in at], "t": [squeeze(t[i]) for i in at]})
    sent = state.select("bucket", "ctxs", "own_c", "own_t").mapInPandas(send, _PART)
    return sent.groupBy("shard").applyInPandas(add, "bucket int, shard int, c binary, t binary")


def _totals(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    each = state.select(F.explode(F.arrays_zip("total_id", "total_c", "total_t")).alias("x")).select("x.*")
    c, t = np.zeros(MAX_CONTEXTS, np.int64), np.zeros(MAX_CONTEXTS, np.int64)
    for r in each.groupBy("total_id").agg(F.sum("total_c").alias("c"), F.sum("total_t").alias("t")).collect():   # MAX_CONTEXTS rows at most
        c[r.total_id], t[r.total_id] = r.c, r.t
    return c, t


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def sampled(state: DataFrame, bits: int, sweeps: int = SWEEPS, kept: int = KEPT, seed: int = SEED) -> DataFrame:
    """The state after all sweeps; ``acc`` sums the predictive probabilities after each of the last ``kept`` ones."""
    def stepped(number: int, rest_c: np.ndarray, rest_t: np.ndarray) -> object:
        def step(group: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
            b, sums = Bucket.load(next(group.itertuples())), sums.sort_values("shard")
            c, t = (np.concatenate([*[unsqueeze(x, "<i8") for x in sums[name]], rest]) for name, rest in (("c", rest_c), ("t", rest_t)))
            if number > sweeps - kept:
                b.acc = (b.acc + b.predictive(c, t)[2]).astype(np.float32)
            if number < sweeps:
                b.sweep(c, t, np.random.default_rng([seed, number, b.number]))
            return _frame([b.row()], _STATE)
        return step

    for number in range(sweeps + 1):
        c, t = _totals(state)
        each = state.groupBy("bucket").cogroup(_context_totals(state, bits).groupBy("bucket"))
        after = scratch.table(each.applyInPandas(stepped(number, c[ONE:], t[ONE:]), _STATE), f"pitman-yor-{number}")
        discard(state)
        state = after
    return state


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, kept: int = KEPT, seed: int = SEED) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per input row."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, size / BUCKET_BYTES)))))
    sent = scratch.table(messages(docs, bits, id_col, text_col), "pitman-yor-messages")
    asked = sent.filter("bucket >= 0").select("chunk", "bucket", "words", "runs", "ctxs", "ctx", "n")

    def start(group: pd.DataFrame) -> pd.DataFrame:
        return _frame([merged(group).row()], _STATE)
    state = sampled(scratch.table(asked.groupBy("bucket").applyInPandas(start, _STATE), "pitman-yor-start"), bits, sweeps, kept, seed)
    free_shuffles(docs.sparkSession)
    c, t = _totals(state)
    total, vocabulary = int(c[SIZES]), int(t[SIZES])

    def answer(group: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        b = Bucket.load(next(model.itertuples()))
        known, out = b.known(), []
        for r in group.itertuples():
            which = np.searchsorted(b.word, unsqueeze_sorted(r.words))
            runs = unsqueeze(r.runs, "<u4")
            context = np.searchsorted(b.contexts, unsqueeze_sorted(r.ctxs))
            pair = (np.repeat(which, runs).astype(np.int64) << 32) | context[unsqueeze(r.ctx, "<u4")]
            out.append((r.chunk, r.bucket, squeeze(b.acc[np.searchsorted(b.pair, pair)]), squeeze(known[which]), squeeze(runs)))
        return pd.DataFrame(out, columns=["chunk", "bucket", "p", "known", "runs"])
    answers = asked.drop("n").groupBy("bucket").cogroup(state.select(*[c.split()[0] for c in _STATE.split(", ")[:9]], "ctxs").groupBy("bucket")).applyInPandas(
        answer, "chunk long, bucket int, p binary, known binary, runs binary")
    answers = scratch.table(answers, "pitman-yor-answers")     # what was shuffled for them goes before the streams are
    discard(state)
    streams = sent.filter("bucket < 0").select("chunk", "stream", "docs", "held", "lengths")

    def add_up(group: pd.DataFrame, stream: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bucket")
        p = np.concatenate([unsqueeze(b, "<f4") for b in group["p"]]).astype(np.float64) / kept
        known = np.concatenate([np.repeat(unsqueeze(k, "<i8"), unsqueeze(r, "<u4")) for k, r in zip(group["known"], group["runs"])])
        row = next(stream.itertuples())
        which, lengths = unsqueeze(row.stream, "<u4"), np.asarray(row.lengths)
        first = np.cumsum(lengths) - lengths
        over = lambda x: np.add.reduceat(x[which], first)
        base = np.log10((known + 0.1) / (total + 0.1 * (vocabulary + 1)))
        ids = pd.array([None if x is None or x != x else int(x) for x in row.docs], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "held_out": np.asarray(row.held, bool), "n_tokens": lengths, "n_known": over((known > 0).astype(np.int64)),
                             "train_tokens": total, "base_score": over(base), "score": over(np.log10(p))})
    return answers.groupBy("chunk").cogroup(streams.groupBy("chunk")).applyInPandas(add_up, _RESULT)
