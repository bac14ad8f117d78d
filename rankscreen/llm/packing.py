"""Concatenate and cut: all token ids in one long line, cut into sequences of a fixed length.

Pass one tokenizes each partition once and writes, per document, its ids, its place in the partition and the tokens
before it there. The totals of the partitions, one row each, are summed into offsets. Pass two reads the written ids,
adds the offset of their partition and cuts at multiples of the sequence length: boundary records say whether a
sequence edge splits the document before or after a piece. Nothing is shuffled but one total per partition, and all
sequences but the very last are full. Partition numbers and places are data once written, so a lost executor
changes nothing.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; an empty table gives no
pieces; a text longer than a sequence gives several pieces. Other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

LENGTH = 2048
END = 1
SLICE = 256
_BLANK = re.compile(r"\s{100000}")

_PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "split_before boolean, split_after boolean")


def byte_bpe(vocabulary: str) -> Callable[[list[str]], list[np.ndarray]]:
    """An encoder for the byte-level BPE in ``vocabulary``, a file of the tokenizers library.

    The same merges run through tiktoken from the rank file of the same name, several times as fast; a text that spells
    a special token goes to the tokenizers library itself, which reads it as that token. So does a text with a very long
    run of white space, on which tiktoken's pattern matcher runs out of stack.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(vocabulary)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(exact.encode(t, add_special_tokens=False).ids if any(s in t for s in special) or _BLANK.search(t)
                           else fast.encode_ordinary(t), dtype="<u4") for t in texts]
    return encode


def tokenized(docs: DataFrame, vocabulary: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, place, doc_id, n, before, ids``: ids as little-endian 16-bit numbers where the vocabulary allows, else 32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = byte_bpe(vocabulary), TaskContext.get().partitionId()
        place = before = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                piece = batch.slice(lo, SLICE)
                ids = [np.append(x, np.uint32(end)) for x in encode([t or "" for t in piece.column(1).to_pylist()])]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                blobs = [x.astype("<u2").tobytes() if int(x.max()) < 65536 else b"" for x in ids]
                wide = [b"" if b else x.astype("<u4").tobytes() for x, b in zip(ids, blobs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part), pa.int32()), pa.array(np.arange(place, place + len(ids)), pa.int64()),
                     piece.column(0), pa.array(n), pa.array(starts), pa.array(blobs, pa.binary()), pa.array(wide, pa.binary())],
                    names=["part", "place", "doc_id", "n", "before", "ids", "wide"])
                place += len(ids)
    schema = "part int, place long, doc_id long, n long, before long, ids binary, wide binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def cut(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of the written ``tokens`` table, without padding."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    first = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    offsets = totals.select("part", first.alias("first"))
    # One row per written partition: a million partitions are some 16 MB.
    lined = tokens.join(F.broadcast(offsets), "part").select("doc_id", "n", (F.col("first") + F.col("before")).alias("at"), "ids", "wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, n, at, ids, wide in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, "<u2").astype("<u4") if ids else np.frombuffer(wide, "<u4")
                edges = [0, *range(length - at % length, n, length), n]
                for a, b in zip(edges, edges[1:]):
                    out.append((doc, a, b - a, zlib.crc32(ids[a:b].tobytes()), n, (at + a) // length, (at + a) % length, a > 0, b < n))
            names = [f.split()[0] for f in _PIECE.split(", ")]
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    return lined.mapInArrow(run, _PIECE)


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    return cut(scratch.table(tokenized(docs, vocabulary, end, id_col, text_col), "pack-tokens"), length)
