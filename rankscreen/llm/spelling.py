"""Spelling variants: words one edit apart, found on a bit-sliced position index.

The words come from Spark: runs of letters, a hashed slip that deletes one letter of some of them, counts. Two words of
seven letters or more that differ by one inserted, deleted or replaced letter share their first three letters or their
last three, so every word belongs to two groups and no pair is looked for anywhere else. A group is an index of one
bitset per (position, letter), one bit per word. A query word runs through it letter by letter and carries four
bitsets for all words of the group at once: those that agree so far, those with one letter replaced, those with one
letter more and those with one less, the last two read at positions shifted by one. Only the number of near words and
the best of them leave the group, never the pairs. A group larger than a block is cut into blocks by a hash, and every
two of its blocks meet in a task of their own; small groups share a task. Pairs that agree at both ends count in the
group of the first three letters alone.

Forms grow in frequency by a fixed factor at every step, so following them ends; roots come by pointer doubling.

Defined results: null and empty texts have no words; a null doc_id hashes as the text "null"; repeated rows count as
often as they occur; an empty table gives no rows; other columns play no part; very long runs are words like others.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch

LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
SLIP = 31
END = 3
BLOCK = 8192
TASK_WORDS = 32_768
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: lower-cased runs of letters of enough length, one letter deleted where the hash of id and run says so."""
    low = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    # A shorter run cannot become a word, so the pattern skips it; what it matches is still a maximal run.
    runs = F.regexp_extract_all(low, F.lit(f"([a-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}})"), F.lit(1))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(name.alias("doc"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"), F.char_length("run").alias("len"))
    at = (F.col("h") % F.col("len")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("len")))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


class PositionIndex:
    """Bit b of ``at[p, letter]`` says that word b has the letter at position p."""

    def __init__(self, words: list[str]):
        self.words, self.all = words, (1 << len(words)) - 1
        rows: dict[tuple, list[int]] = defaultdict(list)
        for b, word in enumerate(words):
            for p, letter in enumerate(word):
                rows[p, letter].append(b)
            rows[len(word), None].append(b)
            rows["start", word[:END]].append(b)
        self.at = {k: self._bits(v) for k, v in rows.items()}
        longest = max(map(len, words), default=0)
        self.longer = [0] * (longest + 2)   # longer[p]: words with a letter at position p
        for p in range(longest - 1, -1, -1):
            self.longer[p] = self.longer[p + 1] | self.at.get((p + 1, None), 0)

    def _bits(self, places: list[int]) -> int:
        packed = bytearray(places[-1] // 8 + 1)
        for b in places:
            packed[b >> 3] |= 1 << (b & 7)
        return int.from_bytes(packed, "little")

    def near(self, word: str) -> int:
        """The words that differ from ``word`` by exactly one edit, as a bitset."""
        at, same, replaced, more, less = self.at.get, self.all, 0, 0, 0
        for p, letter in enumerate(word):
            has = self.longer[p] if p < len(self.longer) else 0
            here = at((p, letter), 0)
            replaced = (replaced & here) | (same & has & ~here)
            more = (more | (same & has)) & at((p + 1, letter), 0)
            less = (less & at((p - 1, letter), 0)) | same
            same &= here
            if not (same or replaced or more or less):
                return 0
        m = len(word)
        more |= same & (self.longer[m] if m < len(self.longer) else 0)
        return (replaced & at((m, None), 0)) | (more & at((m + 1, None), 0)) | (less & at((m - 1, None), 0))


def _places(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def best_of(words: list[str], n: list[int], index: PositionIndex, counts: list[int], suffix: bool) -> list[tuple]:
    """(word, near words, count of the best, best) for each word that has any among those of the index."""
    out = []
    for word in words:
        found = index.near(word)
        if suffix:
            found &= ~index.at.get(("start", word[:END]), 0)
        if found:
            places = _places(found)
            top = min(places, key=lambda b: (-counts[b], index.words[b]))
            out.append((word, len(places), counts[top], index.words[top]))
    return out


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best_n, best for every word with a near one; ``vocabulary``: word, n."""
    total = vocabulary.count()
    ends = F.array(F.struct(F.lit(False).alias("suffix"), F.substring("word", 1, END).alias("gram")),
                   F.struct(F.lit(True).alias("suffix"), F.expr(f"right(word, {END})").alias("gram")))
    placed = vocabulary.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.suffix", "e.gram")
    sizes = placed.groupBy("suffix", "gram").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # Only groups of several blocks are copied; there are at most 2 * words / BLOCK of those.
    large = sizes.filter("blocks > 1")
    placed = placed.join(large, ["suffix", "gram"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tasks = max(1, -(-2 * total // TASK_WORDS))
    task = F.when(F.col("blocks") > 1, F.xxhash64("suffix", "gram", "i", "j")).otherwise(F.pmod(F.xxhash64("suffix", "gram"), F.lit(tasks)))
    placed = placed.select(task.alias("task"), "suffix", "gram", "i", "j", "block", "word", "n")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (suffix, _, i, j), group in rows.groupby(["suffix", "gram", "i", "j"], sort=False):
            sides = {b: (part["word"].tolist(), part["n"].tolist()) for b, part in group.groupby("block")}
            for a, b in {(i, j), (j, i)}:
                if a in sides and b in sides:
                    out += best_of(*sides[a], PositionIndex(sides[b][0]), sides[b][1], suffix)
        return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"]).astype({"n_near": "int64", "best_n": "int64"})
    found = placed.groupBy("task").applyInPandas(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("k"), "best")).alias("b")).select(
        "word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached by following ``forms`` (word, form), by pointer doubling."""
    now = scratch.table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = now.join(step, "root", "left")
        longer = scratch.table(longer.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if longer.filter("moved").isEmpty():
            return longer.select("word", "root")
        now = longer.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, one row per word."""
    vocabulary = scratch.table(word_counts(docs, id_col, text_col), "spelling-words")
    near = scratch.table(near_words(vocabulary), "spelling-near")
    rows = vocabulary.join(near, "word", "left")
    strong = F.col("best_n") >= factor * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"),
                       F.when(strong, F.col("best_n")).alias("form_n"))
    rows = scratch.table(rows, "spelling-forms")
    last = roots(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
