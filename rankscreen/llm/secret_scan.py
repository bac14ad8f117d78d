r"""Secret scans with corpus-wide ownership.

Base spans come from three patterns. The method adds long mixed tokens (kind ``owned``) that may be live credentials:
every candidate is hashed, hashes are counted by distinct documents, repositories and owners over the whole corpus (first
per (hash, owner, repository, row), then per hash, so a value copied everywhere never meets in one task), and the counts go
back to the documents. A value that WIDE or more owners share, or that two owners have in WIDE_REPOS repositories, is a
copied example, not a live credential; it stays a span but is reported, and redacted, apart. A value of one owner is never
a copied example, however often that owner uses it, so no verdict changes because the corpus grows.

Spans are in code points, end exclusive. Defined results: null text is empty; null owner or repository counts as one
value of its own; repeated rows are scanned each; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch

KINDS = ("assign", "access", "hex", "owned")
WIDE = 3
#: (owner, repository) pairs in which a value of two owners is copied all the same.
WIDE_REPOS = 10
MIN_ENTROPY = 3.5
#: Of tokens that words could spell: without digits, or of digits and one case with separators.
WORDY_ENTROPY = 4.0

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIXED = re.compile(r"[A-Za-z0-9+/_-]{24,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Two of digits, upper and lower case or all three, and the entropy of a key."""
    digit, upper, lower = (any(map(test, value)) for test in (str.isdigit, str.isupper, str.islower))
    if digit + upper + lower < 2:
        return False
    return entropy(value) >= (MIN_ENTROPY if digit and (upper and lower or value.isalnum()) else WORDY_ENTROPY)


def scan(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) in order; candidates of kind ``owned`` overlap no base span.

    Runs of [0-9a-f] and of [A-Z0-9] are maximal, so asking for the least length in the pattern finds the same spans
    as dropping shorter matches afterwards; assignments are matched in full first and dropped after.
    """
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end(), m.start(1), m.end(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    base = sorted(found)
    for m in _MIXED.finditer(text):
        value = m.group()
        if (looks_random(value) and not any(s < m.end() and m.start() < e for s, _, e, _, _ in base)):
            found.append((m.start(), 3, m.end(), m.start(), m.end()))
    return sorted(found)


#: The id passes Python as text: a batch with a null id would hold the others as doubles, exact to 2^53 only.
_SCANNED = "doc_id string, row string, owner string, repo string, spans array<struct<start:int,kind:int,end:int,hash:string>>"


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its id and text; repeated rows share the key and their spans."""
    marked = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in (doc_id, text)]
    return F.md5(F.concat(marked[0], F.lit(":"), marked[1]).cast("binary"))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One row per document with its spans and the hash of each span's value."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = []
            for text in batch["text"]:
                text = text if isinstance(text, str) else ""
                spans.append([{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(text[a:b].encode()).hexdigest()[:32]}
                              for s, k, e, a, b in scan(text)])
            yield batch.drop(columns="text").assign(spans=spans)[["doc_id", "row", "owner", "repo", "spans"]]
    named = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(owner_col).cast("string").alias("owner"),
                        F.col(repo_col).cast("string").alias("repo"), F.col(text_col).cast("string").alias("text"))
    return named.mapInPandas(run, _SCANNED).withColumn("doc_id", F.col("doc_id").cast("long"))


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos, n_rows over the whole corpus; a null owner or repository is one value, repeated rows are one row."""
    own, repo = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("owner", "repo"))
    each = scanned.select(own.alias("owner"), repo.alias("repo"), "row", F.explode("spans.hash").alias("hash"))
    each = each.groupBy("hash", "owner", "repo", "row").agg(F.lit(1).alias("one"))
    each = each.groupBy("hash", "owner", "repo").agg(F.count("one").alias("rows"))
    each = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("rows").alias("rows"))
    return each.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("rows").alias("n_rows"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str = "lang", wide: int = WIDE, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """doc_id, row, spans (start, kind, end, hash, n_owners, n_repos, n_rows, copied), one row per document row."""
    scanned = scratch.table(candidates(docs, id_col, text_col, owner_col, repo_col), "secret-spans")
    flat = scanned.select("doc_id", "row", F.explode("spans").alias("s")).select("doc_id", "row", "s.*")
    known = flat.join(ownership(scanned), "hash")
    copied = (F.col("n_owners") >= wide) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= wide_repos))
    span = F.struct("start", "kind", "end", "hash", "n_owners", "n_repos", "n_rows", copied.alias("copied"))
    per = known.groupBy("row").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    none = F.array().cast(per.schema["spans"].dataType)
    return scanned.select("doc_id", "row").join(per, "row", "left").withColumn("spans", F.coalesce("spans", none))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, all spans as text, and every span with its counts and verdict."""
    name = F.array(*[F.lit(k) for k in KINDS])
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    # A second parameter of a filter's function is the index, so the kind is bound by a function of its own.
    of_kind = lambda k: lambda s: s["kind"] == k
    base = F.filter("spans", lambda s: s["kind"] < 3)
    verdicts = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"], s["end"], s["n_owners"], s["n_repos"], s["n_rows"],
        F.when(s["copied"], "copied").otherwise("live"))), ",")
    return found.select("doc_id", *[count(of_kind(k)).alias(f"n_{n}") for k, n in enumerate(KINDS[:3])],
                        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
                        count(lambda s: s["copied"]).alias("n_copied"), count(lambda s: ~s["copied"]).alias("n_live"), verdicts.alias("verdicts"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", owner_col: str = "source",
           repo_col: str = "lang", mark: str = "[secret]", wide: int = WIDE) -> DataFrame:
    """The documents with every live-looking span replaced; copied values (see above) stay as they are."""
    live = find_secrets(docs, id_col, text_col, owner_col, repo_col, wide).select(
        F.col("row").alias("__row"), F.filter("spans", lambda s: ~s["copied"]).alias("__spans"))
    live = live.filter(F.size("__spans") > 0).groupBy("__row").agg(F.first("__spans").alias("__spans"))
    joined = docs.withColumn("__row", row_key(F.col(id_col), F.col(text_col))).join(live, "__row", "left")
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.when(fresh, out).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
    clean = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = joined.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(clean))
    if chars_col in docs.columns:
        n = F.when(F.col("__spans").isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType))
        changed = changed.withColumn(chars_col, n)
    return changed.select(*docs.columns)
