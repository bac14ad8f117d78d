"""HTML extraction by the maximum-scoring subsequence.

A page is a line of words and tags. Words score zero or more by what they stand in: the log odds, learned from labelled
pages, of the elements and names (class, id, role) around them, against those of any word. Tags score below zero, the more the less their element is seen in
articles. One linear scan finds the contiguous region with the largest sum, and the blocks in it whose words score
above zero are the text: a menu or an advert inside the region stays out and does not cut it in two.

Labelled pages are the pages that mark their article themselves with exactly one ``<article>`` element. That mark is used for
counting only; ``article`` and the other neutral elements are no features, so pages without it are scored alike.
Counts start from a prior over the usual names of boilerplate, which decides where no labelled page has a name. A name of
boilerplate that holds half of the words of a marked article or more wraps it, and counts them as inside; a smaller part under
such a name says nothing, since marks do not tell an advert in an article from its text. Names of html, body, main and article
themselves state what the page is, so they are features of their own without a prior.
Features are kept if one in RARE labelled pages has them, so the broadcast weights are at most RARE times the
features of a page.

Inside a block white space is one space, blocks are trimmed and joined by one space, references are decoded. Defined
results: null and empty pages, and pages without a scoring word, give the empty text; unclosed and crossed tags close
with their block; scripts, styles, templates and comments are dropped unread, up to the end of the page if they never close; what stands in
svg, iframe, textarea, canvas, audio and video is dropped where these close, and read as the page where they never do.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch

RARE = 1000
PRIOR = 20.0
CAP = 4.0
#: Evidence for an article counts less than evidence against one: a paragraph in an advert is an advert.
CAP_FOR = 2.0
NO_EVIDENCE = 0.5
NEUTRAL_COST = 0.3
LEAST_COST = 0.1

# Elements by what they do, and names that sites give to boilerplate.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
select summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEUTRAL = frozenset("html body main article div section".split())
WHOLE = frozenset("html body main article".split())
UNREAD = frozenset("script style template iframe svg textarea canvas audio video".split())
TO_THE_END = frozenset("script style template".split())
NOISE_ELEMENTS = frozenset("nav header footer aside form menu button select option fieldset legend label dialog head title input".split())
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist
cookie cookies consent copyright disqus discussion feedback footer form gdpr header masthead menu modal nav navbar navigation newsletter notice
notices overlay pagination pager popup promo promotion recommended related replies reply respond search share sharing
sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets""".split())
BODY_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd figcaption".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
_CLOSES = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in UNREAD}
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")

Block = tuple[frozenset, str, tuple[str, ...], bool]


def blocks(page: str) -> list[Block]:
    """(features around, text, tags before, inside <article>) for each run of text between block borders, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    run: list[str] = []
    tags: list[str] = []
    articles = 0
    around: frozenset = frozenset()

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append((around, text, tuple(tags), articles > 0))
            tags.clear()

    at, open_ended = 0, set()
    while m := _TOKEN.match(page, at):
        at = m.end()
        token, name = m.group(), m.group(2)
        if name is None:
            if not (token[0] == "<" and len(token) > 1):
                run.append(token)
            continue
        name = name.lower()
        if name in UNREAD and not m.group(1) and not (name == "svg" and token.endswith("/>")) and name not in open_ended:
            if close := _CLOSES[name].search(page, at):
                at = close.end()
            elif name in TO_THE_END:
                break
            else:
                open_ended.add(name)
            continue
        if name == "br":
            run.append(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        tags.append(name)
        if m.group(1):
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID:
            if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                stack.pop()
            elif stack and stack[-1][0] == "p":
                stack.pop()
            mark = ":" if name in WHOLE else "."
            names = {mark + "-".join(_WORDS.findall(n)) for value in _NAMES.findall(m.group(3)) for n in value.lower().split()}
            own = frozenset(names - {mark} | ({name} - NEUTRAL))
            stack.append((name, own))
        around = frozenset().union(*(f for _, f in stack))
        articles = sum(n == "article" for n, _ in stack)
    flush()
    return out


def is_noise(feature: str) -> bool:
    return feature in NOISE_ELEMENTS or feature[:1] == "." and not NOISE_WORDS.isdisjoint(feature[1:].split("-"))


def learn(pages: DataFrame, html_col: str = "html", rare: int = RARE) -> dict[str, float]:
    """Feature weights from the pages that mark one article: log odds of words inside against outside."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen, inside, outside, labelled = Counter(), Counter(), Counter(), 0
            for page in batch["html"]:
                if not isinstance(page, str) or len(re.findall(r"<article\b", page, re.I)) != 1:
                    continue
                labelled += 1
                names, found = set(), blocks(page)
                held = Counter()
                for around, text, _, within in found:
                    if within:
                        held.update({f: text.count(" ") + 1 for f in (*filter(is_noise, around), "")})
                for around, text, _, within in found:
                    noise = frozenset(filter(is_noise, around))
                    if within and any(2 * held[f] < held[""] for f in noise):
                        continue
                    # Outside, what a name of boilerplate explains counts for that name and the page alone.
                    used = around if within or not noise else noise | {f for f in around if f[0] == ":"}
                    target = inside if within else outside
                    for f in (*used, ""):
                        target[f] += text.count(" ") + 1
                        names.add(f)
                seen.update(names)
            seen["\0pages"] = labelled
            yield pd.DataFrame([(f, n, inside[f], outside[f]) for f, n in seen.items()], columns=["feature", "pages", "inside", "outside"])
    each = pages.select(F.col(html_col).cast("string").alias("html")).mapInPandas(count, "feature string, pages long, inside long, outside long")
    sums = scratch.table(each.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("pages", "inside", "outside")]), "page-features")
    total = sums.filter(F.col("feature") == "\0pages").agg(F.max("pages")).first()[0] or 0
    rows = sums.filter((F.col("pages") * rare >= total) & (F.col("feature") != "\0pages")).collect()
    return weights({r.feature: (r.inside, r.outside) for r in rows})


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    inside, outside = counts.get("", (0, 0))
    base = (inside + 1) / (inside + outside + 2)
    usual = math.log(base / (1 - base))
    known = {}
    for f in {*counts, *NOISE_ELEMENTS, *BODY_ELEMENTS, *("." + w for w in NOISE_WORDS)} - {""}:
        a, b = counts.get(f, (0, 0))
        prior = 0.02 if is_noise(f) else 0.9 if f in BODY_ELEMENTS else base
        share = (a + PRIOR * prior) / (a + b + PRIOR)
        odds = math.log(share / (1 - share)) - usual
        known[f] = max(-CAP, min(CAP_FOR, odds))
    return known


def word_score(around: frozenset, weight: dict[str, float]) -> float:
    """All evidence against an article, the strongest evidence for it, and a little for any word; zero at least.

    Elements that speak for an article are nested in each other, so only one of them counts.
    """
    odds = [weight[f] if f in weight else -CAP if is_noise(f) else 0.0 for f in around]
    return max(0.0, NO_EVIDENCE + max([0.0, *odds]) + sum(x for x in odds if x < 0))


def tag_score(name: str, weight: dict[str, float]) -> float:
    return min(weight.get(name, -NEUTRAL_COST), -LEAST_COST)


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The text of the best contiguous region: Kadane's scan over blocks, each its words after the tags before it."""
    found = blocks(page or "")
    scores = [word_score(around, weight) for around, *_ in found]
    best, span, here, start = 0.0, (0, 0), 0.0, 0
    for i, (_, text, tags, _) in enumerate(found):
        here += sum(tag_score(t, weight) for t in tags)
        if here <= 0.0:
            here, start = 0.0, i
        here += scores[i] * (text.count(" ") + 1)
        if here > best:
            best, span = here, (start, i + 1)
    return " ".join(found[i][1] for i in range(*span) if scores[i] > 0)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, one row per input row."""
    weight = learn(pages, html_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [extract(p if isinstance(p, str) else "", weight) for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return named.mapInPandas(run, "page_id long, url string, text string, n_chars long")
