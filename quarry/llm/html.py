"""Main text of HTML pages by maximum-scoring subsequence.

A page is a sequence of tokens: words and tags. Words score positive and tags negative, and one linear scan finds the contiguous
run of tokens with the greatest sum: the content region, of which the words are returned. A tag is known by its name, or by its name and
each of its class and id words (`div.ad`); its weight is the greatest of these.

The weights come from labelled pages, pages with one article element, which says of each of their tokens whether it is content. They start as
log odds that a tag stands outside the article. Then, page by page, where the best region with the weights so far reaches beyond the
article, the tags it passes there (but for those of elements that hold an article) are made dearer, until they outweigh MARGIN times the
words that they let in. A sample of FIT_PAGES
pages is fitted to, of FIT_BYTES each at most. An element with class or id words whose tags cost more than its words bring is dear: its words
score negative too, and where it stands between words of the region they are left out.

What the scan never sees is what is no text (scripts, styles, comments of the markup) and the elements that are not the article by
definition, by tag or role (menus, headers and footers of the page, asides, forms, what is hidden); class and id words decide by
their weights, but for such names of these parts (WORDS_FOR) as no labelled page has.

Defined cases: a null, empty or wordless page has an empty text; unclosed elements end with the one around them, and cut tags
are dropped; of equal best regions the first is taken; repeated rows are pages of their own; an empty table gives
an empty result; without labelled pages every tag costs LEAST_LOSS; an input column that is called `_h_text` is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import base

FIT_PAGES, FIT_BYTES, FIT_ROUNDS = 200, 1 << 18, 20
#: Least loss for a tag: the scan then never prefers markup without words.
LEAST_LOSS, MOST_ODDS, WORD_GAIN, MARGIN = 0.01, 3.0, 1.0, 4.0

# Elements of HTML by their role.
DROPPED = frozenset("nav footer aside form button select textarea script style noscript template iframe object svg canvas dialog menu head title audio video map datalist fieldset label option".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
WHOLE = frozenset("html body main article".split())
IMPLIED_END = frozenset("p li dt dd".split())
WORDS_FOR = frozenset("menu navigation navbar breadcrumb breadcrumbs sidebar masthead footer notice cookie-notice cookie-banner advert advertisement adverts sponsored comments comment comment-list newsletter".split())
_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|([^<]+|<)""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Token(NamedTuple):
    """A run of text, or a tag with the keys of its element."""

    text: str
    tag: str = ""
    closing: bool = False
    keys: tuple[str, ...] = ()


def _element(tag: str, attrs: str, inside: bool, weights: dict[str, float] | None) -> tuple[tuple[str, ...], bool]:
    """(keys, whether it can't be content). inside: within an article or main element, whose own header is part of it."""
    never = tag in DROPPED or (tag == "header" and not inside)
    if not attrs.strip("/ \t\r\n"):
        return (tag,), never
    found = {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)}
    words = [w.lower() for w in [*found.get("class", "").split(), found.get("id", "")] if w]
    keys = tuple(f"{tag}.{w}" for w in words) or (tag,)
    if tag in WHOLE:
        return keys, never
    never |= "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
    never |= found.get("role", "").lower() in _ROLE
    return keys, never or (weights is not None and any(w in WORDS_FOR and f"{tag}.{w}" not in weights for w in words))


def tokens(html: str, weights: dict[str, float] | None) -> Iterator[Token]:
    """Text and tags in page order, without what can't be content. weights: None while they are still to be learned."""
    skip, depth, inside, at, end = "", 0, 0, 0, len(html)
    opened: list[tuple[str, tuple[str, ...]]] = []
    count: Counter[str] = Counter()  # of the open elements, by tag
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        text = m.group(7)
        if text is not None:
            if not skip:
                yield Token(text)
            continue
        tag = m.group(2) or m.group(5)
        if tag is None:  # a comment, a declaration, a cut tag
            continue
        tag, closing, attrs = tag.lower(), bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
        if skip:
            if tag == skip:
                depth += -1 if closing else not attrs.endswith("/")
                if skip in IMPLIED_END and not closing:  # the next of its kind ends it
                    depth = 0
            elif skip in IMPLIED_END and tag not in INLINE and tag not in VOID:
                depth = 0
            if depth > 0:
                continue
            was, skip = skip, ""
            yield Token("", was, True, (was,))
            if closing and tag == was:
                continue
        if tag in ("article", "main"):
            inside = max(0, inside + (-1 if closing else 1))
        if closing:
            keys = (tag,)
            if count[tag]:
                while opened:  # what is still open within ends with it
                    t, keys = opened.pop()
                    count[t] -= 1
                    if t == tag:
                        break
            yield Token("", tag, True, keys)
            continue
        keys, never = _element(tag, attrs, inside > (tag in ("article", "main")), weights)
        if tag in VOID:
            yield Token("", tag, False, keys)
        elif never and tag in RAW:  # up to its closing tag nothing is markup
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
            yield Token("", tag, False, (tag,))
        elif never:
            if not attrs.endswith("/"):
                skip, depth = tag, 1
            yield Token("", tag, False, (tag,))
        else:
            opened.append((tag, keys))
            count[tag] += 1
            yield Token("", tag, False, keys)


def costs(parts: list[Token], weights: dict[str, float]) -> list[float]:
    return [-max(weights.get(k, LEAST_LOSS) for k in t.keys) if t.tag else WORD_GAIN * len(t.text.split()) for t in parts]


def dear(parts: list[Token], scores: list[float]) -> list[tuple[int, int]]:
    """[from, to) of the elements with class or id words whose tags cost more than their words bring. What a dear element within
    costs is not held against the one around it."""
    opened: list[tuple[int, Token, float]] = [(-1, Token(""), 0.0)]
    count: Counter[str] = Counter()
    out = []
    for i, (t, x) in enumerate(zip(parts, scores, strict=True)):
        at, top, total = opened.pop()
        if t.tag and not t.closing and t.tag not in VOID:
            opened += [(at, top, total), (i, t, x)]
            count[t.tag] += 1
            continue
        opened.append((at, top, total + x))
        if t.closing and count[t.tag]:
            while True:
                at, o, total = opened.pop()
                count[o.tag] -= 1
                if "." in o.keys[0] and o.tag not in WHOLE and total < 0:
                    out.append((at, i + 1))
                    total = 0.0
                before, around, rest = opened.pop()
                opened.append((before, around, rest + total))
                if o.tag == t.tag:
                    break
    return out


def covered(spans: list[tuple[int, int]], n: int) -> list[bool]:
    """Which of n tokens some span holds."""
    steps = [0] * (n + 1)
    for a, b in spans:
        steps[a] += 1
        steps[b] -= 1
    return [x > 0 for x in accumulate(steps[:n])]


def scored(parts: list[Token], weights: dict[str, float]) -> list[float]:
    """Words of a dear element are no gain: they score as much below zero as others above. That is what it costs to pass it."""
    scores = costs(parts, weights)
    within = covered(dear(parts, scores), len(parts))
    return [x if not inside else -LEAST_LOSS if t.tag else -x for t, x, inside in zip(parts, scores, within, strict=True)]


def region(scores: list[float]) -> tuple[int, int]:
    """[from, to) of the contiguous run with the greatest positive sum; of equal ones the first."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, where = total, (start, i + 1)
    return where


def left_out(parts: list[Token], weights: dict[str, float], a: int, b: int) -> list[bool]:
    """Which tokens stand in a dear element between words of the region [a, b)."""
    said = [i for i in range(a, b) if not parts[i].tag and parts[i].text.strip()]
    spans = [(x, y) for x, y in dear(parts, costs(parts, weights)) if said and said[0] < x and y <= said[-1]]
    return covered(spans, len(parts))


def _around(parts: list[Token], at: int) -> set[str]:
    """The keys of the elements that are open at a token."""
    opened: list[Token] = []
    count: Counter[str] = Counter()
    for t in parts[:at]:
        if t.tag and t.tag not in VOID:
            if not t.closing:
                opened.append(t)
                count[t.tag] += 1
            elif count[t.tag]:
                while True:
                    o = opened.pop()
                    count[o.tag] -= 1
                    if o.tag == t.tag:
                        break
    return {k for t in opened for k in t.keys}


def fit(pages: list[str]) -> dict[str, float]:
    """Loss by tag, of labelled pages."""
    inner, outer, around, known = Counter(), Counter(), set(), []
    for html in pages:
        parts = list(tokens(html, None))
        begins = [i for i, t in enumerate(parts) if t.tag == "article" and not t.closing]
        if len(begins) != 1:
            continue
        a = begins[0]
        b = next((i + 1 for i, t in enumerate(parts) if i > a and t.tag == "article"), len(parts))
        around.update(_around(parts, a))
        for i, t in enumerate(parts):
            if t.tag:
                (inner if a <= i < b else outer).update(t.keys)
        known.append((parts, a, b))
    weights = {k: min(MOST_ODDS, max(LEAST_LOSS, math.log((outer[k] + 1) / (inner[k] + 1)))) for k in set(inner) | set(outer)}
    for _ in range(FIT_ROUNDS):
        moved = False
        for parts, a, b in known:
            scores = [x if t.tag or a <= i < b else MARGIN * x for i, (t, x) in enumerate(zip(parts, costs(parts, weights), strict=True))]
            x, y = region(scores)
            for span in (range(x, min(a, y)), range(max(b, x), y)):  # what it lets in before the article, and behind
                tags = [parts[i] for i in span if parts[i].tag and not around.intersection(parts[i].keys)]
                excess = sum(scores[i] for i in span)
                if tags and excess > 0:
                    moved = True
                    for k in {max(t.keys, key=lambda k: weights.get(k, LEAST_LOSS)) for t in tags}:
                        weights[k] += (excess + 1) / len(tags)
        if not moved:
            break
    return weights


def main_text(html: str | None, weights: dict[str, float]) -> str:
    if not html:
        return ""
    parts = list(tokens(html, weights))
    scores = scored(parts, weights)
    a, b = region(scores)
    gone = left_out(parts, weights, a, b)
    # Character references are decoded in each run of text; inline tags do not part words.
    out = ["" if gone[i] else unescape(t.text) if not t.tag else "" if t.tag in INLINE else "\n" for i, t in enumerate(parts[a:b], a)]
    return " ".join("".join(out).split())


def sample(pages: DataFrame, html: str = "html", key: str = "page_id") -> list[str]:
    """FIT_PAGES pages with one article, those whose keys have the least hashes; one page for each key."""
    one = F.regexp_count(F.col(html), F.lit(r"(?i)<article[\s>]")) == 1
    fit_for = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).filter((F.octet_length(html) <= FIT_BYTES) & F.col(key).isNotNull() & one)
    ids = [r[0] for r in fit_for.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(FIT_PAGES).collect()]
    if not ids:
        return []
    return [r[1] for r in sorted(fit_for.filter(F.col("key").isin(ids)).groupBy("key").agg(F.min("html")).collect())]


def extracted(pages: DataFrame, weights: dict[str, float], html: str = "html") -> DataFrame:
    """pages with their main text in _h_text."""
    base.ready(pages.sparkSession)

    @F.arrow_udf("string")
    def udf(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in it:
            yield pa.array([main_text(x.as_py(), weights) for x in rows], pa.string())

    return pages.withColumn("_h_text", udf(F.col(html)))


def op1_max_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = base.read(spark, sf_dir, "pages")
    out = extracted(pages, fit(sample(pages)))
    return out.select("page_id", "url", F.col("_h_text").alias("text"), F.length("_h_text").cast("long").alias("n_chars"))
