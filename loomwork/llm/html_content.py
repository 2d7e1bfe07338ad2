"""Main text of web pages as the maximum-scoring run of tokens.

A page is cut into tokens: words, and tags. Each token scores by a log-odds weight learnt from labelled pages: words
score by the element they stand in (a word of a paragraph positive, a word of a menu link negative), tags by their name
(all negative). One linear scan finds the contiguous run with the greatest sum; its words are the content, less those
inside elements that are never content (menus, forms, scripts, adverts, comments and so on).

Labels come from pages that mark their content with ``<main>``, ``role=main`` or ``<article>``: tokens inside are
content, the rest not. The weights are fitted on a sample of about ``SAMPLE`` such pages, those whose hash lies below
the share that is wanted, so no task gathers pages. How much a mark itself tells is learnt too, by how often the runs
that the other weights find agree with it; it adds to the weight of a word inside and takes from one outside, within
``MARK``, and a tag inside counts ``IN_MARK`` of its weight. Several articles count as marks if they hold half of the
page's words at least, so cards and comments beside a body of another kind don't. Where a page falls into several regions
they are taken in page order: with marks every run that scores above nothing, however short, and without marks each that has
``PART`` of the best one's score at least, as what nothing marks and is short is as likely a caption or a notice.

Elements that are never content are told by tag, role, or the names in their class and id. A name counts if it is a
whole class, or the first or last part of a compound one (not of one that says with, has or no, and not on a text
element such as a paragraph). An element that holds all of the page's marks, or most of its words where there are none,
is a wrapper whatever its name.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one
space. Inline tags do not part words.

Cases: null or empty html gives an empty text; cut-off tags, comments and elements end with the page; end tags without
a start are passed over; pages without content words give an empty text; repeated rows are extracted alike; further
columns are ignored.
"""

from __future__ import annotations

import html as entities
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import table

#: Pages whose marks train the weights.
SAMPLE = 4000

# Fixed values of HTML: elements whose inside is no text of the page, that have no end tag, that do not end a line.
RAW = ["script", "style", "noscript", "template", "iframe", "textarea", "title", "svg"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "math", "mfrac", "mi", "mn", "mo", "mrow", "msub", "msup", "mtext", "object", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that end at the next one of their kind.
ENDLESS = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
#: Tags with weights of their own; all others share one.
KNOWN = INLINE | VOID | ENDLESS | TEXT | {
    "address", "article", "aside", "body", "button", "caption", "center", "colgroup", "details", "dialog", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "head", "header", "hgroup", "html", "legend", "main", "menu", "nav", "ol", "section", "select", "summary", "table",
    "tbody", "tfoot", "thead", "ul"}
#: Elements, roles and names whose insides are never content.
SIDE = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "alertdialog", "status"}
NAMES = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
    "commentlist", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "hidden", "legal", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo",
    "promos", "recommended", "recommendations", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "skiplink", "social",
    "sponsor", "sponsored", "sponsors", "subscribe", "tagcloud", "tags", "toolbar", "topbar", "widget", "widgets"}
#: Parts of a compound name that speak of something else's presence.
ABOUT = {"with", "has", "have", "no", "non", "not", "without", "layout"}

_token = re.compile(
    r"<!--.*?(?:-->|\Z)"  # a comment
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/?>|\Z)(?:.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<[/a-z!?][^>]*(?:>|\Z)"  # what else looks like a tag
    r"|(?P<text>[^<]+|<)",
    re.I | re.S)
_attr = re.compile(r"([^\s=>\"'/]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?|.", re.S)


class Token:
    """A word or a tag: ``key`` selects its weight; ``aside`` tells that it stands inside an element without content."""

    __slots__ = ("key", "word", "aside", "marked", "block", "glued")

    def __init__(self, key: str, word: str | None, block: int, glued: bool):
        self.key, self.word, self.block, self.glued = key, word, block, glued
        self.aside = self.marked = False


def _named(tag: str, value: str) -> bool:
    for name in value.split():
        parts = [x.rstrip("0123456789") for x in re.split(r"[-_:.]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())]
        if "".join(parts) in NAMES:
            return True
        if tag not in TEXT and (parts[0] in NAMES or parts[-1] in NAMES) and not ABOUT & set(parts):
            return True
    return False


def _kind(tag: str, attrs: str, owned: bool) -> tuple[bool, bool]:
    """Whether an element looks like one without content, and whether it is marked as the main one.

    A header is ``owned`` inside an element that marks content.
    """
    side, main = tag in SIDE and not (tag == "header" and owned), tag == "main"
    for m in _attr.finditer(attrs) if attrs else ():
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            side, main = side or value.lower() in ROLES, main or value.lower() == "main"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            side = True
        elif name in ("class", "id") and tag not in ("html", "body") and _named(tag, value):
            side = True
    return side and not main, main


class _Page:
    """Tokens of a page and the extents of the elements that matter, as token numbers from the start tag to the end."""

    def __init__(self, page: str):
        self.tokens: list[Token] = []
        self.sides: list[tuple[int, int]] = []
        self.mains: list[tuple[int, int]] = []
        self.articles: list[tuple[int, int]] = []
        self.headings: list[int] = []
        # Tag, its number, what it is, and the innermost element below that is no inline one (links apart, and without links).
        stack: list[tuple[str, int, list[tuple[int, int]] | None, str, str]] = []
        open_: dict[str, int] = {}
        block, glued = 0, False  # glued: the next text goes on with the last word
        heads = 0  # open elements that mark content: a header in them is theirs

        def close() -> str:
            nonlocal heads
            tag, start, extents, *_ = stack.pop()
            open_[tag] -= 1
            if extents is not None:
                extents.append((start, len(self.tokens)))
                heads -= extents is not self.sides
            return tag

        for m in _token.finditer(page):
            if m["text"] is not None:
                text = entities.unescape(m["text"])
                words = text.split()
                if words:
                    key = f"w:{stack[-1][3]}" if stack else "w:"
                    joined = glued and not text[0].isspace()
                    for w in words:
                        self.tokens.append(Token(key, w, block, joined))
                        joined = False
                    glued = not text[-1].isspace()
                elif text:
                    glued = False
                continue
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            known = tag if tag in KNOWN else "other"
            if tag not in INLINE:
                block, glued = block + 1, False
            if m["end"]:
                if open_.get(tag):
                    while close() != tag:
                        pass
                self.tokens.append(Token(f"/{known}", None, block, False))
                continue
            attrs = m["attrs"] or ""
            if tag in ENDLESS and stack and stack[-1][4] == tag:  # with the inline elements that it left open
                while close() != tag:
                    pass
            side, main = _kind(tag, attrs, heads > 0)
            if tag == "h1":
                self.headings.append(len(self.tokens))
            extents = self.sides if side else self.mains if main else self.articles if tag == "article" else None
            start = len(self.tokens)
            self.tokens.append(Token(known, None, block, False))
            if tag in VOID or attrs.endswith("/"):
                continue
            inline = tag in INLINE
            box, out = (stack[-1][3], stack[-1][4]) if stack else ("", "")
            stack.append((tag, start, extents, known if not inline or tag == "a" else box, out if inline else tag))
            open_[tag] = open_.get(tag, 0) + 1
            heads += extents is not None and not side
        while stack:
            close()

    def settle(self) -> bool:
        """Fill in ``aside`` and ``marked`` of the tokens; whether the page marks content."""
        found, n = self.tokens, len(self.tokens)
        words = _sums(n, ((i, 1) for i, t in enumerate(found) if t.word is not None))
        mains, articles, heads = (_sums(n, ((s, 1) for s in x)) for x in ([s for s, _ in self.mains], [s for s, _ in self.articles], self.headings))
        largest = max(self.articles, key=lambda x: words[x[1]] - words[x[0]], default=None)

        def wraps(s: int, e: int) -> bool:
            if mains[n]:
                return mains[e] - mains[s] == mains[n]
            most, headed = 2 * (words[e] - words[s]) > words[n], heads[e] - heads[s] == heads[n]
            if largest:
                return articles[e] - articles[s] == articles[n] and (most or headed and heads[n] > 0) or most and s <= largest[0] < e
            return most and headed

        for t, k in zip(found, _covered(n, [x for x in self.sides if not wraps(*x)]), strict=True):
            t.aside = k
        text = _sums(n, ((i, 1) for i, t in enumerate(found) if t.word is not None and not t.aside))
        held = [x for x in self.mains if text[x[1]] > text[x[0]]]
        if not held:
            held = [x for x in self.articles if text[x[1]] > text[x[0]]]
            inside = _covered(n, held)
            if len(held) > 1 and 2 * sum(1 for t, k in zip(found, inside, strict=True) if k and t.word is not None and not t.aside) < text[n]:
                held = []
        for t, k in zip(found, _covered(n, held), strict=True):
            t.marked = k
        return bool(held)


def _sums(n: int, at: Iterable[tuple[int, int]]) -> list[int]:
    """Sums of what lies before each of n places and the end."""
    steps = [0] * (n + 1)
    for i, k in at:
        steps[i + 1 if i < n else n] += k
    return list(itertools.accumulate(steps))


def _covered(n: int, extents: list[tuple[int, int]]) -> list[bool]:
    steps = [0] * (n + 1)
    for s, e in extents:
        steps[s] += 1
        steps[e] -= 1
    return [k > 0 for k in itertools.accumulate(steps[:n])]


def tokens(page: str) -> tuple[list[Token], bool]:
    """The page's tokens, and whether it marks its content."""
    found = _Page(page)
    marks = found.settle()
    return found.tokens, marks


def counts_of(page: str) -> tuple[Counter, Counter] | None:
    """Tokens inside and outside the marked content of a page, by key; None if it marks none."""
    found, marks = tokens(page)
    if not marks:
        return None
    inside, outside = Counter(), Counter()
    for t in found:
        if t.word is not None or not t.aside:
            (inside if t.marked and not t.aside else outside)["w!" if t.aside else t.key] += 1
    return inside, outside


def agreement_of(page: str, weight: dict[str, float]) -> tuple[Counter, Counter] | None:
    """Words with (``m+``) and without (``m-``) the mark, inside and outside the run that the other weights find."""
    found, marks = tokens(page)
    if not marks:
        return None
    start, end = best_run([score(t, weight, False) for t in found])
    inside, outside = Counter(), Counter()
    for i, t in enumerate(found):
        if t.word is not None and not t.aside:
            (inside if start <= i < end else outside)["m+" if t.marked else "m-"] += 1
    return inside, outside


def _counted(pages: DataFrame, count: Callable[[str], tuple[Counter, Counter] | None]) -> dict[str, tuple[int, int]]:
    """Sums by key over the pages; the keys are tags of ``KNOWN`` in three forms at most, so the table is small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list[int]] = {}
        for rows in batches:
            for page in rows["html"]:
                for side, by in enumerate(count(page) or ()):
                    for k, n in by.items():
                        total.setdefault(k, [0, 0])[side] += n
        yield pd.DataFrame([(k, *v) for k, v in total.items()], columns=["key", "inside", "outside"])

    rows = pages.mapInPandas(run, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside"), F.sum("outside"))
    return {k: (i, o) for k, i, o in rows.collect()}


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights by key from about ``sample`` marked pages, all if there are fewer."""
    marked = pages.where("html rlike '(?i)<(article|main)[\\\\s>]|role=.?main'").select("html")
    share = min(1.0, sample / max(1, marked.count()))
    some = marked.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < F.lit(round(share * (1 << 30))))
    weight = weights(_counted(some, counts_of))
    return weight | mark_weights(_counted(some, lambda page: agreement_of(page, weight)))


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of content by key, smoothed and bounded; tags are kept below zero."""
    found = {}
    for key, (inside, outside) in counts.items():
        odds = math.log((inside + 1) / (outside + 1))
        found[key] = max(-3.0, min(3.0, odds)) if key.startswith("w:") else min(-0.5, max(-3.0, odds))
    return found


def mark_weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of content with and without a mark, within ``MARK``."""
    odds = {k: math.log((inside + 1) / (outside + 1)) for k, (inside, outside) in counts.items()}
    return {k: max(0.0, min(MARK, v)) if k == "m+" else min(0.0, max(-MARK, v)) for k, v in odds.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest sum, the first of the longest; empty if none is positive."""
    best, top, total, start = (0, 0), 0.0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > top or total == top and top > 0 and i + 1 - start > best[1] - best[0]:
            best, top = (start, i + 1), total
    return best


#: Weights of keys that the labelled pages do not show: words of links and of other elements, and tags.
OTHER_LINK, OTHER_WORD, OTHER_TAG = -0.5, 1.0, -0.5
#: What an element without content parts a run by, per token; in marked content not at all.
ASIDE = -0.1
#: The most that a mark tells, the share of a tag's weight inside, and the least share of the best run's score where nothing is marked.
MARK, IN_MARK, PART = 3.5, 0.05, 0.1


def score(token: Token, weight: dict[str, float], marks: bool) -> float:
    """The token's weight; with ``marks`` also what its mark tells."""
    if token.aside:
        return 0.0 if marks and token.marked else ASIDE
    if token.word is None:
        return weight.get(token.key, OTHER_TAG) * (IN_MARK if marks and token.marked else 1.0)
    found = weight.get(token.key, OTHER_LINK if token.key == "w:a" else OTHER_WORD)
    if not marks:
        return found
    return found + (weight.get("m+", MARK) if token.marked else weight.get("m-", -MARK))


def best_runs(scores: list[float], part: float = 0.0) -> list[tuple[int, int]]:
    """The best run, the best of what is left and so on, of at least a part of the best one's score, in order.

    All of them are found in one scan: a new score joins the nearest run before it that began lower, as long as the sum
    over both is greater than that run's, and the search skips what lies between by the links of earlier searches.
    """
    runs: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest run that began lower
    total = 0.0
    for i, s in enumerate(scores):
        if s > 0:
            start, low, high, j = i, total, total + s, len(runs) - 1
            while True:
                while j >= 0 and runs[j][2] >= low:
                    j = runs[j][4]
                if j < 0 or runs[j][3] >= high:
                    break
                start, _, low, _, before = runs[j]
                del runs[j:]
                j = before
            runs.append((start, i + 1, low, high, j))
        total += s
    least = part * max((high - low for _, _, low, high, _ in runs), default=0.0)
    return [(start, end) for start, end, low, high, _ in runs if high - low >= least]


def extract(page: str | None, weight: dict[str, float]) -> str:
    if not page:
        return ""
    found, marks = tokens(page)
    scores = [score(t, weight, marks) for t in found]
    out: list[str] = []
    for start, end in best_runs(scores, 0.0 if marks else PART):
        for i in range(start, end):
            t = found[i]
            # Words between marked regions come with a run that spans them only if they speak for themselves.
            if t.word is not None and not t.aside and (t.marked or not marks or scores[i] > 0):
                if t.glued and i > start and out:
                    out[-1] += t.word
                else:
                    out.append(t.word)
    return " ".join(out)


def extract_pages(pages: DataFrame, weight: dict[str, float]) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            text = [extract(h, weight) for h in rows["html"]]
            yield pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, fit(pages))
