"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of tags and word runs.  Words score positive and tags
negative; words in links and beside the article score negative too.  One
linear scan finds the contiguous run of tokens with the highest score; its
blocks are the text.

The weights are log odds counted on the labelled pages of ``html_pages``, on
which a logistic regression also learns what an element's tag and the words of
its class, id and role say of its content.  Where they are clearly against it,
the element counts as its tags alone, as one run cannot leave out a menu in the
middle of an article.  Words behind one that names a state (``no-sidebar``,
``has-comments``) say nothing.

The tokenizer is a single pass over the page, linear whatever its nesting and
its attributes hold.  It accepts broken markup: tags cut off at the end of a
page, unclosed elements, stray end tags, unquoted and unterminated attributes.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html import unescape
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .html_pages import PAGES

#: Elements without content, elements whose content is not text, and elements that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(["article", "main"])
#: Elements whose name says what part of a page they are.
PART = frozenset("article main section nav header footer aside form button select label menu dialog datalist fieldset search".split())
_CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_SCOPE = frozenset("table ul ol dl article main section div aside nav form body".split())
_STEP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_VALUE = re.compile(r"[^>=]*+(?:>|=\s*+([\"']?)|\Z)")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Parts of a class word after which the rest names a state or a topic of the element, and not the element.
_STATE = frozenset("no not has have with without is hide show open closed js category tag type format status".split())

Token = tuple[str, str, int]  # feature, text, block number; tags have no text


def _attributes(page: str, at: int, never: set[str]) -> tuple[str, int] | None:
    """(attributes of the tag whose name ends at ``at``, where the tag ends); None if the page ends in it.

    A quote opens a value only behind an equals sign.  One that never closes
    (``never`` remembers which) opens nothing: the tag ends at its first ``>``.
    """
    here = at
    while True:
        m = _VALUE.match(page, here)
        here = m.end()
        if page[here - 1 : here] == ">" and m[1] is None:
            return page[at : here - 1], here
        if m[1] is None:
            return None
        if m[1]:
            stop = -1 if m[1] in never else page.find(m[1], here)
            if stop < 0:
                never.add(m[1])
                stop = page.find(">", at)
                return (page[at:stop], stop + 1) if stop >= 0 else None
            here = stop + 1


def _cues(tag: str, attributes: str) -> tuple[list[str], bool]:
    """(the tag if it names a part of a page, and the words of class, id and role; whether the element is hidden)."""
    cues = [tag] if tag in PART else []
    if "=" not in attributes and "hidden" not in attributes.lower():
        return cues, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return cues, True
        if name in ("class", "id", "role"):
            for word in value.split():
                for part in _WORD.findall(word):
                    if part.lower() in _STATE:
                        break
                    cues.append("." + part.lower())
    return cues, False


#: An element counts as its tags alone if its cues add less than this to the log odds of its words.
AGAINST = -1.2


def _in_main(cues: list[str]) -> list[str]:
    return [c + "@" for c in cues]


@cache
def cue_weights() -> dict[str, float]:
    """What cues of open elements add to the log odds of a word being content: a ridge logistic regression on the labelled pages.

    A cue inside an article or main element is one of its own (``@``).
    """
    runs: list[tuple[frozenset[str], int, int]] = []  # cues of the open elements, region, words
    for page in PAGES:
        stack: list[tuple[str, list[str]]] = []
        for region, part in page:
            part = re.sub(r"<(style|script|title)>.*?</\1>", "", part)
            for end, tag, attributes, text in re.findall(r"<(/?)([a-z0-9]+)([^>]*)>|([^<]+)", part):
                if text:
                    runs.append((frozenset(c for _, cues in stack for c in cues), region, len(text.split())))
                elif end:
                    stack.pop()
                elif tag not in VOID:
                    found, _ = _cues(tag, attributes)
                    stack.append((tag, _in_main(found) if any(t in MAIN for t, _ in stack) else found))
    names = sorted({c for cues, _, _ in runs for c in cues})
    x = np.array([[c in cues for c in names] + [True] for cues, _, _ in runs], dtype=float)
    y, n = np.array([r for _, r, _ in runs], dtype=float), np.array([k for _, _, k in runs], dtype=float)
    w, ridge = np.zeros(x.shape[1]), np.diag([0.5] * len(names) + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (n * (y - p)) - ridge @ w)
    return dict(zip(names, w.tolist(), strict=False))


@cache
def _added(cue: str, main: bool) -> float:
    found = cue_weights()
    return found.get(cue + "@", found.get(cue, 0.0)) if main else found.get(cue, 0.0)


def boilerplate(tag: str, attributes: str, main: bool) -> bool:
    """Whether an element (in an article or main element or not) counts as its tags alone."""
    cues, hidden = _cues(tag, attributes)
    return hidden or sum(_added(c, main) for c in dict.fromkeys(cues)) < AGAINST


def tokens(page: str) -> list[Token]:
    """Tags and text runs of a page in order; of a boilerplate element only its own tags.

    A text run's feature is its context: ``word`` (plain), ``main`` (in an
    article or main element), ``link``, or ``beside`` (plain, on a page that
    has an article or main element).  A tag's is its name, with ``@`` in an
    article or main element.
    """
    out: list[Token] = []
    stack: list[tuple[str, int]] = []  # open elements: name, and 1 boilerplate + 2 main + 4 link from the root to it
    places: dict[str, list[int]] = {}  # of the open elements, by name
    scopes: list[int] = []
    never: set[str] = set()
    block, at, n, has_main, state = 0, 0, len(page), False, 0
    lowered: str | None = None

    def close(place: int) -> int:
        while len(stack) > place:
            name, _ = stack.pop()
            places[name].pop()
            if name in _SCOPE:
                scopes.pop()
        return stack[-1][1] if stack else 0

    while at < n:
        m = _STEP.match(page, at)
        at = m.end()
        if m["text"] is not None:
            if not state & 1:
                out.append(("link" if state & 4 else "main" if state & 2 else "word", m["text"], block))
            continue
        if m["tag"] is None:
            continue  # comment, doctype, processing instruction
        tag, found = m["tag"].lower(), _attributes(page, at, never)
        if found is None:
            break  # the page ends inside a tag
        attributes, at = found
        if tag in BLOCK:
            block += 1
        elif tag == "br" and not state & 1:
            out.append(("br", " ", block))
        if m["end"]:
            if places.get(tag):
                state = close(places[tag][-1])
            if not state & 1:
                out.append(("/" + tag + "@" * (state >> 1 & 1), "", block))
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                lowered = page.lower() if lowered is None else lowered
                stop = lowered.find("</" + tag, at)
                while stop >= 0 and lowered[stop + 2 + len(tag) : stop + 3 + len(tag)] not in ("", ">", "/", " ", "\t", "\n", "\r", "\f"):
                    stop = lowered.find("</" + tag, stop + 2)
                if stop < 0:
                    break
                at = stop
            continue
        for opened, closers in _CLOSED_BY.items():
            if tag in closers and places.get(opened) and places[opened][-1] > (scopes[-1] if scopes else -1):
                state = close(places[opened][-1])
        if not state & 1 or tag in MAIN:
            out.append((tag + "@" * (state >> 1 & 1), "", block))
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK and tag != "a":
            continue
        against = tag not in ("body", "html") and boilerplate(tag, attributes, bool(state & 2))
        if tag in MAIN and not against:
            has_main = True
            # An article ends boilerplate that was left open before it, but one in comments stays there.
            state = state | 2 if state & 2 else 2
        else:
            state |= against | (4 if tag == "a" else 0)
        places.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append((tag, state))
    if has_main:
        out = [("beside", t, b) if f == "word" else (f, t, b) for f, t, b in out]
    return out


@cache
def weights() -> dict[str, float]:
    """Log odds of every context and tag between content and the rest, counted on the labelled pages.

    Words are bound to their context; tags are never positive.
    """
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in PAGES:
        marked = tokens("".join(part if not region else f"\x01{part}\x02" for region, part in page))
        now = 0
        for feature, text, _ in marked:
            if "\x01" in text:
                now = 1
            if text:
                (inside if now and not text.startswith("\x02") else outside)[feature] += len(text.replace("\x01", "").replace("\x02", " ").split())
            else:
                (inside if now else outside)[feature] += 1
            if "\x02" in text:
                now = 0
    odds = {f: log((inside[f] + 0.5) / (outside[f] + 0.5)) for f in {*inside, *outside}}
    words = {"word", "main", "beside", "link", "br"}
    return {f: w if f in words else min(-0.01, w) for f, w in odds.items()} | {"br": -0.01}


UNSEEN = -0.1  # a tag that no labelled page has


def best_run(scores: list[float]) -> tuple[int, int]:
    """First shortest half-open span with the highest positive sum; (0, 0) if there is none."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, span = total, (start, k + 1)
    return span


def extract(page: str | None) -> str:
    """Main text: blocks of the best run in page order, joined by an empty line."""
    if not page:
        return ""
    found, weight = tokens(page), weights()
    scores = [weight.get(f, UNSEEN) * (len(t.split()) if t else 1) for f, t, _ in found]
    a, b = best_run(scores)
    blocks: list[list[str]] = []
    last = -1
    for _, text, block in found[a:b]:
        if not text:
            continue
        if block != last or not blocks:
            blocks.append([])
            last = block
        blocks[-1].append(unescape(text))  # no character reference goes on behind a tag
    # White space includes no-break spaces.
    lines = (" ".join("".join(parts).split()) for parts in blocks)
    return "\n\n".join(line for line in lines if line)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (main text of the whole page) and ``n_chars`` (its code points).

    A null or empty page, or one without content, gives an empty text; of two
    runs with the same score the first counts.  Clashing columns are replaced;
    rows, nulls in other columns and extra columns pass through; an empty table
    gives an empty result.
    """

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: extract(x if isinstance(x, str) else None)).astype(object)

    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    made = pages.withColumn("_text", run(F.col(html)))
    return made.select(*rest, F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
