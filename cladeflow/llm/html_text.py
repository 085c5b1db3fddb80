"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score above 0 and tags below, by
weights learned from labelled pages: those whose own markup names the article.
A word weighs less where it stands in elements whose classes and ids hold words
outside of labelled articles. One linear scan finds the contiguous stretch with
the greatest sum. Where it lies in an article element, that element's own edges
end it. What HTML or its authors' usual names mark as menus, notices, forms,
comments and the like counts as outside when labels are read, and neither its
words nor its tags take part in the scan or the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage, unstage

#: Pages that the weights are learned from, at most; drawn by a hash of the id.
TRAINING_PAGES = 4096
#: Tag names with a weight of their own, at most.
TAG_NAMES = 256
WORD, OTHER_TAG = "word", "other"
#: Weights where no labelled page tells: a word and any tag.
PLAIN = {WORD: 1.0, OTHER_TAG: -0.5}
#: Names of classes and ids with a share of their own, at most, and the pages that must have one.
CONTEXT_NAMES, LEAST_PAGES = 4096, 5

# Elements and attribute words that HTML authors use for what is
# not the article, and elements that end a block of text.
CONTAINERS = frozenset({"article", "main"})
DROPPED = frozenset(
    "nav menu footer aside form button select textarea input option datalist label fieldset dialog "
    "head title script style noscript template svg canvas iframe object embed audio video map math".split()
)
RAW = "script|style|noscript|template|textarea|title|iframe|svg|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar "
    "menu menus nav navbar navigation breadcrumb breadcrumbs comment comments respond reply replies disqus "
    "discussion share sharing social related recommended footer masthead toolbar widget widgets pagination "
    "pager login search skip disclaimer".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond".split())
HEADER_WORDS = frozenset("header topbar".split())
ABOUT_LAYOUT = frozenset("has no with without".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody tfoot thead tr ul".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|<[a-z!?/][^<>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_WORD = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _kind(name: str, attrs: str, in_main: bool) -> str:
    """'drop', 'main' or '' for an opening tag."""
    if name in DROPPED or name == "header" and not in_main:
        return "drop"
    if not attrs:
        return "main" if name in CONTAINERS else ""
    kind = "main" if name in CONTAINERS else ""
    unwanted = COMMENT_WORDS if kind else DROPPED_WORDS if in_main else DROPPED_WORDS | HEADER_WORDS
    for key, value in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            words = {w.lower() for part in _CAMEL.split(value) for w in _NAME_WORD.findall(part)}
            if words & unwanted and not words & ABOUT_LAYOUT and name not in ("body", "html"):
                return "drop"
        elif key == "role" and value.lower() in DROPPED_ROLES:
            return "drop"
        elif key == "role" and value.lower() == "main" or key == "itemprop" and value.lower() == "articlebody":
            kind = "main"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return "drop"
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "drop"
    return kind


def _names(attrs: str) -> frozenset:
    """Classes and ids that an opening tag has."""
    if not attrs:
        return frozenset()
    return frozenset(
        v for key, value in _ATTR.findall(attrs) if key.lower() in ("class", "id") for v in value.strip("\"'").lower().split()
    )


def read_page(page: str) -> tuple[list, list]:
    """Tokens and containers of a page.

    Tokens: ('tag', name, dropped) or ('text', text, block number, dropped,
    classes and ids around it). Containers: (first token, last token + 1) of
    each outermost article or main element.
    """
    tokens, containers = [], []
    around: list[tuple[str, frozenset]] = []  # open elements, with the names of all around
    open_: Counter = Counter()
    block = at = 0
    dropped, depth = "", 0  # the element that is being dropped, and how deep in its own kind
    main, main_depth, main_at = "", 0, 0

    def text(piece: str):
        names = around[-1][1] if around else frozenset()
        if piece and not piece.isspace():
            tokens.append(("text", html.unescape(piece) if "&" in piece else piece, block, bool(dropped), names))
        elif piece:
            tokens.append(("text", " ", block, bool(dropped), names))

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            tokens.append(("tag", m["raw"].lower(), True))
            continue
        if not m["name"]:
            continue
        name, end = m["name"].lower(), bool(m["end"])
        if name == "br":
            tokens.append(("text", " ", block, bool(dropped), frozenset()))
        if name in BLOCKS:
            block += 1
        if name in VOID:
            tokens.append(("tag", name, bool(dropped)))
            continue
        if not end:
            own = _names(m["attrs"])
            before = around[-1][1] if around else frozenset()
            around.append((name, before | own if own else before))
            open_[name] += 1
        elif open_[name]:
            while True:
                closed = around.pop()[0]
                open_[closed] -= 1
                if closed == name:
                    break
        inside = bool(dropped)
        if dropped:
            if name == dropped:
                depth += -1 if end else 1
            unclosed = (
                name == main and end and main_depth == 1
                or name in CONTAINERS and not end and not main
                or name in ("body", "html") and (end or dropped == "head")
            )
            if depth == 0 or unclosed:
                dropped = ""
        kind = "" if end or dropped else _kind(name, m["attrs"], bool(main))
        if kind == "drop":
            dropped, depth = name, 1
        if main:
            if name == main:
                main_depth += -1 if end else 1
            if main_depth == 0:
                containers.append((main_at, len(tokens)))
                main = ""
        elif kind == "main":
            main, main_depth, main_at = name, 1, len(tokens) + 1
        tokens.append(("tag", name, inside or bool(dropped)))
        if end and name in ("td", "th"):
            tokens.append(("text", " ", block, bool(dropped), frozenset()))
    text(page[at:])
    if main:
        containers.append((main_at, len(tokens)))
    return tokens, containers


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous stretch with the greatest sum above 0."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def scored(tokens: list, weights: dict[str, float]) -> list[float]:
    """The score of each token: words times their weight and the least share of the names around, tags below 0."""
    word, other = weights[WORD], weights[OTHER_TAG]
    shares: dict[frozenset, float] = {}
    out = []
    for t in tokens:
        if t[0] == "tag":
            out.append(0.0 if t[2] else weights.get(t[1], other))
        elif t[3]:
            out.append(0.0)
        else:
            names = t[4]
            if names not in shares:
                shares[names] = min((weights.get("." + n, 1.0) for n in names), default=1.0)
            out.append(len(t[1].split()) * word * shares[names])
    return out


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of the article, joined by two line feeds; '' where there are none."""
    tokens, containers = read_page(page)
    begin, end = best_stretch(scored(tokens, weights))

    def inside(i, j):
        return sum(len(t[1].split()) for t in tokens[i:j] if t[0] == "text" and not t[3])

    total = inside(begin, end)
    for i, j in containers:
        if 2 * inside(max(i, begin), min(j, end)) > total:
            begin, end = i, j
            break
    blocks: dict[int, list[str]] = {}
    for t in tokens[begin:end]:
        if t[0] == "text" and not t[3]:
            blocks.setdefault(t[2], []).append(t[1])
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


def _count_tokens(batches):
    inside, outside, seen = Counter(), Counter(), Counter()
    for b in batches:
        for page in b.column(0).to_pylist():
            tokens, containers = read_page(page)
            if len(containers) != 1:
                continue
            i, j = containers[0]
            own = Counter()
            for k, t in enumerate(tokens):
                labelled = i <= k < j
                if t[0] == "tag":
                    if not t[2]:
                        (inside if labelled else outside)[t[1]] += 1
                elif n := len(t[1].split()):
                    to = inside if labelled and not t[3] else outside
                    to[WORD + ":"] += n
                    for name in t[4]:
                        to["." + name] += n
                        own["." + name] = 1
            seen.update(own)
    names = sorted(inside.keys() | outside.keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in (inside, outside, seen))],
        names=["token", "inside", "outside", "pages"],
    )


def learn_weights(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> dict[str, float]:
    """Log odds of each kind of token inside an article, held above 0 for words and below for tags.

    Keys "." + name: the share of words within elements of the class or id that is inside.
    """
    sample = (
        pages.filter("html is not null").orderBy(F.xxhash64("page_id"), "page_id").select("page_id").limit(training_pages)
    )
    counts = stage(
        pages.join(F.broadcast(sample.distinct()), "page_id", "left_semi")
        .select("html")
        .mapInArrow(_count_tokens, "token string, inside long, outside long, pages long")
        .groupBy("token")
        .agg(*(F.sum(c).alias(c) for c in ("inside", "outside", "pages")))
    )
    is_name, often = F.col("token").startswith("."), [(F.col("inside") + F.col("outside")).desc(), "token"]
    tags = counts.filter(~is_name).orderBy(*often).limit(TAG_NAMES).collect()
    names = counts.filter(is_name & (F.col("pages") >= LEAST_PAGES)).orderBy(*often).limit(CONTEXT_NAMES).collect()
    unstage(counts)
    odds = {r["token"]: math.log((r["inside"] + 1) / (r["outside"] + 1)) for r in tags}
    if WORD + ":" not in odds:
        return dict(PLAIN)
    weights = {name: min(-0.1, max(-2.0, v)) for name, v in odds.items() if name != WORD + ":"}
    shares = {r["token"]: (r["inside"] + 1) / (r["inside"] + r["outside"] + 1) for r in names}
    return PLAIN | weights | shares | {WORD: min(2.0, max(0.5, odds[WORD + ":"]))}


def html_text(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of each row.

    Null and empty pages give empty text. Rows that repeat an id each give a row.
    A page cut short is read as far as it goes. Other columns don't matter.
    """
    prepare(pages.sparkSession)
    weights = learn_weights(pages, training_pages)

    def run(batches):
        for b in batches:
            out = [main_text(page, weights) for page in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("page_id"),
                    b.column("url"),
                    pa.array(out, pa.string()),
                    pa.array(np.fromiter(map(len, out), np.int64, len(out))),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
