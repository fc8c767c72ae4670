"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words of running text score positive, tags and words of lists, menus and frames
negative, with weights learnt from labelled pages; one linear scan finds the contiguous region of largest sum. The blocks
of that region, without what is marked as menu, notice, advert, form or comment inside it, are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bounded_sample, short_batches, small

#: Pages to learn weights from, and their characters, at most (expected); different pages chosen by hash over the whole table.
TRAINING_PAGES, TRAINING_CHARS = 1500, 60_000_000
OUT = "page_id long, url string, text string, n_chars long"
#: A whole tag: a quoted value may hold any character. No part of it can be given back, so a search takes time in proportion to what it reads.
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>""")
_CUT_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)[^>]*+>")
_RAW_END = {n: re.compile(rf"</{n}\b[^>]*+>?", re.I) for n in ("script", "style")}
_MARKS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Parts of names in class, id or role that mark a part beside the article, those of reader comments apart.
_BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navigation navbar menu breadcrumb breadcrumbs masthead footer sidebar aside widget widgets related recommended recommendations"
    " share sharing social cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login search pagination pager toc skip contentinfo complementary dialog".split()
)
_COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
_SITE_HEADERS = frozenset("header site-header page-header top-header main-header global-header".split())
_NEGATED = frozenset("has with no without not is".split())
_BESIDE_TAGS = frozenset("nav aside footer form button head menu dialog noscript template svg iframe textarea select".split())
#: Elements that a block cannot stand in: it ends them.
_NO_BLOCKS = frozenset("svg select".split())
_BLOCKS = frozenset("p div article section main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr body html head title center menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCKS - frozenset(["html", "head", "body", "title"])
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_WORD = re.compile(r"\S+")


def _mark(tag: str) -> str | None:
    """'comments', 'beside' or None, by the names in class, id and role of a tag."""
    found = None
    for value in _MARKS.findall(tag):
        for name in value.strip("\"'").lower().split():
            parts = re.split(r"[-_]+", name)
            if parts[0] in _NEGATED:
                continue
            if parts[0] in _COMMENTS or parts[-1] in _COMMENTS:
                return "comments"
            if parts[0] in _BESIDE or parts[-1] in _BESIDE or name in _SITE_HEADERS:
                found = "beside"
    return found


class _Part:
    """An element that its tag or names mark as beside the article; article: whether an article or main element stands in it."""

    def __init__(self, kind: str, parent: _Part | None):
        self.kind, self.parent, self.article = kind, parent, False
        self.comments = kind == "comments" or (parent is not None and parent.comments)
        #: Set once the page is read: 2 if it is left out, 1 if only while anything else is text, 0 if it is not, and the kind of the outermost part left out.
        self.level, self.top = 0, kind

    def settle(self, lone: bool) -> None:
        """lone: no article stands outside such parts, so one that holds an article is the page's frame."""
        own = 2 if self.comments else 0 if lone and self.article else 1 if self.kind in ("form", "beside") else 2
        self.level = own if self.parent is None else max(own, self.parent.level)
        if self.parent is not None and self.parent.level:
            self.top = self.parent.top


def _pieces(page: str):
    """Yield (name, piece) of a page in turn: text with no name, a tag with its name, '/name' to close; comments and scripts are left out.

    A comment that never ends ends at its first '>'; so does a tag whose quoted values leave it without an end, and from there on every tag. A tag without '>' is
    the rest of the page, and so is a script without its end. Time is in proportion to the page.
    """
    at, last, tag, closed, open_ended = 0, page.rfind(">"), _TAG, True, set()
    while at < len(page):
        low = page.find("<", at)
        if low != at:
            yield "", page[at : low if low >= 0 else len(page)]
        if low < 0:
            return
        c, letter = page[low + 1 : low + 2], page[low + 1 : low + 3].removeprefix("/")[:1]
        if c in ("!", "?") or (c == "/" and not (letter.isascii() and letter.isalpha())):
            end = -1
            if closed and page.startswith("<!--", low):
                end = page.find("-->", low + 2)
                closed = end >= 0
                end += 3 if closed else 0
            if end < 0:
                end = page.find(">", low) + 1 if low < last else len(page)
            at = end
        elif letter.isascii() and letter.isalpha():
            if low > last:
                return
            m = tag.match(page, low)
            if m is None:
                tag = _CUT_TAG
                m = tag.match(page, low)
            at, name = m.end(), m[1].lower()
            if c != "/" and name in _RAW_END:
                if not m[0].endswith("/>"):
                    end = None if name in open_ended else _RAW_END[name].search(page, at)
                    if end is None:
                        open_ended.add(name)
                        return
                    at = end.end()
            else:
                yield ("/" + name if c == "/" else name), m[0]
        else:
            yield "", "<"
            at = low + 1


def tokens(page: str | None) -> list[tuple]:
    """(kind, key, value, beside, labelled, part) of every token.

    kind 'w' is a run of text with its context as key, 't' a tag with its name ('/name' to close). beside: 2 inside a part that is not the article, 1
    inside one that may be the page's text where nothing else is (a form, or a part marked by its names); part: the kind of that part. labelled: inside an article or main
    element. An element that closes itself is empty; an unclosed one ends with its parent.
    """
    out: list[tuple] = []
    # Open elements: name, innermost part, whether inside an article, nearest block's name, whether inside a link, place of the nearest block.
    stack: list[tuple[str, _Part | None, bool, str, str, int]] = [("", None, False, "none", "", 0)]
    open_names: Counter = Counter()
    parts: list[_Part] = []
    lone = True

    def shut(at: int) -> None:
        for entry in stack[at:]:
            open_names[entry[0]] -= 1
        del stack[at:]

    for name, piece in _pieces(page or ""):
        _, part, inside, block, link, _ = stack[-1]
        if not name:
            out.append(("w", (block, link), piece, part, inside))
            continue
        if name[0] == "/":
            out.append(("t", name, piece, part, inside))
            if open_names[name[1:]] > 0:
                shut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name[1:]))
            continue
        if name not in _VOID:
            # A new block ends an open paragraph, and a new item the open item; inline elements left open end with them.
            while name in _BLOCKS and any(open_names[n] > 0 for n in _NO_BLOCKS):
                shut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in _NO_BLOCKS))
            ends = ({"p"} if name in _ENDS_P else set()) | _IMPLIED.get(name, set())
            while ends and stack[-1][5] and stack[stack[-1][5]][0] in ends:
                shut(stack[-1][5])
            _, part, inside, block, link, place = stack[-1]
            kind = _mark(piece) if name not in ("html", "body") and "=" in piece else None
            if name in ("article", "main") and kind != "comments":
                if part is None or not part.comments:
                    inside, over = True, part
                    lone &= part is not None
                    while over is not None and not over.article:
                        over.article = True
                        over = over.parent
            elif name in _BESIDE_TAGS or (name == "header" and not inside) or kind:
                kind = "form" if name == "form" else "tag" if name in _BESIDE_TAGS or name == "header" else kind
                part = _Part(kind, part)
                parts.append(part)
            if name in _BLOCKS:
                place = len(stack)
                block = block if name in ("article", "main", "section") else name
            if not piece.endswith("/>"):
                stack.append((name, part, inside, block, "a" if name == "a" else link, place))
                open_names[name] += 1
        out.append(("t", name, piece, part, inside))
    for part in parts:
        part.settle(lone)
    return [(kind, key, value, part.level if part else 0, inside, part.top if part and part.level else None) for kind, key, value, part, inside in out]


class Weights:
    """Score of a word by its context, of a tag by its name and of a whole marked part by its kind; tags never score above TAG_MOST, parts never above PART_MOST."""

    TAG_MOST, PART_MOST = -0.05, -0.5
    WORD_ELSE, TAG_ELSE, PART_ELSE = 1.0, -0.3, -1.0

    def __init__(self, words: dict, tags: dict, parts: dict | None = None):
        self.words, self.tags, self.parts = words, tags, parts or {}

    def word(self, key: tuple) -> float:
        if key in self.words:
            return self.words[key]
        return -2.0 if key[1] or key[0] in ("head", "title") else self.WORD_ELSE

    def tag(self, name: str) -> float:
        return self.tags.get(name, self.TAG_ELSE)

    def part(self, kind: str) -> float:
        return self.parts.get(kind, self.PART_ELSE)


def learn(pages: list[str]) -> Weights:
    """Log odds of words, tags and marked parts within the labelled article against outside; pages without one article element are skipped."""
    inside, outside = Counter(), Counter()
    for page in pages:
        toks = tokens(page)
        if not any(t[4] for t in toks):
            continue
        before = None
        for kind, key, value, _, labelled, part in toks:
            if part is None:
                (inside if labelled else outside)[kind, key] += len(_WORD.findall(value)) if kind == "w" else 1
            elif part != before:
                (inside if labelled else outside)["p", part] += 1
            before = part
    words, tags, parts = {}, {}, {}
    for kind, key in {*inside, *outside}:
        odds = max(-4.0, min(4.0, math.log((inside[kind, key] + 0.5) / (outside[kind, key] + 0.5))))
        if inside[kind, key] + outside[kind, key] < 5:
            continue
        if kind == "w":
            words[key] = odds
        elif kind == "t":
            tags[key] = min(Weights.TAG_MOST, odds)
        else:
            parts[key] = min(Weights.PART_MOST, odds)
    return Weights(words, tags, parts)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of largest sum, the first of equals and the longest from its start; empty (0, 0) if none is positive."""
    best, at, here, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if here < 0:
            here, start = 0.0, i
        here += s
        if here > best or (here == best and at[0] == start and best > 0):
            best, at = here, (start, i + 1)
    return at


def _region(toks: list[tuple], weights: Weights) -> tuple[int, int]:
    scores, before = [], None
    for kind, key, value, beside, _, part in toks:
        if beside:
            # A marked part costs the same however long it is: it is left out of the text, and mustn't split an article around it.
            scores.append(0.0 if before == part else weights.part(part))
        else:
            scores.append(len(_WORD.findall(value)) * weights.word(key) if kind == "w" else weights.tag(key))
        before = part if beside else None
    return best_region(scores)


def extract(page: str | None, weights: Weights) -> str:
    """The main text of one page; empty for a null or empty page or one without running text."""
    toks = tokens(page)
    a, b = _region(toks, weights)
    if a == b and any(t[3] == 1 for t in toks):
        # Nothing else is running text: the forms and named parts are the page.
        toks = [(*t[:3], 2 * (t[3] == 2), *t[4:]) for t in toks]
        a, b = _region(toks, weights)
    if b > a:
        # Whole blocks: a region never starts or ends inside one.
        while a and not (toks[a - 1][0] == "t" and toks[a - 1][1].lstrip("/") in _BLOCKS):
            a -= 1
        while b < len(toks) and not (toks[b][0] == "t" and toks[b][1].lstrip("/") in _BLOCKS):
            b += 1
    blocks, text = [], []

    def end() -> None:
        said = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if said:
            blocks.append(said)

    for kind, key, value, beside, *_ in toks[a:b]:
        if kind == "t":
            if key.lstrip("/") in _BLOCKS:
                end()
            elif key == "br":
                text.append(" ")
        elif not beside:
            text.append(value)
    end()
    return "\n".join(blocks)


def train(pages: DataFrame, training_pages: int = TRAINING_PAGES, training_chars: int = TRAINING_CHARS) -> Weights:
    """Weights from the pages (page_id, html) that mark their article with an element of their own, a sample bounded by hash."""
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b")).select("html")
    return learn([r["html"] for r in bounded_sample(labelled, "html", None, training_pages, training_chars)])


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """OUT for every row of pages (page_id, url, html).

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one
    line end. A null or empty page, or one without running text, has empty text; repeated rows get equal texts; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in small(batches):
            text = [extract(h, shared.value) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return short_batches(pages).select("page_id", "url", "html").mapInArrow(run, OUT)
