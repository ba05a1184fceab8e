"""HTML extraction: the maximum-scoring run of a page's words and tags is its main text.

A word scores above zero and a tag below, by log-odds counted over labelled pages (those that mark their text with an article
element). A word in an element whose class, id or role labelled pages have outside their articles alone scores below zero, by that
class's log-odds; so does one whose class plainly names adverts, comments or a part of the page around the text. One linear scan
finds the run with the greatest sum. Its words above zero are the text. Elements that the HTML standard itself has for something
else (menus, forms, scripts and so on) and hidden ones count as no words.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperproof.llm.common import parts

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
OUT = frozenset("head nav aside footer form script style noscript iframe template textarea title button select input svg canvas object audio video dialog menu map label datalist".split())
KNOWN = VOID | RAW | BLOCK | OUT | frozenset("a abbr b cite code em i mark q s small span strong sub sup td th time u".split())
# Classes, ids and roles that name adverts and reader comments, and parts of a page around its text. Whole names, not
# words in them; they and what is learnt only score.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments comment-list comments-area disqus disqus_thread".split())
AROUND = frozenset("sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer cookie-notice cookie-banner cookies consent gdpr popup modal widget banner newsletter pagination pager toolbar contentinfo complementary".split())
# An attribute's quotes follow its =; a tag that isn't closed ends before the next one. No part of a page is tried twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|(?=<)|\Z)|<(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\Z)|[^<]++|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.IGNORECASE)


def classes(attributes: str) -> set[str]:
    """The words of class, id and role, lower-cased."""
    return {x for _, v in _ATTRIBUTE.findall(attributes) for x in v.strip("\"'").lower().split()}


def _outside(name: str, attributes: str, in_text: bool, learned: dict[str, float]) -> tuple[float, bool]:
    """(score of a word in an element, whether that holds even if the article begins in it); 1 is that of plain text, 0 of none.

    A page's header isn't text; an article's own is."""
    if name in OUT and name != "form":
        return 0.0, True
    if attributes and name not in ("html", "body", "main", "article"):
        if _HIDDEN.search(attributes):
            return 0.0, True
        found = classes(attributes)
        if found & ADVERTS:
            return -1.0, True
        if known := [learned[c] for c in found if c in learned]:
            return min(known), False
        if not in_text and found & AROUND:
            return -1.0, False
    return (0.0, False) if name == "form" or name == "header" and not in_text else (1.0, False)


def tokens(page: str | None, learned: dict[str, float] | None = None) -> Iterator[tuple[str, str, float, bool]]:
    """(kind, value, score, labelled) of a page's pieces in order. kind is 'word' for text, otherwise a tag's name with / if
    it closes; value is a word's text or a tag's attributes; score: the least that an element around it gives a word, 1 for plain
    text; labelled: it stands in an article element. Unclosed elements end with their parents, an end tag without a beginning ends
    nothing. Time is linear."""
    page, learned = page or "", learned or {}
    stack: list[list] = []  # name, an element's own score, the least of it and those around it
    soft: list[int] = []  # places of those that are plain text after all if an article begins in them
    open_names: Counter = Counter()
    articles = at = 0

    def pop(to: int) -> None:
        nonlocal articles
        while len(stack) > to:
            name = stack.pop()[0]
            if soft and soft[-1] == len(stack):
                soft.pop()
            open_names[name] -= 1
            articles -= name in ("article", "main")

    score = lambda: stack[-1][2] if stack else 1.0

    while m := _TOKEN.match(page, at):
        at = m.end()
        piece, close, name = m[0], m[1], m[2]
        if name is None:
            if not piece.startswith(("<!", "<?", "</")):
                yield "word", piece, score(), articles > 0
            continue
        name = name.lower()
        if close:
            if open_names[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop(k)
            yield "/" + name, "", score(), articles > 0
            continue
        if name == "body":
            pop(1 if stack and stack[0][0] == "html" else 0)
        elif name in BLOCK and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        elif name == "li" and stack and stack[-1][0] == "li":
            pop(len(stack) - 1)
        if name not in VOID and not m[3].rstrip().endswith("/"):
            own, firm = _outside(name, m[3], articles > 0, learned)
            if name in ("article", "main") and not articles and soft:
                for k in soft:
                    stack[k][1] = 1.0
                for k in range(soft[0], len(stack)):
                    stack[k][2] = min(stack[k][1], stack[k - 1][2] if k else 1.0)
                soft.clear()
            if own < 1 and not firm:
                soft.append(len(stack))
            stack.append([name, own, min(own, score())])
            open_names[name] += 1
            articles += name in ("article", "main")
        yield name, m[3], score(), articles > 0
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)


@dataclass
class Weights:
    """Scores: word for each word, tag for a tag by its name, other for names not seen. outside: of classes that aren't text, in words."""

    word: float = 1.0
    other: float = -1.0
    tag: dict[str, float] = field(default_factory=dict)
    outside: dict[str, float] = field(default_factory=dict)


#: Article and main elements' own tags part text from the rest, so they cost this many words.
EDGE = 8.0


def region(pieces: list[tuple[str, str, float, bool]], w: Weights) -> tuple[int, int]:
    """The first (start, stop) of pieces with the greatest sum of scores; (0, 0) if none is above zero."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, value, score, _) in enumerate(pieces):
        if total <= 0:
            total, start = 0.0, i
        if kind == "word":
            total += score * w.word * len(value.split())
        elif kind.strip("/") in ("article", "main"):
            total -= EDGE * w.word
        else:
            total += w.tag.get(kind.strip("/"), w.other)
        if total > best:
            best, found = total, (start, i + 1)
    return found


def blocks(pieces: list[tuple[str, str, float, bool]], everything: bool = False) -> list[str]:
    """The text of each block: character references decoded, white space as one space, none at the ends; no empty ones."""
    out, held = [], []
    for kind, value, score, _ in pieces:
        name = kind.strip("/")
        if kind == "word":
            if everything or score > 0:
                held.append(html.unescape(value))
        elif name in BLOCK:
            out.append(" ".join("".join(held).split()))
            held.clear()
        elif name in ("br", "td", "th", "img", "input", "button", "select"):
            held.append(" ")
    out.append(" ".join("".join(held).split()))
    return [x for x in out if x]


def main_text(page: str | None, w: Weights) -> str:
    """The main text, blocks joined by newlines; '' if there is none. A region is widened to whole blocks,
    and to the whole of an article element in which it begins or ends."""
    pieces = list(tokens(page, w.outside))
    p, q = region(pieces, w)
    if p == q:
        return ""
    while p and pieces[p][3] and pieces[p - 1][3]:
        p -= 1
    while q < len(pieces) and pieces[q - 1][3] and pieces[q][3]:
        q += 1
    whole = lambda x: x[0] != "word" and x[0].strip("/") in BLOCK
    while p and not whole(pieces[p - 1]):
        p -= 1
    while q < len(pieces) and not whole(pieces[q]):
        q += 1
    return "\n".join(blocks(pieces[p:q]))


def plain_text(page: str | None) -> str:
    """All text of a page but scripts, styles and the head, by blocks."""
    body = [x for x in tokens(page)]
    start = next((i for i, x in enumerate(body) if x[0] in ("body", "/head")), 0)
    return "\n".join(blocks(body[start:], everything=True))


def learn(pages: DataFrame, *, most: int = 2000, seen: int = 20) -> Weights:
    """Weights from labelled pages: at most ``most`` of those with an article element, chosen by hash of their id.

    A kind's weight is the log-odds of standing in the article against standing elsewhere; words keep above zero and tags
    below it. A class, id or role that stands outside articles on at least ``seen`` pages and inside on none scores below zero.
    Without labelled pages, a word scores 1 and a tag -1.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in parts(batches, "html"):
            for page in b["html"].to_pylist():
                named = set()
                for kind, value, _, labelled in tokens(page):
                    name = kind.strip("/")
                    if kind != "word" and value:
                        named |= {("." + c, labelled) for c in classes(value)}
                    if name not in ("article", "main"):
                        n[name if name in KNOWN or kind == "word" else "other", labelled] += len(value.split()) if kind == "word" else 1
                n.update(named)
        yield pa.record_batch([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], names=["kind", "labelled", "n"])

    some = pages.where(F.contains(F.lower("html"), F.lit("<article"))).select("page_id", F.xxhash64("page_id", F.lit(9)).alias("h")).orderBy("h").limit(most)
    labelled = pages.select("page_id", "html").join(some.select("page_id").distinct(), "page_id", "left_semi")
    n = {(r.kind, r.labelled): r.n for r in labelled.select("html").mapInArrow(count, "kind string, labelled boolean, n long").groupBy("kind", "labelled").agg(F.sum("n").alias("n")).collect()}
    named = {k: n.pop(k) for k in [k for k in n if k[0].startswith(".")]}
    inside, outside = (sum(v for k, v in n.items() if k[1] == side) for side in (True, False))
    if not inside or not outside:
        return Weights()
    odds = lambda k: log((n.get((k, True), 0) + 0.5) / (inside + 1)) - log((n.get((k, False), 0) + 0.5) / (outside + 1))
    word = max(0.1, odds("word"))
    tag = {k: min(-0.01 * word, odds(k)) for k in {k for k, _ in n} - {"word", "other"}}
    never = {c[1:]: -max(1.0, log(2 * v + 1) / word) for (c, labelled), v in named.items() if not labelled and v >= seen and (c, True) not in named}
    return Weights(word, min(-word, odds("other") if ("other", False) in n else -word), tag, never)


def extract(pages: DataFrame, *, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html, ...). A null html is an empty page, with text ''.
    Repeated rows are extracted each, further columns aren't read, an empty table gives no rows. n_chars counts code points."""
    weights = weights or learn(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "html"):
            text = [main_text(x, weights) for x in b["html"].to_pylist()]
            yield pa.record_batch([b["page_id"], b["url"], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
