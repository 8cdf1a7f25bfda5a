"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. A line weighs its text outside links, times the share of that text,
so that menus weigh little or nothing; inside an article or main element it weighs ten times as much. Elements whose tag,
role or name says that they are no article text weigh nothing. Sums over sliding windows of lines show where text
surges and where it dives to nothing, in article elements and outside; the text between these points is kept, with
headings and paragraphs beside it that are links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelane.llm.common import byte_slices, ship, texts_of

#: Lines in a window, and the weight in one at which text surges.
WINDOW, SURGE = 3, 60
#: How much more a line inside an article or main element weighs, and the characters that a doubtful name there has to be made up for with.
GAIN, DOUBT = 10, 100

_ATTRS = r"""(?:[\s/]+|=|[^\s/>=]++(?:\s*=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*|(?=>|\Z)))?)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)({_ATTRS})(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s/>=]+)\s*(?:=\s*("[^"]*"?|'[^']*'?|[^\s>"'][^\s>]*))?""")
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
_BLANK = re.compile(r"\s+")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "label", "math", "mi", "mo", "mn", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mtext", "mover", "munder", "mstyle", "mspace", "semantics"}
_OUT_TAGS = {"nav", "aside", "form", "menu", "dialog", "button", "select", "head", "footer"}
_OUT_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus",
    "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notification", "overlay", "paywall", "popup", "promo", "promoted", "promotion",
    "replies", "respond", "sidebar", "signup", "skip", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "hidden",
}
#: Elements that hold running text, and names that on them, inside an article, only weigh against it: a paragraph may be about any of these.
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "dd", "dt"}
_WORDS_TOO = {"banner", "overlay", "promotion", "replies", "skip", "subscription", "notification", "menu", "login", "masthead"}
#: Names that may well stand on article text: inside an article they only weigh against it.
_DOUBTFUL_NAMES = {"notice", "recommended", "related", "reply", "share", "sharing", "social", "tags", "widget", "widgets"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Start tags that end an open element of the kind to the right.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _standing(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """(out, doubtful) of an element: no article text by its tag, role or names, or by names that inside an article prove little."""
    if tag in _OUT_TAGS or tag == "header" and not in_article:
        return True, False
    if not attrs or attrs.isspace():
        return False, False
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "") in _OUT_ROLES or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, False
    if tag in ("body", "html", "article", "main"):
        return False, False
    names = set(_NAME_PARTS.split(found.get("class", "") + " " + found.get("id", "")))
    doubtful = bool(names & _DOUBTFUL_NAMES)
    if in_article and tag in _PROSE and names & _WORDS_TOO:
        doubtful, names = True, names - _WORDS_TOO
    return bool(names & _OUT_NAMES) or not in_article and (doubtful or "header" in names), doubtful and in_article


class Line(NamedTuple):
    """A block's text, its characters outside links, and where it stands; prose tells that its element holds running text, home is the number of the innermost article."""

    text: str
    plain: int
    out: bool
    article: bool
    doubtful: bool
    prose: bool = False
    home: int = 0


def lines_of(page: str) -> list[Line]:
    """The page's block lines, in order."""
    lines: list[Line] = []
    buf: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, out, article, doubtful
    out = article = doubtful = links = 0
    held: dict[str, int] = {}  # open elements by tag
    homes, seen = [0], 0  # numbers of open articles

    def tidy(text: str) -> str:
        return _BLANK.sub(" ", html.unescape(text) if "&" in text else text).strip()

    def flush() -> None:
        nonlocal linked
        if buf:
            text = tidy("".join(buf))
            if text:
                lines.append(Line(text, max(0, len(text) - linked), out > 0, article > 0, doubtful > 0, any(x[0] in _PROSE for x in stack[-4:]), homes[-1]))
            buf.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal out, article, doubtful, links
        while len(stack) > to:
            tag, was_out, was_article, was_doubtful = stack.pop()
            out -= was_out
            article -= was_article
            if was_article:
                homes.pop()
            doubtful -= was_doubtful
            links -= tag == "a"
            held[tag] -= 1

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        piece = page[pos : m.start() if m else size]
        if piece:
            buf.append(piece)
            if links:
                linked += len(tidy(piece))
        if not m:
            break
        pos = m.end()
        name = m[1]
        if name is None:
            if m[0].startswith("<![CDATA["):
                buf.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        closing = m[0][1] == "/"
        if not closing and tag in _RAW and not m[2].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            buf.append(" ")
        if closing:
            if not held.get(tag):
                continue  # nothing to close
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE:
                    break  # a stray end tag of an inline element does not close blocks
            continue
        if tag in _VOID or m[2].rstrip().endswith("/") and tag in _INLINE:
            continue
        if tag not in _INLINE and stack and (stack[-1][0] == "p" or stack[-1][0] in _ENDS.get(tag, ())):
            pop(len(stack) - 1)
        is_article = tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?(?:main|article)\b", m[2]))
        is_out, is_doubtful = _standing(tag, m[2], article > 0)
        stack.append((tag, is_out, is_article and not is_out, is_doubtful))
        held[tag] = held.get(tag, 0) + 1
        if is_article and not is_out:
            seen += 1
            homes.append(seen)
        out += is_out
        article += is_article and not is_out
        doubtful += is_doubtful
        links += tag == "a"
    flush()
    return lines


def weight_of(line: Line) -> float:
    """What a line adds to its windows."""
    if line.out:
        return 0.0
    dense = line.plain * line.plain / len(line.text)
    if line.doubtful:
        return max(0.0, dense - DOUBT)
    return dense * GAIN if line.article else dense


def surges(weights: list[float], window: int, surge: float) -> list[bool]:
    """Which lines lie between a surge and the dive after it: in a run of windows of `window` lines that all weigh
    something, one of which weighs `surge` or more (the page's heaviest window always does), from the first to the last
    line that weighs something."""
    n = len(weights)
    before = [0.0, *accumulate(weights)]
    held = [0, *accumulate(w > 0 for w in weights)]
    ends = [min(n, i + window) for i in range(n)]
    sums = [before[e] - before[i] for i, e in enumerate(ends)]
    some = [held[e] > held[i] for i, e in enumerate(ends)]
    least = min(surge, max(sums, default=0))
    keep = [False] * n
    i = 0
    while i < n:
        if not some[i]:
            i += 1
            continue
        j = i
        while j < n and some[j]:
            j += 1
        if max(sums[i:j]) >= least:
            heavy = [x for x in range(i, j) if weights[x] > 0]
            keep[heavy[0] : heavy[-1] + 1] = [True] * (heavy[-1] + 1 - heavy[0])
        i = j
    return keep


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text, blocks joined by an empty line; empty if it has none."""
    lines = lines_of(page or "")
    weights = [weight_of(x) for x in lines]
    kept = grown(lines, surges(weights, window, surge))
    return "\n\n".join(x.text for x, w, k in zip(lines, weights, kept, strict=True) if k and not x.out and (w or not x.doubtful))


def grown(lines: list[Line], kept: list[bool]) -> list[bool]:
    """Kept lines and, on both sides of each run, the headings and paragraphs of the same article next to it that weigh nothing because they are links."""
    out = list(kept)
    for order in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
        step = 1 if order.step > 0 else -1
        for i in order:
            x = lines[i]
            if not out[i] and out[i - step] and x.prose and not x.out and not x.doubtful and x.plain == 0 and x.home == lines[i - step].home:
                out[i] = True
    return out


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text and n_chars (code points of text), one row per page.

    A null or empty page, or one without article text, has the empty text. Broken markup is read to its end: an
    unfinished tag is markup, unclosed elements end with their parent. Repeated rows stay, other columns are not read,
    an empty table gives an empty one.
    """
    ship(pages.sparkSession)
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts_of(batch.column(len(keep)))
            for lo, hi in byte_slices(rows, 16 << 20):
                found = [main_text(p) for p in rows.slice(lo, hi - lo).to_pylist()]
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, schema)
