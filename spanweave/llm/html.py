"""Main text of web pages by the line-block distribution.

Markup is stripped into one line a block element; text in containers that are page furniture by their element, role, class or id carries no weight, and less of it where a name is furniture only in
part ("related-work", outside a marked article). Over the lines, text lengths are summed in sliding windows. Where the sum surges from its floor the article begins, where it dives back the article ends,
and the weighted lines between are kept, all of them.

A surge must exceed a fifth of the page's largest window. On a page that marks its article (by element, role, id or class), lines inside it weigh ten times those outside, and
each kind has windows of its own: text outside is kept where a window of it holds more than twice the text of the article's largest window. If the page's largest window is
the article's, its mark is confirmed and any text in it is a surge. Outside a marked article, link text carries no weight.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_batches, whole_row

WINDOW = 3
#: A surge: this share of the largest window's text.
SURGE_SHARE = 0.2
#: The weight of a character inside a marked article; one outside weighs 1.
MARKED = 10
#: Outside a marked article, a line that is made of links by this share is no text.
LINK_SHARE = 0.8

# Elements of HTML and names that pages commonly give to what is not the article.
DROPPED = {"script", "style", "noscript", "template", "svg", "math", "head", "title", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "note"}
ADVERTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion"}
NAMES = ADVERTS | set(
    "banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs toolbar header masthead topbar footer "
    "comment comments commentlist disqus replies reply respond share sharing social related recommended widget widgets popup modal overlay pagination pager search copyright disclaimer".split()
)
# What names of page furniture are compounded with; any other word beside them speaks for a topic or a layout.
BESIDE = set(
    "site page main global top bottom left right inner outer box bar list container wrapper wrap panel block area region section group item items link links button buttons icon icons title heading count "
    "form field input text body content post posts article articles story stories slot unit zone thread user reader primary secondary mobile desktop sticky fixed module component row col column js the".split()
)
#: Weight of text under a name that is furniture only in part.
DOUBTED = 0.25
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "span", "em", "strong", "b", "i", "code"}
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math")
ARTICLE = {"article", "main"}
# Ids and classes that pages commonly give to the container of their article.
ARTICLE_IDS = {"main", "content", "article", "main-content", "maincontent", "article-body", "post"}
ARTICLE_CLASSES = {"article", "article-body", "article-content", "main-content", "post-content", "post-body", "entry-content", "story-body"}

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_INSIDE = re.compile(r"(?:[^'\"<>]++|\"[^\"]*\"|'[^']*')*+")
_PLAIN = re.compile(r"[^<>]*")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def name_weight(value: str, names: set[str]) -> float:
    """What a class or id leaves of the weight of its text: nothing, if one of its names is furniture throughout; less, if one is in part."""
    least = 1.0
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if not words.isdisjoint(names):
            least = min(least, 0.0 if words <= names | BESIDE else DOUBTED)
    return least


def tag_weight(tag: str, attrs: str, inside: bool) -> float:
    """What an element leaves of the weight of its text, by its name, role, class, id or hiddenness: 0 for page furniture.

    Inside a marked article, a name that is furniture only in part says nothing, and single blocks of text are furniture only as adverts.
    """
    if tag in FURNITURE or tag in DROPPED:
        return 0.0
    if not attrs.strip() or tag in ("html", "body"):
        return 1.0
    weight = 1.0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 0.0
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 0.0
        if name in ("class", "id"):
            if tag == "article" and re.search(r"comment|repl(y|ies)|related|promo", value, re.I):
                return 0.0
            if tag not in ("article", "main"):
                weight = min(weight, name_weight(value, ADVERTS if inside and tag in TEXTS else NAMES))
    return 1.0 if inside and weight > 0 else weight


def is_article(tag: str, attrs: str) -> bool:
    """Whether an element is marked as the article, by its name, role, id, class or item property."""
    if tag in ARTICLE:
        return True
    if tag not in ("div", "section", "td") or not attrs.strip():
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "role" and value == "main" or name == "itemprop" and value == "articlebody" or name == "id" and value in ARTICLE_IDS or name == "class" and not ARTICLE_CLASSES.isdisjoint(value.split()):
            return True
    return False


class Tags:
    """The tags of a page, read in one pass.

    A tag ends at the first > outside quotes. One that is never closed ends at the next <, if it reads like a tag (attributes, or nothing beyond its name), and is text otherwise; a quote that is never
    closed ends at the first >. Once a quote was found unclosed, quotes are not heeded any more, so that no stretch is read again and again.
    """

    def __init__(self, html: str):
        self.html, self.quotes, self.ends = html, True, True

    def end_of(self, sign: str, at: int) -> int:
        found = self.html.find(sign, at)
        return found if found >= 0 else len(self.html)

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag; comments and declarations have no name."""
        html, n = self.html, len(self.html)
        while m := _OPEN.search(html, at):
            if m[1]:
                return m.start(), min(n, self.end_of("-->", m.end()) + 3), False, "", ""
            if m[2]:
                close = self.end_of(">", m.end()) if self.ends else n
                self.ends = close < n
                return m.start(), min(n, close + 1), False, "", ""
            stop = _INSIDE.match(html, m.end()).end() if self.quotes else m.end()
            if not self.quotes or stop < n and html[stop] not in "<>":
                self.quotes = False
                stop = _PLAIN.match(html, m.end()).end()
            attrs = html[m.end() : stop]
            if stop < n and html[stop] == ">":
                return m.start(), stop + 1, bool(m[3]), m[4].lower(), attrs
            if not attrs.strip() or "=" in attrs:
                return m.start(), stop, bool(m[3]), m[4].lower(), attrs
            at = m.end()
        return None


class Lines:
    """The lines of a page as its tags open and close."""

    def __init__(self):
        self.lines: list[tuple[str, int, float, bool]] = []
        self.stack: list[tuple[str, float, bool]] = []  # open elements, what they leave of the weight and whether they are the article
        self.open: Counter = Counter()
        self.blocks: list[int] = []  # where in the stack blocks lie
        self.parts: list[str] = []
        self.furniture = self.doubted = self.articles = self.links = 0
        self.marked = False

    def text(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.open["a"]:
                self.links += len(text.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                weight = 0.0 if self.furniture else DOUBTED if self.doubted and not self.articles else 1.0
                self.lines.append((text, self.links, weight, self.articles > 0))
            self.parts.clear()
        self.links = 0

    def pop(self) -> None:
        tag, weight, good = self.stack[-1]
        if tag in BLOCKS or weight < 1:
            self.flush()
        self.stack.pop()
        self.open[tag] -= 1
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        self.furniture -= weight == 0
        self.doubted -= 0 < weight < 1
        self.articles -= good

    def close(self, tag: str) -> None:
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()
        elif tag in BLOCKS:
            self.flush()

    def begin(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.flush()
            if self.blocks and self.stack[self.blocks[-1]][0] in _SELF_CLOSING.get(tag, ()):
                for _ in range(len(self.stack) - self.blocks[-1]):
                    self.pop()
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCKS:
            return
        weight = tag_weight(tag, attrs, self.articles > 0)
        good = weight > 0 and is_article(tag, attrs)
        if good and not self.marked and tag in ARTICLE:
            while self.stack and self.furniture and not self.articles and self.stack[-1][0] not in FURNITURE:
                self.pop()  # a container that was never closed ends where the article begins
        if weight < 1:
            self.flush()
        self.furniture += weight == 0
        self.doubted += 0 < weight < 1
        self.marked = self.marked or good and not self.furniture
        self.articles += good
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.open[tag] += 1
        self.stack.append((tag, weight, good))


def page_lines(html: str) -> tuple[list[tuple[str, int, float, bool]], bool]:
    """Lines of a page in order: (text, characters of links, weight its containers leave it, inside a marked article), and whether an article is marked."""
    page, tags, at = Lines(), Tags(html), 0
    while found := tags.after(at):
        begin, end, closing, tag, attrs = found
        page.text(html[at:begin])
        at = end
        if closing:
            page.close(tag)
        elif tag in _RAW_END and not attrs.rstrip().endswith("/"):
            close = _RAW_END[tag].search(html, end)
            at = close.end() if close else len(html)
            page.parts.append(" ")
        elif tag:
            page.begin(tag, attrs)
    page.text(html[at:])
    page.flush()
    return page.lines, page.marked


def spans(weights: list[float], surge: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Half-open line spans between surge and dive of the windowed text sums.

    The sum at line i covers lines i to i + window - 1. A span opens at the first weighted line of a window that exceeds `surge`, reaches back over weighted
    lines that adjoin it, and closes at the first line whose window holds no text.
    """
    n = len(weights)
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    block = [total[min(n, i + window)] - total[i] for i in range(n)]
    out, i = [], 0
    while i < n:
        if block[i] <= surge:
            i += 1
            continue
        lo = i
        while lo > 0 and weights[lo - 1] > 0 and (not out or lo > out[-1][1]):
            lo -= 1
        hi = i
        while hi < n and block[hi] > 0:
            hi += 1
        out.append((lo, hi))
        i = max(hi, i + 1)
    return out


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by newlines. Null or empty html, and pages without text, give an empty text."""
    if not html:
        return ""
    lines, _ = page_lines(html)
    inner = [MARKED * len(text) if inside and weight else 0 for text, _, weight, inside in lines]
    outer = [0 if inside or links >= LINK_SHARE * len(text) else weight * (len(text) - links) for text, links, weight, inside in lines]
    peaks = [max((sum(w[i : i + WINDOW]) for i in range(len(w))), default=0) for w in (inner, outer)]
    bar = SURGE_SHARE * max(peaks)
    chosen = {i for w, surge in ((inner, 0 if peaks[0] >= peaks[1] else bar), (outer, bar)) for lo, hi in spans(w, surge) for i in range(lo, hi) if w[i] > 0}
    return "\n".join(lines[i][0] for i in sorted(chosen))


def extract_main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every page: key, url, text and n_chars (code points).

    Null html counts as empty and gives an empty text; null keys and urls pass through; repeated rows stay; an empty table gives no rows; other columns
    are ignored. One narrow map over the scan.
    """
    text_batches(pages.sparkSession)
    row = whole_row(pages)
    narrow = pages.select(row.getField(key).alias("k"), row.getField(url).alias("u"), row.getField(html).alias("h"))

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["k", "u", "text", "n_chars"])

    kinds = [narrow.schema[c].dataType.simpleString() for c in ("k", "u")]
    return narrow.mapInArrow(run, f"k {kinds[0]}, u {kinds[1]}, text string, n_chars long").toDF(key, url, "text", "n_chars")
