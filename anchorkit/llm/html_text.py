"""Main text of web pages by scoring the element tree.

Text blocks give points (one, one per comma, one per hundred characters up to three) to the element
around them and, discounted, to that one's ancestors. An element's points count less the more of its
text is links. The best element is the container of the article; brothers that score well, and plain
paragraphs beside it, belong to it. Menus, forms, adverts, notices and comments are known by element,
role and name and give no points. What holds an <article> or <main>, or by far the most text of a page, is
not dropped by its name or for being a form; and a page of which little is left is scored again without that rule.

A page is one row and is read alone; the tree is kept as flat lists, so deep nesting is no recursion.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorkit.llm.rows import named

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in
        "script style textarea title noscript iframe xmp noframes noembed template svg math object".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary "
    "table tbody td tfoot th thead tr ul button".split())
#: A start tag in the key ends an open element of the value, up to the nearest of _SCOPE.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_TABLE = {"table", "html"}
_DROPPED = frozenset("nav footer aside form button select option dialog menu head input fieldset label".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle banner sponsor sponsored sponsors promo promos "
    "promoted promotion sidebar sidebars aside nav navbar navigation navi menu menus menubar breadcrumb breadcrumbs crumbs footer "
    "foot masthead topbar comment comments commentlist disqus replies reply respond discussion cookie cookies consent gdpr "
    "notice notices notification alert disclaimer newsletter subscribe subscription signup popup modal overlay paywall share sharing "
    "social socials related recommended recommendations pagination pager toolbar widget widgets login search skip outbrain taboola "
    "complementary contentinfo alertdialog tooltip".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
_HOLDS = frozenset({"article", "main"})
#: A header with one of these beside it is the article's own.
_OWN = frozenset("article post entry content story blog".split())
_LAYOUT = re.compile(r"\b(?:with|has|no|without|show|hide)[-_]+[a-z0-9]+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_BASE = {"article": 10.0, "main": 10.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ol": -3.0, "ul": -3.0,
         "dl": -3.0, "th": -5.0, "address": -3.0}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never part of a text; other elements are away unless they hold the article; names and forms also unless they are large.
_HARD, _FIRM, _SOFT = 3, 2, 1
_NEVER = frozenset("head input button select option label".split())
#: A text of fewer characters is little; an element with so many, and over half of the page's, is large.
_LITTLE = 250
#: Points of blocks whose ancestor's name speaks against them.
_DOUBT = 0.2
#: Ancestors that get points from a block.
_LEVELS = 5


def _named_away(tag: str, attributes: str, in_article: bool) -> int:
    """How firmly role, class, id or a hidden attribute say that this is not the article (0: not at all).

    Words after "with", "has" and the like only tell how a page is laid out.
    """
    if not attributes or tag in ("html", "body"):
        return 0
    words: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return _HARD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _HARD
        if name in ("class", "id", "role"):
            words.update(_SPLIT.split(_LAYOUT.sub(" ", _CAMEL.sub(" ", value).lower())))
    if words & {"header", "head"} and not in_article and tag not in _HEADINGS and not words & _OWN:
        return _SOFT
    if words & _COMMENTS:
        return _FIRM
    return _SOFT if tag not in _HOLDS and tag not in _HEADINGS and words & _NAMES else 0


class _Page:
    """Elements in page order (flat lists) and the pieces of text with the block run they belong to."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.away = ["html"], [-1], [0]
        self.texts: list[tuple[int, int, bool, str]] = []  # element, block run, inside a link, text
        self._stack, self._open, self._run, self._links = [0], {"html": 1}, 0, 0
        at = 0
        while token := _TOKEN.search(source, at):
            if token.start() > at:
                self._text(source[at:token.start()])
            at = token.end()
            tag = token[2] or token[5]
            if not tag:
                continue
            tag = tag.lower()
            if token[1] or token[4]:
                self._end(tag)
                continue
            self._start(tag, token[3] or token[6] or "")
            if tag in _RAW:
                at = _RAW[tag].search(source, at).end()
                self._pop()
        if at < len(source):
            self._text(source[at:])

    def _text(self, text: str) -> None:
        self.texts.append((self._stack[-1], self._run, self._links > 0, html.unescape(text) if "&" in text else text))

    def _pop(self) -> None:
        tag = self.tag[self._stack.pop()]
        self._open[tag] -= 1
        self._links -= tag == "a"
        self._run += tag in _BLOCK

    def _close(self, wanted: set[str], scope: set[str]) -> None:
        """Ends the nearest open element of ``wanted`` and what is open in it, unless one of ``scope`` is nearer."""
        if any(self._open.get(t) for t in wanted):
            for k in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[k]]
                if tag in wanted:
                    while len(self._stack) > k:
                        self._pop()
                    return
                if tag in scope:
                    return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and (tag == "html" or self._open.get("body")):
            return
        if tag in _BLOCK:
            self._close({"p"}, {"td", "th", "table", "button", "caption", "html", "object"})
        if tag in _HEADINGS:
            self._close(set(_HEADINGS), {"div", "section", "article", "html", "td"})
        if tag in _ENDS:
            self._close(_ENDS[tag], _SCOPE.get(tag, _TABLE))
        if tag == "a":
            self._close({"a"}, {"td", "th", "table", "html"})
        if tag == "br":
            self.texts.append((self._stack[-1], self._run, False, " "))
        self._run += tag in _BLOCK
        if tag in _VOID:
            return
        up = self._stack[-1]
        self.tag.append(tag)
        self.parent.append(up)
        # a header inside an article is part of it
        in_article = any(self._open.get(t) for t in _HOLDS)
        away = _HARD if tag in _RAW or tag in _NEVER else _SOFT if tag == "form" else _FIRM if tag in _DROPPED else 0
        away = away or (_SOFT if tag == "header" and not in_article else 0)
        self.away.append(max(away, _named_away(tag, attributes, in_article)))
        self._stack.append(len(self.tag) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1
        self._links += tag == "a"

    def _end(self, tag: str) -> None:
        if tag in ("html", "body") or not self._open.get(tag):
            if tag == "br":
                self.texts.append((self._stack[-1], self._run, False, " "))
            return
        for k in range(len(self._stack) - 1, 0, -1):
            own = self.tag[self._stack[k]]
            if own == tag:
                while len(self._stack) > k:
                    self._pop()
                return
            if tag not in _BLOCK and own in _BLOCK:
                return  # an inline end tag doesn't end the block around


def main_text(source: str | None) -> str:
    """Blocks of the article in page order, joined by an empty line; white space in a block is one space.

    Null, empty and pages without any text outside of menu, form field and similar elements give "".
    """
    if not source:
        return ""
    page = _Page(source)
    text, sure = _scored(page, False)
    if not sure and len(text) < _LITTLE:
        milder, _ = _scored(page, True)
        if not text or len(milder) >= max(_LITTLE, 4 * len(text)):
            return milder
    return text


def _scored(page: _Page, mild: bool) -> tuple[str, bool]:
    """The main text, and whether it is that of an <article> or <main>; ``mild``: names and forms take only points."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    held, main, plain = [0] * n, [False] * n, [0] * n
    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[parent[i]] or page.away[i] == _HARD
    for element, _, link, text in page.texts:
        if not link and not gone[element]:
            plain[element] += len(" ".join(text.split()))
    for i in range(n - 1, 0, -1):
        own = tag[i] in _HOLDS and not page.away[i]
        held[parent[i]] += held[i] + own
        main[parent[i]] |= main[i] or own and tag[i] == "main"
        if page.away[i] != _FIRM or held[i]:
            plain[parent[i]] += plain[i]
    away, doubt, worth_of = [False] * n, [False] * n, [1.0] * n
    for i in range(1, n):  # parents come before their children
        up = parent[i]
        kind = page.away[i]
        large = kind == _SOFT and (mild or plain[i] >= _LITTLE and 2 * plain[i] > plain[0])
        away[i] = away[up] or kind == _HARD or kind > 0 and not held[i] and not large
        # what holds the page's main part is a wrapper, whatever its name; so is a form around the page
        doubt[i] = kind > 0 and tag[i] != "form" and not (main[i] or held[i] and held[i] == held[0])
        worth_of[i] = _DOUBT if doubt[i] else worth_of[up]
    block = [0] * n
    for i in range(1, n):
        block[i] = i if tag[i] in _BLOCK else block[parent[i]]

    blocks: list[list] = []  # element, text, characters of links
    last = None
    for element, run, link, text in page.texts:
        if away[element]:
            continue
        if run != last:
            blocks.append([block[element], [], 0])
            last = run
        blocks[-1][1].append(text)
        blocks[-1][2] += len(text) * link
    blocks = [[e, t, k] for e, parts, k in blocks if (t := " ".join("".join(parts).split()))]
    if not blocks:
        return "", False

    size, linked, links, points = [0.0] * n, [0.0] * n, [0] * n, [0.0] * n
    for e, t, k in blocks:
        size[e] += len(t)
        linked[e] += min(k, len(t))
        links[e] += k > 0
        if tag[e] in _HEADINGS:
            continue
        worth = (1 + t.count(",") + t.count("，") + t.count("、") + min(len(t) // 100, 3)) * (1 - min(1.0, k / len(t))) * worth_of[e]
        up = e if tag[e] in ("div", "section", "article", "main", "body", "html", "td") else parent[e]
        for level in range(_LEVELS):
            if up < 0:
                break
            points[up] += worth / (1, 2, 6, 9, 12)[level]
            up = parent[up]
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        linked[parent[i]] += linked[i]
        links[parent[i]] += links[i]

    def score(i: int) -> float:
        return (points[i] + (_BASE.get(tag[i], 0.0) if points[i] > 0 else 0.0)) * (1 - linked[i] / size[i]) if size[i] else 0.0

    best = max(range(n), key=lambda i: (score(i), -i))
    up = best
    while up >= 0:  # an article in sections: the whole of it
        if tag[up] in _HOLDS:
            best = up
            break
        up = parent[up]
    sure = tag[best] in _HOLDS
    inside = [False] * n
    least = max(1e-9, 0.2 * score(best))
    own_text = [False] * n
    for e, t, k in blocks:
        own_text[e] |= tag[e] in ("p", "pre", "blockquote") and k < 0.25 * len(t)
    for i in range(n):
        brother = parent[i] == parent[best] and i != best and not away[i] and (mild or not doubt[i])
        # a part with a name that speaks against it stays when most of the text is in it
        part = i > 0 and inside[parent[i]] and (not doubt[i] or 2 * size[i] > size[best])
        inside[i] = (i == best or part or brother and (
            score(i) >= least or own_text[i] or tag[i] in _HEADINGS and i < best))
    # inside the container, lists that are mostly links are menus
    menu = [False] * n
    for i in range(1, n):
        menu[i] = menu[parent[i]] or tag[i] in ("ul", "ol", "dl", "table") and links[i] >= 3 and linked[i] > 0.6 * size[i]
    return "\n\n".join(t for e, t, _ in blocks if inside[e] and not menu[e]), sure


@F.arrow_udf(T.StringType())
def _texts(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        yield pa.array([main_text(x.as_py()) for x in batch], pa.string())


def extract(df: DataFrame, source: str = "html", to: str = "text") -> DataFrame:
    """``df`` plus ``to`` (string, never null): the main text of each page; other columns and all rows stay."""
    return df.withColumn(to, _texts(named(df, source)))

