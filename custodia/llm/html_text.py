"""Main text of web pages by tree scoring.

A page is read into a tree of elements and a list of text blocks. Each
paragraph passes points, one plus its commas plus one for each 100
characters up to three, to its parent, half to the grandparent and a
third, a sixth by level further up. A container's score is its points
discounted by the share of its text that is links. The best container (or
the ``article``/``main`` element around it) is kept with those siblings
that are not link lists, without menus and other parts that are not article
text. An element whose class or id names such a part goes only if it holds
at most half of the paragraph points of the article/main elements on the
page (or in the article/main around it); without any, of all paragraphs.

Defined cases: NULL or empty html and pages without text give an empty
text; broken markup is closed where the next element requires it; rows that
repeat are separate pages; an empty table gives an empty result; other
columns pass through untouched.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(
    r"(?<![\w-])(class|id|role|style|aria-hidden|hidden|itemprop)(?![\w-])"
    r"(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "template", "svg", "math",
                 "canvas", "object", "video", "audio", "menu", "dialog", "datalist", "label", "fieldset"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div",
          "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
          "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
          "th", "thead", "tr", "ul"} | (DROPPED - RAW - {"button", "select", "label"})
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd", "figcaption"}
#: Boxes that are menus if links make up most of their text; a list whose
#: items say more than their links, as references do, is none.
MENUS = {"ul", "ol", "div", "section", "table", "dl"}
LIST_LINKS = 0.8
#: An opening tag ends an open element of these, up to the given bounds.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}),
           "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NOT_TEXT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|"
    r"footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|"
    r"pager|pagination|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar|signup|skip|social|"
    r"sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
#: Names that say what a page has or lacks, not what the element is.
_HAS = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[_-]\S*|\S+[_-]enabled(?!\S)", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert",
          "alertdialog", "menu", "menubar", "note", "status"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key == "style" and _HIDDEN.search(value):
            return True
        if key in ("class", "id") and tag == "article" and re.search(r"\b(?:comment|reply)", value, re.I):
            return True
    return False


def _named(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether class or id name a part that is not article text."""
    if not attributes or tag in HEADINGS or tag in ("article", "main", "html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            value = _HAS.sub(" ", m[2] or m[3] or m[4] or "")
            if _NOT_TEXT.search(value) or not in_article and _HEADER.search(value):
                return True
    return False


def _joined(parts: list[tuple[str, bool, int]]) -> tuple[str, int]:
    """Text of the parts, and its characters inside links."""
    return (" ".join("".join(t for t, _, _ in parts).split()),
            sum(len("".join(t.split())) for t, linked, _ in parts if linked))


class _Page:
    """Elements (parent and tag by number; parents come first) and blocks
    (element, text, characters inside links) of a page, in page order; the
    elements that their names call no text; and for blocks with such an
    element inside, by number, their parts (text, whether inside a link, the
    element or 0)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.links = [-1], ["#page"], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.named: list[int] = []
        self._open = [0]                 # elements around the current place
        self._depths: dict[str, list[int]] = {}      # where a tag is open, by depth
        self._boxes = [0]                # those of them that are blocks
        self._text: list[tuple[str, bool, int]] = []
        self._inline: list[int] = []     # open elements of named that are no blocks
        self.parts: dict[int, list[tuple[str, bool, int]]] = {}
        self._in_link = 0
        self._articles = 0
        self._read(source)

    def _block(self) -> int:
        return self._boxes[-1]

    def _add(self, text: str, linked: bool) -> None:
        inside = self._inline[-1] if self._inline and self._inline[-1] > self._block() else 0
        self._text.append((text, linked, inside))

    def _flush(self) -> None:
        if self._text:
            parts, self._text = self._text, []
            text, linked = _joined(parts)
            if text:
                if any(e for _, _, e in parts):
                    self.parts[len(self.blocks)] = parts
                self.blocks.append((self._block(), text, linked))

    def _close_to(self, depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        for e in reversed(self._open[depth:]):
            tag = self.tag[e]
            if tag in BLOCKS:
                self._flush()
                self._boxes.pop()
            self._depths[tag].pop()
            if tag == "a":
                self._in_link -= 1
            if tag in ("article", "main"):
                self._articles -= 1
            if self._inline and e == self._inline[-1]:
                self._inline.pop()
            self._open.pop()

    def _close_nearest(self, tags: set[str], bounds: set[str]) -> None:
        def deepest(names: set[str]) -> int:
            return max((self._depths[t][-1] for t in names if self._depths.get(t)), default=0)
        depth = deepest(tags)
        if depth and (not bounds or depth >= deepest(bounds)):
            self._close_to(depth)

    def _skip(self, source: str, name: str, at: int) -> int:
        """The place after the end of a dropped element opened before ``at``."""
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at, self._end)
            return end.end() if end else len(source)
        depth = 1
        while m := _TOKEN.search(source, at, self._end):
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing = m[1] if m[2] else m[4]
            if tag in RAW and not closing and tag != name:
                at = self._skip(source, tag, at)
            elif tag == name:
                depth += -1 if closing else 1
                if not depth:
                    return at
            elif closing and tag in ("body", "html", "article", "main") and depth == 1:
                return m.start()           # never closed
            elif tag == "body" and name == "head":
                return m.start()
        return len(source)

    def _read(self, source: str) -> None:
        at = 0
        self._end = source.rfind(">") + 1            # no tag ends behind it
        comment = source.find("<!--", self._end)
        if comment >= 0:
            source = source[:comment]
        while True:
            m = _TOKEN.search(source, at, self._end) if at < self._end else None
            text = source[at:m.start() if m else len(source)]
            if text:
                self._add(html.unescape(text) if "&" in text else text, self._in_link > 0)
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
            if closing:
                if tag == "br":
                    self._add(" ", False)
                self._close_nearest({tag}, set())
                continue
            if tag in BLOCKS:
                self._flush()
                self._close_nearest({"p"}, {"td", "th", "article", "section", "div", "li", "blockquote",
                                            "main", "body"})
            if tag in IMPLIED:
                self._close_nearest(*IMPLIED[tag])
            if tag == "br":
                self._add(" ", False)
            if tag in VOID:
                continue
            if _unwanted(tag, attributes, self._articles > 0):
                if not attributes.endswith("/") or tag not in ("svg", "math"):
                    if tag in BLOCKS or tag in ("div", "span"):
                        self._flush() if tag in BLOCKS else None
                    at = self._skip(source, tag, at)
                continue
            named = _named(tag, attributes, self._articles > 0)
            if tag == "a":
                self._close_nearest({"a"}, BLOCKS)
                self._in_link += 1
            if tag in ("article", "main"):
                self._articles += 1
            self.parent.append(self._open[-1])
            self.tag.append(tag)
            self.links.append(int(tag == "a"))
            self._depths.setdefault(tag, []).append(len(self._open))
            self._open.append(len(self.tag) - 1)
            if tag in BLOCKS:
                self._boxes.append(len(self.tag) - 1)
            if named:
                self.named.append(len(self.tag) - 1)
                if tag not in BLOCKS:
                    self._inline.append(len(self.tag) - 1)
        self._flush()


def _points(text: str, in_links: int) -> float:
    return (1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) // 100, 3)) \
        * (1 - min(1.0, in_links / len(text)))


def _drop_named(page: _Page) -> None:
    """Take out the blocks of elements that are no text by name and do not
    hold most of the points around them."""
    parent, tag, n = page.parent, page.tag, len(page.tag)
    scope, stop = [0] * n, list(range(1, n + 1))    # article/main or page around; end of the subtree
    for e in range(1, n):
        scope[e] = parent[e] if tag[parent[e]] in ("article", "main") else scope[parent[e]]
    for e in range(n - 1, 0, -1):
        stop[parent[e]] = max(stop[parent[e]], stop[e])
    own = [0.0] * n
    for k, (e, text, in_links) in enumerate(page.blocks):
        if tag[e] in HEADINGS:
            continue
        parts = page.parts.get(k)
        inside: dict[int, list[tuple[str, bool, int]]] = {}
        for p in parts or ():
            inside.setdefault(p[2], []).append(p)
        for x, some in inside.items():
            text, in_links = _joined(some)
            if text:
                own[x or e] += _points(text, in_links)
        if not parts:
            own[e] += _points(text, in_links)
    within: dict[int, tuple[list[float], list[float]]] = {}
    gone = [False] * n
    for e in page.named:
        if gone[e]:
            continue
        around = scope[e]
        if around not in within:                    # running sums of all points, and of those in inner articles
            all_, inner = [0.0], [0.0]
            for x in range(around, stop[around]):
                deeper = x != around and (tag[x] in ("article", "main") or scope[x] != around)
                all_.append(all_[-1] + own[x])
                inner.append(inner[-1] + own[x] * deeper)
            within[around] = all_, inner
        all_, inner = within[around]
        sums = inner if inner[-1] > 0 else all_
        if 2 * (sums[stop[e] - around] - sums[e - around]) <= sums[-1]:
            gone[e:stop[e]] = [True] * (stop[e] - e)
    blocks = []
    for k, (e, text, in_links) in enumerate(page.blocks):
        if k in page.parts:
            text, in_links = _joined([p for p in page.parts[k] if not gone[p[2]]])
        if text and not gone[e]:
            blocks.append((e, text, in_links))
    page.blocks = blocks
    for e in range(n):
        if gone[e]:
            page.links[e] = 0


def main_text(source: str | None) -> str:
    """The blocks of the main text of one page, joined by line ends."""
    if not source:
        return ""
    page = _Page(source)
    if page.named:
        _drop_named(page)
    parent, tag, n = page.parent, page.tag, len(page.tag)
    points, length, linked, links = [0.0] * n, [0] * n, [0] * n, list(page.links)
    for e, text, in_links in page.blocks:
        length[e] += len(text)
        linked[e] += in_links
        if tag[e] in HEADINGS:
            continue
        score = _points(text, in_links)
        up, level = (parent[e], 1) if tag[e] in PARAGRAPHS else (e, 1)
        while up >= 0 and level <= 5:
            points[up] += score / (level if level < 3 else 3 * (level - 2))
            up, level = parent[up], level + 1
    for e in range(n - 1, 0, -1):
        length[parent[e]] += length[e]
        linked[parent[e]] += linked[e]
        links[parent[e]] += links[e]
    density = [min(1.0, a / b) if b else 0.0 for a, b in zip(linked, length)]
    score = [p * (1 - d) for p, d in zip(points, density)]
    best = max(range(n), key=lambda e: (score[e], length[e] > 0, e))
    if score[best] <= 0:
        article = [e for e in range(n) if tag[e] in ("article", "main") and length[e]]
        if not article:
            return "\n".join(t for _, t, _ in page.blocks) if n == 1 else ""
        best = article[0]
    e = best
    while e > 0:
        e = parent[e]
        if tag[e] in ("article", "main") and tag[best] != "article":
            best = e
    kept = [False] * n
    kept[best] = True
    around = parent[best]
    in_article = tag[best] in ("article", "main")
    children: list[list[int]] = [[] for _ in range(n)]
    for x in range(1, n):
        if length[x]:
            children[parent[x]].append(x)
    while True:
        siblings = [x for x in children[around] if x != best] if around >= 0 else []
        for x in siblings:
            if tag[x] == "p":
                kept[x] = density[x] < 0.25 and (length[x] > 80 or not linked[x])
            elif not in_article or tag[x] == tag[best] or tag[x] in HEADINGS and x < best:
                kept[x] = density[x] < 0.25
        # a parent with nothing but text in it is part of the text
        if in_article or around <= 0 or tag[around] in ("body", "html") or not all(kept[x] for x in siblings):
            break
        best, around = around, parent[around]
        kept[best] = True
    for e in range(1, n):
        if not kept[e] and kept[parent[e]] if parent[e] >= 0 else False:
            menu = tag[e] in MENUS and links[e] >= 3 and density[e] > (LIST_LINKS if tag[e] in ("ul", "ol") else 0.5)
            kept[e] = not menu
    return "\n".join(text for e, text, _ in page.blocks if kept[e])


def extract_text(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in a column ``name``."""
    if name in pages.columns:
        raise ValueError(f"column {name} exists")
    schema = T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, name])

    return pages.mapInArrow(run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars (its code points)."""
    texts = extract_text(pages.select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
