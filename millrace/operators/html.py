"""HTML to text and media nodes, in one vectorised function a batch.

The page is parsed once by the standard library's parser, with paragraphs and
list items closed by what follows them. Style tags don't break a text; tags
that hold no content are dropped with all below them, as are navigation
blocks and texts that only name a date; what is left is flattened in order
and neighbouring texts are merged with the strongest separator between them.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import small_batches

#: Tags that only style their text: fixed values.
STYLE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "shadow", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Tags whose texts are kept, with the separator that such a tag asks for between texts: fixed values.
SEPARATORS = {
    "address": "\n",
    "article": "\n",
    "aside": "\n",
    "blink": "",
    "blockquote": "\n\n",
    "body": "",
    "caption": "",
    "center": "\n",
    "dd": "\n",
    "dl": "\n\n",
    "dt": "\n",
    "div": "\n",
    "figcaption": "\n",
    "h": "",
    "h1": "\n\n",
    "h2": "\n\n",
    "h3": "\n\n",
    "h4": "\n\n",
    "h5": "\n\n",
    "h6": "\n\n",
    "hgroup": "\n",
    "html": "",
    "legend": "\n",
    "main": "\n",
    "marquee": "\n",
    "ol": "\n\n",
    "p": "\n\n",
    "section": "\n",
    "summary": "\n",
    "title": "",
    "ul": "\n\n",
}
#: Media tags and what may name their address: fixed values.
MEDIA = ["audio", "embed", "figure", "iframe", "img", "object", "picture", "video", "source"]
CONTENT = {*SEPARATORS, "br", *MEDIA}
NAVIGATION = {"footer", "header", "navigation", "nav", "navbar", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = {"address", "article", "aside", "blockquote", "center", "dl", "div", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Where a picture's address may stand, most telling first: fixed values.
SOURCES = ["src", "data-src", "data-src-fg", "data-scroll-image", "srcset", "data-lateloadsrc", "data-img-src", "data-original", "data-gt-lazy-src", "data-lazy", "data-lazy-src", "src2"]


DIGITS, BLANKS = re.compile("[0-9]"), re.compile("[ \\n\\t\\r]+")


class _Place:
    """An open tag that isn't a style tag, under the one around it."""

    __slots__ = ("up", "tag", "depth", "dated")

    def __init__(self, up, tag: str, attrs: dict):
        self.up, self.tag, self.depth = up, tag, up.depth + 1 if up else 1
        self.dated = tag == "div" and "date" in (attrs.get("class") or "").lower()


class _Reader(HTMLParser):
    """Collects (kind, value, place, attributes) nodes of kept content; the work follows the length of the page, not its depth."""

    def __init__(self, keep_pictures: bool = False, end_ids=frozenset()):
        super().__init__(convert_charrefs=True)
        self.keep_pictures, self.end_ids = keep_pictures, end_ids
        self.shut: int | None = None  # depth of the element whose rest goes
        self.open: list[tuple[str, bool, _Place | None]] = []  # tag, whether its content is kept, the innermost place
        self.count: Counter = Counter()
        self.nodes: list[tuple] = []

    def _kept(self, tag: str, attrs: dict) -> bool:
        if tag not in STYLE and DIGITS.sub("", tag) not in CONTENT:
            return False
        return not (tag == "div" and any((attrs.get(k) or "").strip().lower() in NAVIGATION for k in ("id", "class", "title")))

    def _place(self):
        return self.open[-1][2] if self.open else None

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if self.shut is None and named.get("id") in self.end_ids:
            self.shut = len(self.open)
        if tag in BLOCKS and self.count["p"]:
            self._close({"p"})
        if tag in CLOSES:
            self._close(CLOSES[tag], within={"table", "ul", "ol", "dl"})
        kept = (self.open[-1][1] if self.open else True) and self._kept(tag, named) and self.shut is None
        if tag == "br" and kept:
            self.nodes.append(("text", "\n", self._place(), {}))
        elif tag in {"img", "video", "audio"} and (kept or (tag == "img" and self.keep_pictures and self.shut is None)):
            self.nodes.append(("media", tag, self._place(), named))
        if tag not in VOID:
            self.open.append((tag, kept, self._place() if tag in STYLE else _Place(self._place(), tag, named)))
            self.count[tag] += 1

    def _close(self, tags, within=frozenset()):
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self._cut(i)
                return
            if self.open[i][0] in within:
                return

    def _cut(self, i: int) -> None:
        for tag, _, _ in self.open[i:]:
            self.count[tag] -= 1
        del self.open[i:]
        if self.shut is not None and i < self.shut:
            self.shut = None  # the element around it has ended

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close({tag})

    def handle_data(self, data):
        if self.shut is not None or (self.open and not self.open[-1][1]):
            return
        place = self._place()
        if place and place.dated:
            return
        self.nodes.append(("text", BLANKS.sub(" ", data), place, {}))


def media_source(attrs: dict) -> str | None:
    """The address of a media element; one with a comma or a blank in it isn't one address."""
    for name in SOURCES:
        value = (attrs.get(name) or "").strip()
        if value and "," not in value and " " not in value and not value.startswith("data:"):
            return value
    return None


def _gap(a, b) -> str:
    """The strongest separator that the tags in which two places differ ask for."""
    best = ""
    while a is not b:
        if b is None or (a is not None and a.depth >= b.depth):
            tag, a = a.tag, a.up
        else:
            tag, b = b.tag, b.up
        gap = SEPARATORS.get(tag, "")
        if len(gap) > len(best):
            best = gap
    return best


def _uncommented(page: str) -> str:
    """The page without comments; one that is never closed stays, as text."""
    out, at = [], 0
    while (start := page.find("<!--", at)) >= 0 and (end := page.find("-->", start + 4)) >= 0:
        out.append(page[at:start])
        at = end + 3
    return "".join([*out, page[at:]])


def nodes_of(page: str | None, keep_pictures: bool = False, end_ids=frozenset()) -> list[dict]:
    """The page's texts and media in order: dicts with text, or src, alt, width and height.

    ``keep_pictures`` keeps pictures in elements that go otherwise; an element
    with one of ``end_ids`` goes with all that follows it in the element around.
    """
    reader = _Reader(keep_pictures, frozenset(end_ids))
    reader.feed(_uncommented(page or ""))
    reader.close()
    out: list[dict] = []
    parts: list[str] = []
    place, placed = None, False

    def flush():
        nonlocal placed
        clean = re.sub(r" ?\n ?", "\n", re.sub(" {2,}", " ", "".join(parts))).strip()
        if clean:
            out.append({"text": re.sub("\n{3,}", "\n\n", clean), "src": None, "alt": None, "width": None, "height": None})
        parts.clear()
        placed = False

    for kind, value, where, attrs in reader.nodes:
        if kind == "media":
            if (src := media_source(attrs)) is not None:
                flush()
                out.append({"text": None, "src": src, "alt": attrs.get("alt"), "width": attrs.get("width"), "height": attrs.get("height")})
        elif value.strip(" ") or parts:
            gap = _gap(place, where) if placed and value != "\n" else ""
            if value.strip(" ") and gap:
                while parts and not parts[-1].rstrip(" "):
                    parts.pop()
                if parts:
                    parts[-1] = parts[-1].rstrip(" ")
                if not "".join(parts[-2:]).endswith(gap):
                    parts.append(gap)
                value = value.lstrip(" ")
            if value:
                parts.append(value)
            if value.strip(" \n"):
                place, placed = where, True
    flush()
    return out


NODE = "array<struct<text: string, src: string, alt: string, width: string, height: string>>"


#: Pages whose nodes a worker holds at once.
PAGES = 32


def extract(pages: DataFrame, html: str = "html", keep_pictures: bool = False, end_ids=()) -> DataFrame:
    """``pages`` with ``nodes`` and ``html_error`` (null if the page was read) in place of the HTML."""
    rest = [c for c in pages.columns if c not in (html, "nodes", "html_error")]
    small_batches(pages.sparkSession)
    rows = pages.select(*rest, F.col(html).alias("__html"))
    n = len(rest)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(c, pa.string()) for c in ("text", "src", "alt", "width", "height")]))
        parts = (batch.slice(at, PAGES) for batch in batches for at in range(0, batch.num_rows, PAGES))
        for batch in parts:
            nodes, errors = [], []
            for page in batch.column(n).to_pylist():
                try:
                    nodes.append(nodes_of(page, keep_pictures, end_ids))
                    errors.append(None)
                except (ValueError, AssertionError, RecursionError) as e:
                    nodes.append([])
                    errors.append(repr(e))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(nodes, kind), pa.array(errors, pa.string())], names=[*rest, "nodes", "html_error"])

    schema = rows.select(*rest).schema.add("html_error", "string")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, nodes {NODE}, html_error string")
