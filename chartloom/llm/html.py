"""Main text of web pages by the text and punctuation ratios of tag paths.

A page is taken apart into blocks of text, each with the path of tags from the root
to it.  A path's ratios are its characters and its punctuation marks for each block;
they are smoothed along the page, multiplied, and paths over a threshold are content.
What lies in the element that holds the content, and in no part that its tag, role
or class names as furniture, is the main text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A path is content if its score is over so many standard deviations of the page's paths.
SIGMAS = 0.8
SMOOTH = (0.25, 0.5, 0.25)
#: A block of which more than this is link text counts as a link.
LINK_SHARE = 0.6
ROWS = 64

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math title textarea select object canvas audio video noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th"
    " thead tr ul".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr", ("table", "tbody", "thead", "tfoot")),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
FURNITURE_TAGS = frozenset("nav footer aside form button dialog menu head search".split())
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tablist".split()
)
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar"
    " footer header masthead sidebar aside rail widget widgets"
    " comment comments commentlist disqus respond reply replies"
    " notice notices alert cookie cookies consent gdpr popup modal overlay toast"
    " form login signin signup register subscribe subscription newsletter search searchbox"
    " share sharing social related recommended recommendations teaser copyright hidden".split()
)
#: A name that begins so tells how a page is laid out.
LAYOUT_WORDS = frozenset("has with no without not is".split())
MARKS = re.compile(r"[.,;:!?…。，、；：！？¿¡«»“”\"()\-–—]")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z-]+)""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Element:
    tag: str
    parent: Element | None
    furniture: bool
    #: whether a name made it so, which an article inside undoes
    by_name: bool
    main: Element | None
    depth: int


@dataclass
class Block:
    element: Element
    path: str
    text: str
    link_chars: int
    furniture: bool
    named: bool
    fused: float = field(default=0.0)


def named_furniture(tag: str, attributes: str) -> tuple[bool, frozenset[str]]:
    """Whether tag, role or style say that an element is furniture, and which of its class and id names do."""
    by_tag, names = tag in FURNITURE_TAGS, set()
    for name, a, b, c, alone in ATTRIBUTE.findall(attributes):
        name, value = (name or alone).lower(), (a or b or c).lower()
        if name == "role":
            by_tag = by_tag or value in FURNITURE_ROLES
        elif name in ("class", "id"):
            for said in value.split():
                words = re.split(r"[_-]+", said)
                if words[0] not in LAYOUT_WORDS:
                    names.update(FURNITURE_NAMES.intersection(words))
        elif name == "hidden" or name == "style" and HIDDEN.search(value) or name == "aria-hidden" and value == "true":
            by_tag = True
    return by_tag, frozenset(names)


class Page:
    """One pass over the markup: blocks of text in page order."""

    def __init__(self, known: dict[tuple[str, str], tuple[bool, frozenset[str]]]) -> None:
        self.known = known
        self.blocks: list[Block] = []
        self.here = Element("", None, False, False, None, 0)
        self.parts: list[str] = []
        self.links = self.link_chars = 0
        self.owner: Element | None = None

    def parse(self, source: str) -> list[Block]:
        at, end, tag = 0, len(source), TAG
        while at < end:
            start = source.find("<", at)
            if start < 0:
                self.say(source[at:])
                break
            if start > at:
                self.say(source[at:start])
            if source.startswith("<!--", start):
                stop = source.find("-->", start + 4)
                at = end if stop < 0 else stop + 3
            elif source.startswith(("<!", "<?"), start):
                stop = source.find(">", start)
                at = end if stop < 0 else stop + 1
            elif m := tag.match(source, start):
                at = m.end()
                name = m[2].lower()
                if m[1]:
                    self.close(name)
                elif name in RAW and not m[3].endswith("/"):
                    stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(source, at)
                    at = stop.end() if stop else (end if name in ("script", "style") else at)
                    self.say(" ")
                else:
                    self.open(name, m[3])
            elif start + 1 < end and (source[start + 1].isalpha() or source[start + 1] == "/"):
                if tag is TAG and PLAIN_TAG.match(source, start):
                    tag = PLAIN_TAG  # a quote is never closed: from here on tags end at the next >
                    continue
                stop = source.find(">", start)
                at = end if stop < 0 else stop + 1
            else:
                self.say("<")
                at = start + 1
        self.flush()
        return self.blocks

    def say(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        if not self.parts:
            if not text.strip():
                return
            self.owner = self.here
        self.parts.append(text)
        if self.links:
            self.link_chars += len(text.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            block = self.owner
            while block.parent is not None and block.tag not in BLOCK:
                block = block.parent
            if text:
                linked = self.link_chars > LINK_SHARE * len(text)
                tags, up = ["a"] if linked else [], block
                while up is not None and up.tag:
                    tags.append(up.tag)
                    up = up.parent
                self.blocks.append(Block(block, "/".join(reversed(tags)), text, self.link_chars, self.owner.furniture, self.owner.by_name))
            self.parts = []
        self.link_chars, self.owner = 0, None

    def open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in BLOCK:
                self.flush()
            elif tag in ("br", "wbr"):
                self.say(" " if tag == "br" else "")
            return
        if tag in BLOCK:
            self.flush()
            self.pop_within(("p",), ("td", "th", "button", "caption"))
        if tag in CLOSES:
            names, scope = CLOSES[tag]
            self.flush()
            self.pop_within(tuple(names.split()), scope)
        key = (tag, attributes)
        if (said := self.known.get(key)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            said = self.known[key] = named_furniture(tag, attributes)
        up = self.here
        furniture, named, main = up.furniture, up.by_name, up.main
        # An article's own header holds its title.
        by_tag, by_name = said[0], bool(said[1] - {"header"} if main is not None else said[1])
        if tag in ("article", "main"):
            if not by_name:
                furniture, named = furniture and not named, False
        elif tag == "header" and main is None or by_tag:
            furniture, named = True, furniture and named or not furniture and tag == "form"
        if by_name and tag not in ("html", "body", "main") and not furniture:
            furniture, named = True, True
        made = Element(tag, up, furniture, named, main, up.depth + 1)
        if tag in ("article", "main") and not furniture:
            made.main = made
        self.here = made
        if tag == "a":
            self.links += 1

    def close(self, tag: str) -> None:
        if tag in BLOCK or tag == "p":
            self.flush()
        up = self.here
        while up is not None and up.tag != tag:
            if up.tag in ("td", "th", "table") and tag not in ("tr", "tbody", "thead", "tfoot", "table", "td", "th") and tag not in BLOCK:
                return
            up = up.parent
        if up is not None and up.parent is not None:
            self.pop_to(up)

    def pop_within(self, names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        up = self.here
        while up is not None and up.tag not in scope:
            if up.tag in names:
                self.pop_to(up)
                return
            if up.tag in BLOCK and "p" in names:
                return
            up = up.parent

    def pop_to(self, element: Element) -> None:
        up = self.here
        while True:
            if up.tag == "a":
                self.links -= 1
            if up is element:
                break
            up = up.parent
        self.here = element.parent


def content_paths(blocks: list[Block]) -> dict[str, bool]:
    """Whether each path's fused and smoothed ratio is over the page's threshold."""
    chars, marks, nodes = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        chars[b.path] += len(b.text)
        marks[b.path] += len(MARKS.findall(b.text))
        nodes[b.path] += 1
    text_ratio = [chars[b.path] / nodes[b.path] for b in blocks]
    mark_ratio = [marks[b.path] / nodes[b.path] for b in blocks]
    scores = defaultdict(float)
    for b, t, m in zip(blocks, smooth(text_ratio), smooth(mark_ratio), strict=True):
        b.fused = t * (1 + m)
        scores[b.path] += b.fused / nodes[b.path]
    least = SIGMAS * pstdev(scores.values()) if len(scores) > 1 else 0.0
    return {path: score >= least for path, score in scores.items()}


def smooth(values: list[float]) -> list[float]:
    padded = [values[0], *values, values[-1]]
    return [sum(w * padded[i + k] for k, w in enumerate(SMOOTH)) for i in range(len(values))]


def main_text(source: str | None, known: dict | None = None) -> str:
    """The main text of a page, blocks joined by an empty line; empty for a null page."""
    parsed = Page({} if known is None else known).parse(source or "")
    # Where names leave nothing, one of them was given to the page's whole body.
    found = [b for b in parsed if not b.furniture] or [b for b in parsed if b.named]
    if not found:
        return ""
    # Where the page marks its article, nothing outside can be content.
    blocks = [b for b in found if b.element.main is not None] or found
    good = content_paths(blocks)
    content = [b for b in blocks if good[b.path]] or blocks
    holder = common_holder(content)
    inside = [b for b in blocks if within(b.element, holder)]
    return "\n\n".join(b.text for b in inside if good[b.path] or not b.path.endswith("/a"))


def common_holder(blocks: list[Block]) -> Element:
    """The element that holds all of them: an article or main part if they are in one, else their lowest common one."""
    holder = blocks[0].element
    for b in blocks[1:]:
        other = b.element
        while holder is not other:
            if holder.depth >= other.depth:
                holder = holder.parent
            else:
                other = other.parent
    if holder.main is not None:
        return holder.main
    return holder.parent if holder.parent is not None and holder.tag not in ("body", "html", "") else holder


def within(element: Element | None, holder: Element) -> bool:
    while element is not None and element is not holder:
        element = element.parent
    return element is holder


def extract_text(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``df`` without its html and with the main text of each page; such a column is replaced.

    A page without text, an empty and a null one give an empty string.  Every input
    row gives one row, whatever its size; nothing is shuffled.
    """
    keep = [c for c in df.columns if c not in (html_col, out_col)]
    rows = df.select(*[df[c] for c in keep], df[html_col])
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [main_text(page, known) for page in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
