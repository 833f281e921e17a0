"""The main content of HTML pages, by text and link density over the tree of their blocks."""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIP = frozenset("script style nav header footer aside noscript form".split())
HEADINGS = frozenset("title h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body main article section div".split())
BREAKS = HEADINGS | CONTAINERS | frozenset("p br li ul ol dl dt dd tr table blockquote pre".split())

#: A block of so many characters is content if at most WORDY of them are in links.
LONG, WORDY = 80, 0.33
#: A block or table with more of its characters in links is a menu.
LINKED = 0.5
#: The main element is the deepest that holds this share of the page's content.
SHARE = 0.9


@dataclass(slots=True)
class Block:
    text: str
    solid: int  # characters that are no white space
    linked: int  # those of them in links
    element: int
    heading: bool
    table: int  # number of its outermost table, -1 outside

    @property
    def content(self) -> bool:
        return len(self.text) >= LONG and self.linked <= WORDY * self.solid


class _Reader(HTMLParser):
    """Cuts a page into blocks and keeps the tree of its containers: `above[e]` is the element around e, 0 the page."""

    def __init__(self) -> None:
        super().__init__()
        self.above, self.open = [0], [("", 0)]
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.solid = self.linked = self.skipped = self.links = self.tables = self.deep = self.depth = 0
        self.heading = self.paragraph = self.inner = False

    def cut(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if self.solid:
            self.blocks.append(Block(text, self.solid, self.linked, self.open[-1][1], self.heading, self.tables if self.deep else -1))
        self.pieces, self.solid, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIP:
            self.skipped += 1
        if tag in SKIP or tag in BREAKS:
            self.cut()
            self.paragraph = tag == "p"
        if tag in CONTAINERS:
            self.above.append(self.open[-1][1])
            self.open.append((tag, len(self.above) - 1))
        elif tag == "table":
            self.tables += self.deep == 0
            self.deep += 1
        elif tag in ("td", "th"):
            self.pieces.append(" | ")
        elif tag == "a":
            # It may hold whole blocks. One that nobody closed ends with its paragraph, item or element.
            self.links, self.inner, self.depth = 1, self.paragraph, len(self.open)
        if tag in BREAKS:
            self.heading = tag in HEADINGS

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIP or tag in BREAKS:
            self.cut()
            self.heading = False
        if tag in ("li", "tr", "table") or (tag == "p" and self.inner):
            self.links = 0
        if tag in SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "a":
            self.links = 0
        elif tag == "table":
            self.deep = max(0, self.deep - 1)
        elif tag in CONTAINERS and any(name == tag for name, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
            if len(self.open) < self.depth:
                self.links = 0

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.pieces.append(data)
            n = sum(map(len, data.split()))
            self.solid += n
            self.linked += n if self.links else 0


def main_element(above: list[int], blocks: list[Block]) -> set[int]:
    """The elements of the main one: it and what is in it."""
    held = [0] * len(above)
    for b in blocks:
        held[b.element] += b.solid if b.content else 0
    # An element comes behind the one around it.
    for e in range(len(above) - 1, 0, -1):
        held[above[e]] += held[e]
    main = max(e for e, n in enumerate(held) if n >= SHARE * held[0])
    inside = {main}
    for e in range(main + 1, len(above)):
        if above[e] in inside:
            inside.add(e)
    return inside


def page_content(html: str) -> str:
    """The page's blocks of content, one a line, table cells behind pipes.

    Navigation, scripts, forms, headers and footers go, to their end tag or the page's end; so does, outside of the main
    element, what is neither long, a heading nor in a table (notices, teasers); and everywhere a
    block, or a table as a whole, that is mostly links. A page without any content block
    keeps all that is not mostly links: nothing tells its content from the rest.
    """
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.cut()
    blocks = reader.blocks
    sums: dict[int, tuple[int, int]] = {}
    for b in blocks:
        solid, linked = sums.get(b.table, (0, 0))
        sums[b.table] = (solid + b.solid, linked + b.linked)
    menus = {t for t, (solid, linked) in sums.items() if linked > LINKED * solid}
    plain = [b for b in blocks if (b.table not in menus if b.table >= 0 else b.linked <= LINKED * b.solid)]
    if any(b.content for b in plain):
        inside = main_element(reader.above, plain)
        plain = [b for b in plain if b.element in inside or b.heading or b.table >= 0 or b.content]
    return "\n".join(b.text for b in plain)


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    """`page_content` of each page; null where the page is null, empty where it has no text."""
    return html.map(lambda h: page_content(h) if isinstance(h, str) else None)
