"""HTML read by a parser, for markup that no pattern reads right: broken nesting, quotes in
attributes, tags of any length, character references.

Texts go to Python in Arrow batches; callers pass null for texts that hold no tag of interest."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalogues as cat

#: Elements that never have content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not text of the page.
_SILENT = frozenset(("script", "style", "template"))


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            target = next((value for name, value in attrs if name == "href"), None)
            if target is not None:
                self.found.append(target)

    handle_startendtag = handle_starttag


class _Elements(HTMLParser):
    """Text of the wanted elements, in the order they open.  An end tag closes all that is open
    inside its element; what is never closed ends with the text."""

    def __init__(self, wanted):
        super().__init__()
        self.wanted = wanted
        self.open: list[tuple[str, list[str] | None]] = []
        self.found: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        pieces = [] if tag in self.wanted else None
        if pieces is not None:
            self.found.append(pieces)
        self.open.append((tag, pieces))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        piece = data.strip()
        if piece and not (self.open and self.open[-1][0] in _SILENT):
            for _, pieces in self.open:
                if pieces is not None:
                    pieces.append(piece)


_STRINGS = T.ArrayType(T.StringType())


def read_anchors(html: str | None) -> list[str] | None:
    """Targets of all anchors that have one, in page order; an empty attribute is an empty target."""
    if html is None:
        return None
    parser = _Anchors()
    parser.feed(html)
    parser.close()
    return parser.found


def read_elements(text: str | None, wanted=cat.PROMPT_ELEMENTS) -> list[str] | None:
    """Text of each wanted element, its pieces stripped and joined without separator."""
    if text is None:
        return None
    parser = _Elements(frozenset(wanted))
    parser.feed(text)
    parser.close()
    return ["".join(pieces) for pieces in parser.found]


@F.arrow_udf(_STRINGS)
def _anchors(html: pa.Array) -> pa.Array:
    return pa.array([read_anchors(x.as_py()) for x in html], pa.list_(pa.string()))


@F.arrow_udf(_STRINGS)
def _elements(text: pa.Array) -> pa.Array:
    return pa.array([read_elements(x.as_py()) for x in text], pa.list_(pa.string()))


def anchor_targets(html: str) -> Column:
    held = F.expr(f"CASE WHEN contains(lower({html}), '<a') THEN {html} END")
    return F.coalesce(_anchors(held), F.array().cast("array<string>"))


def element_texts(text: Column) -> Column:
    """Texts of the prompt elements; empty for a null text."""
    return F.coalesce(_elements(text), F.array().cast("array<string>"))
