"""Blocks of HTML pages, from the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

BLOCK_TAGS = ("h1", "h2", "h3", "h4", "p", "li", "figcaption", "table")
HIDDEN_TAGS = ("script", "style", "template", "noscript")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_APART = _CLOSES_P | {"caption", "dd", "dt", "figcaption", "li", "td", "th", "tr"}


class _Blocks(HTMLParser):
    """Each block tag with the text of all below it, in the order of their starts; a block within another repeats its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, list[str]]] = []  # tag, path, texts
        self.open: list[tuple[str, int | None]] = []  # tag, its place in found
        self.children = [0]
        self.hidden = 0

    def _path(self) -> str:
        return "/".join(map(str, self.children))

    def _blank(self) -> None:
        """What stands on either side isn't one word."""
        for _, at in self.open:
            if at is not None:
                self.found[at][2].append(" ")

    def _within_cell(self) -> list[str]:
        """Open tags since the last table cell: a paragraph outside of it isn't closed from within."""
        names = [t for t, _ in self.open]
        return names[max((k for k, t in enumerate(names) if t.lstrip("!") in ("td", "th", "table")), default=-1) + 1 :]

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P and "p" in self._within_cell():
            self.handle_endtag("p")
        if tag == "li" and any(t == "li" for t, _ in self.open) and [t for t, _ in self.open if t in ("li", "ul", "ol")][-1:] == ["li"]:
            self.handle_endtag("li")
        self.children[-1] += 1
        if tag in _VOID or tag in _APART:
            self._blank()
        if tag in _VOID:
            return
        at = None
        if tag in BLOCK_TAGS:
            at = len(self.found)
            self.found.append((tag, self._path(), []))
        names = dict(attrs)
        style = (names.get("style") or "").replace(" ", "").lower()
        if tag in HIDDEN_TAGS or "hidden" in names or "display:none" in style or "visibility:hidden" in style:
            self.hidden += 1
            tag = f"!{tag}"
        self.open.append((tag, at))
        self.children.append(0)

    def handle_endtag(self, tag):
        names = [t.lstrip("!") for t, _ in self.open]
        if tag not in names:
            return
        if tag in _APART:
            self._blank()
        while self.open:
            name, _ = self.open.pop()
            self.children.pop()
            if name.startswith("!"):
                self.hidden -= 1
            if name.lstrip("!") == tag:
                return

    def handle_data(self, data):
        if not self.hidden:
            for _, at in self.open:
                if at is not None:
                    self.found[at][2].append(data)


def blocks_of(page: str) -> list[tuple[str, str, str]]:
    """(tag, path, text) of a page's blocks that have text, however broken the page."""
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    out = ((tag, path, " ".join("".join(x).split())) for tag, path, x in parser.found)
    return [x for x in out if x[2]]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if found := blocks_of(source or ""):
                tags, paths, texts = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(tags), pa.int64()), pa.array(range(1, len(tags) + 1), pa.int64()), pa.array(tags), pa.array(paths), pa.array(texts)], names=["page_id", "ordinal", "tag", "dom_path", "text"])


def page_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """page_id, ordinal, tag, dom_path and text of each page's blocks in document order."""
    ship(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long"), F.col(html_col)).mapInArrow(_rows, "page_id long, ordinal long, tag string, dom_path string, text string")
