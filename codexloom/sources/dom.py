"""Pages as ledgers of their visible nodes: where each stands in the tree, and what it stands in.

A page becomes a tree once, in an Arrow batch; everything that asks about ancestors (links, figures, tables, code, formulas, boxes, hidden
parts) is answered there and comes out as columns, so that later steps are joins and predicates.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import markup

# ---- fixed values: tags and their roles ----
HIDDEN_TAGS = ("script", "style", "template", "noscript", "head", "title")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "image")
CLOSES_P = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
CONTAINERS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption", "td", "th", "dt", "dd", "blockquote", "pre")
LANGUAGE = re.compile(r"(?:language-|lang-)([A-Za-z0-9_+-]+)")
CALLOUT_SOURCE = re.compile(r"callout", re.I)
# ---- end of fixed values ----

_CELL, _SPLIT = ("td", "th", "table"), {"li": ("li", ("ul", "ol")), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "tr": ("tr", ("table",)), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",))}


@dataclass(eq=False)
class Node:
    """An element, or a text if ``tag`` is empty."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    text: str = ""

    def ancestors(self) -> Iterator[Node]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent

    def nearest(self, *tags: str) -> Node | None:
        return next((a for a in self.ancestors() if a.tag in tags), None)

    def all(self, *tags: str) -> Iterator[Node]:
        for child in self.children:
            if not tags or child.tag in tags:
                yield child
            yield from child.all(*tags)

    def words(self) -> str:
        """The text below, white space as one blank."""
        return " ".join(" ".join(x.text for x in self.all("")).split())

    def raw(self) -> str:
        return self.text + "".join("\n" if x.tag == "br" else x.text for x in self.all())

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def path(self) -> list[int]:
        """Places among the siblings that aren't blank texts, from the root on."""
        out, at = [], self
        while at.parent is not None:
            real = [c for c in at.parent.children if c.tag or c.text.strip()]
            out.append(next(k for k, c in enumerate(real) if c is at))
            at = at.parent
        return out[::-1]

    def xml(self) -> str:
        if not self.tag:
            return entities.escape(self.text, quote=False)
        head = self.tag + "".join(f" {k}={quoteattr(v)}" for k, v in self.attrs.items())
        return f"<{head}/>" if not self.children else f"<{head}>{''.join(c.xml() for c in self.children)}</{self.tag}>"


class _Builder(HTMLParser):
    """A tree from markup, however broken: an end tag closes what it names, paragraphs and cells close where others begin, and never across
    the edge of a table cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def _close(self, tag: str, within: tuple[str, ...]) -> None:
        at = self.at
        while at is not self.root and at.tag != tag:
            if at.tag in within:
                return
            at = at.parent
        if at is not self.root:
            self.at = at.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close("p", _CELL)
        if tag in _SPLIT:
            self._close(*_SPLIT[tag])
            if tag in ("td", "th"):
                self._close("th" if tag == "td" else "td", ("tr", "table"))
            if tag in ("dt", "dd"):
                self._close("dd" if tag == "dt" else "dt", ("dl",))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        self._close(tag, ("table",) if tag not in ("table", "body", "html") else ())

    def handle_data(self, data):
        if self.at.children and not self.at.children[-1].tag:
            self.at.children[-1].text += data
        else:
            self.at.children.append(Node("", parent=self.at, text=data))


def tree(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def styled(root: Node, sheets: Iterable[str], hides: bool) -> set[int]:
    """Identities of elements that style hides (the attribute, inline style or a rule), or that it makes blocks."""
    inline = [s.raw() for s in root.all("style")]
    names = [s for css in (*sheets, *inline) for s in markup.selectors(css, hides)]
    found = set()
    for node in root.all():
        if not node.tag:
            continue
        style = (node.attrs.get("style") or "").replace(" ", "").lower()
        own = ("hidden" in node.attrs or "display:none" in style or "visibility:hidden" in style) if hides else "display:block" in style
        if own or any(markup.selects(s, node.tag, node.attrs) for s in names):
            found.add(id(node))
    return found


def is_callout(node: Node) -> bool:
    """An image that marks a place in code: in code, or named so by its class or source."""
    if node.tag not in ("img", "image"):
        return False
    named = CALLOUT_SOURCE.search(" ".join(node.classes())) or CALLOUT_SOURCE.search(node.attrs.get("src") or node.attrs.get("href") or "")
    return bool(named) or node.nearest("pre", "code") is not None


def visible(root: Node, hidden: set[int]) -> Iterator[Node]:
    """Texts that aren't blank, whole formulas and callout images of the body, in document order, but for what is hidden."""
    body = next(root.all("body"), root)

    def walk(node: Node) -> Iterator[Node]:
        for child in node.children:
            if child.tag in HIDDEN_TAGS or id(child) in hidden:
                continue
            if child.tag == "math" or is_callout(child) or (not child.tag and child.text.strip()):
                yield child
            elif child.tag:
                yield from walk(child)

    if not any(id(a) in hidden for a in (body, *body.ancestors())):
        yield from walk(body)


def container_text(node: Node, blocks: set[int]) -> str | None:
    """The text of the nearest container: line breaks as newlines, blocks on lines of their own, white space as one blank; in ``pre`` as it is."""
    box = next((a for a in (node, *node.ancestors()) if a.tag in CONTAINERS), None)
    if box is None:
        return None
    if box.tag == "pre":
        return box.raw()
    parts: list[str] = []

    def walk(at: Node) -> None:
        for c in at.children:
            if not c.tag:
                parts.append(re.sub(r"\s+", " ", c.text))
            elif c.tag == "br":
                parts.append("\n")
            elif c.tag not in HIDDEN_TAGS:
                apart = id(c) in blocks or c.tag in CONTAINERS
                parts.extend(["\n"] * apart)
                walk(c)
                parts.extend(["\n"] * apart)

    walk(box)
    lines = (re.sub(r" +", " ", x).strip() for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def code_language(pre: Node) -> str | None:
    """What a block of code says it is written in: by its attribute, else by a class of it or of the code inside."""
    code = next(pre.all("code"), None)
    names = [*pre.classes(), *(code.classes() if code else [])]
    return (pre.attrs.get("data-code-language") or "").strip() or next((m[1] for x in names if (m := LANGUAGE.search(x))), None)


def preformatted(pre: Node) -> str:
    """The text of a block of code; callout images read ``[[Callout n]]``."""
    out, n = [], 0
    for c in pre.all():
        if is_callout(c):
            n += 1
            out.append(f"[[Callout {(c.attrs.get('alt') or '').strip() or n}]]")
        else:
            out.append("\n" if c.tag == "br" else c.text)
    return "".join(out)


def _sha(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def _figure(node: Node) -> Node | None:
    return next((a for a in node.ancestors() if a.tag == "figure" or "figure" in a.classes() or a.attrs.get("epub:type") == "figure"), None)


def _caption(figure: Node) -> Node | None:
    return next((c for c in figure.all() if c.tag == "figcaption" or "caption" in c.classes()), None)


def _math(node: Node) -> str:
    try:
        return markup.linear_math(ElementTree.fromstring(node.xml()))
    except ElementTree.ParseError:
        return node.words()


_PATH = pa.list_(pa.int32())
_FIELDS: tuple[tuple[str, pa.DataType, str], ...] = (
    ("kind", pa.string(), "string"), ("dom_path", _PATH, "array<int>"), ("text", pa.string(), "string"), ("container_text", pa.string(), "string"), ("tag", pa.string(), "string"), ("ancestor_tags", pa.list_(pa.string()), "array<string>"),
    ("ancestor_ids", pa.list_(pa.string()), "array<string>"), ("container_types", pa.list_(pa.string()), "array<string>"), ("source_role", pa.string(), "string"), ("link_href", pa.string(), "string"), ("link_text", pa.string(), "string"),
    ("figure_path", _PATH, "array<int>"), ("figure_caption", pa.string(), "string"), ("table_path", _PATH, "array<int>"), ("table_caption", pa.string(), "string"), ("row_index", pa.int32(), "int"), ("cell_index", pa.int32(), "int"), ("cell_tag", pa.string(), "string"),
    ("rowspan", pa.string(), "string"), ("colspan", pa.string(), "string"), ("pre_path", _PATH, "array<int>"), ("pre_text_sha256", pa.string(), "string"), ("code_language", pa.string(), "string"), ("mathml_sha256", pa.string(), "string"), ("nav_type", pa.string(), "string"),
)


def node_row(node: Node, blocks: set[int]) -> dict:
    """What is known of a visible node, by the names of the ledger's columns."""
    up = list(node.ancestors())
    link, cell, pre, nav, figure = node.nearest("a"), node.nearest("td", "th"), node.nearest("pre"), node.nearest("nav"), _figure(node)
    table = node.nearest("table")
    row = cell.nearest("tr") if cell else None
    caption = _caption(figure) if figure else None
    title = next(table.all("caption"), None) if table else None
    kind = "math" if node.tag == "math" else "callout" if node.tag else "text"
    text = _math(node) if kind == "math" else f"[[Callout {(node.attrs.get('alt') or '').strip()}]]" if kind == "callout" else node.text.strip()
    types = [v for a in up for v in ((a.attrs.get("epub:type") or "").split() + ([a.attrs["data-type"]] if a.attrs.get("data-type") else []) + a.classes())]
    place = lambda items, item: next((k for k, x in enumerate(items) if x is item), None)
    return {
        "kind": kind, "dom_path": node.path(), "text": text, "container_text": container_text(node, blocks), "tag": node.tag or node.parent.tag, "ancestor_tags": [a.tag for a in up if a.tag], "ancestor_ids": [a.attrs["id"] for a in up if a.attrs.get("id")],
        "container_types": types, "source_role": "auxiliary_navigation" if nav else "code_callout" if kind == "callout" else "primary", "link_href": link.attrs.get("href") if link else None, "link_text": link.words() if link and link.attrs.get("href") else None,
        "figure_path": figure.path() if figure else None, "figure_caption": caption.words() if caption else None, "table_path": table.path() if table else None, "table_caption": title.words() if title else None,
        "row_index": place(list(table.all("tr")), row) if table and row else None, "cell_index": place([c for c in row.children if c.tag in ("td", "th")], cell) if row else None, "cell_tag": cell.tag if cell else None,
        "rowspan": cell.attrs.get("rowspan") or "1" if cell else None, "colspan": cell.attrs.get("colspan") or "1" if cell else None, "pre_path": pre.path() if pre else None, "pre_text_sha256": _sha(preformatted(pre)) if pre else None,
        "code_language": code_language(pre) if pre else None, "mathml_sha256": _sha(node.xml()) if kind == "math" else None, "nav_type": markup.nav_type(nav.attrs.get("epub:type") or nav.attrs.get("role")) if nav else None,
    }


def nodes_of(page: str, sheets: Iterable[str] = ()) -> list[dict]:
    """The rows of a page's visible nodes, in document order."""
    root, sheets = tree(page), list(sheets)
    hidden, blocks = styled(root, sheets, True), styled(root, sheets, False)
    return [node_row(n, blocks) for n in visible(root, hidden)]


#: Nodes of one Arrow batch.
_BATCH = 5000


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "ordinal", *(n for n, _, _ in _FIELDS), "error"]
    kinds = [pa.string(), pa.int64(), *(k for _, k, _ in _FIELDS), pa.string()]
    for batch in batches:
        for page, data, sheets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                found, error = nodes_of(markup.decode_markup(data or b""), sheets or ()), None
            except ValueError as e:
                found, error = [], f"{type(e).__name__}: {e}"
            rows = [(page, k, *(r[n] for n, _, _ in _FIELDS), None) for k, r in enumerate(found, 1)] or ([(page, None, *[None] * len(_FIELDS), error)] if error else [])
            for a in range(0, len(rows), _BATCH):
                cols = zip(*rows[a : a + _BATCH], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def dom_ledger(pages: DataFrame, id_col: str = "page_id", content_col: str = "content", sheets_col: str | None = None) -> DataFrame:
    """page_id, ordinal, the columns of :func:`node_row`, and error for a page whose encoding can't be read.

    ``content_col`` holds bytes, decoded by what they declare, or text. ``sheets_col``: an array of the style sheets that the page links. A page
    without visible nodes has no rows.
    """
    ship(pages.sparkSession)
    sheets = F.col(sheets_col) if sheets_col else F.lit(None)
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(content_col).cast("binary").alias("content"), sheets.cast("array<string>").alias("sheets"))
    return rows.mapInArrow(_rows, "page_id string, ordinal long, " + ", ".join(f"{n} {k}" for n, _, k in _FIELDS) + ", error string")


def navigation(ledger: DataFrame) -> DataFrame:
    """page_id, nav_type, ordinal, title and href of the entries of navigation lists: links with a text, each once."""
    own = ledger.where("nav_type is not null and link_href is not null").groupBy("page_id", "nav_type", "link_href", "link_text").agg(F.min("ordinal").alias("ordinal"))
    return own.select("page_id", "nav_type", "ordinal", F.col("link_text").alias("title"), F.col("link_href").alias("href"))


def figure_captions(ledger: DataFrame) -> DataFrame:
    """page_id, figure_path and caption of each figure: an aggregate over its nodes."""
    return ledger.where("figure_path is not null").groupBy("page_id", "figure_path").agg(F.max("figure_caption").alias("caption"))


def headings(ledger: DataFrame) -> DataFrame:
    """page_id, dom_path, level and text of headings, from the container text of their first node."""
    level = F.try_element_at(F.filter("ancestor_tags", lambda x: F.rlike(x, F.lit("^h[1-6]$"))), F.lit(1))
    rows = ledger.withColumn("level", F.substring(level, 2, 1).cast("int")).where("level is not null")
    first = rows.groupBy("page_id", "container_text", "level").agg(F.min_by("dom_path", "ordinal").alias("dom_path"))
    return first.select("page_id", "dom_path", "level", F.col("container_text").alias("text"))
