"""Markup as bytes and trees: encodings, style sheets, navigation types, mathematics."""

from __future__ import annotations

import codecs
import re
from xml.etree import ElementTree

_BOMS = ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_DECLARED = re.compile(rb"<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']")
_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?([A-Za-z0-9._-]+)", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_HIDES = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_BLOCK = re.compile(r"display\s*:\s*block", re.I)


def decode_markup(data: bytes) -> str:
    """Text of a page: by its byte-order mark, else its XML declaration, its meta tag, or as UTF-8. ValueError if that fails."""
    for mark, name in _BOMS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name)
    found = _DECLARED.search(data[:1024]) or _META.search(data[:4096])
    try:
        return data.decode(found[1].decode() if found else "utf-8")
    except LookupError as e:
        raise ValueError(f"unknown encoding {found[1]!r}") from e


def selectors(css: str, hides: bool = True) -> list[str]:
    """Selectors of a style sheet's rules that hide their elements, or make them blocks."""
    wanted = _HIDES if hides else _BLOCK
    return [s.strip() for heads, body in _RULE.findall(_COMMENT.sub("", css)) if wanted.search(body) for s in heads.split(",") if s.strip()]


def selects(selector: str, tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether a selector of one tag, classes and an id names an element; other selectors name none."""
    m = re.fullmatch(r"([A-Za-z][A-Za-z0-9]*|\*)?((?:[.#][A-Za-z_-][\w-]*)*)", selector)
    if not m or not m[0]:
        return False
    classes = (attrs.get("class") or "").split()
    parts = re.findall(r"([.#])([\w-]+)", m[2])
    return m[1] in (None, "*", tag) and all(x in classes if kind == "." else attrs.get("id") == x for kind, x in parts)


def nav_type(value: str | None) -> str:
    """What a navigation list is: toc before page-list before landmarks, else its first token."""
    tokens = (value or "").split()
    return next((t for t in ("toc", "page-list", "landmarks") if t in tokens), tokens[0] if tokens else "other")


def linear_math(node: ElementTree.Element) -> str:
    """MathML as one line: fractions, roots, scripts and fences in brackets where they need them."""
    name = node.tag.rpartition("}")[2]
    parts = [linear_math(c) for c in node]
    own = (node.text or "").strip()
    wrap = lambda x: x if len(x) <= 1 or re.fullmatch(r"[\w.]+|\(.*\)", x) else f"({x})"
    if name == "mfrac" and len(parts) == 2:
        return f"{wrap(parts[0])}/{wrap(parts[1])}"
    if name == "msqrt":
        return f"√({''.join(parts)})"
    if name == "mroot" and len(parts) == 2:
        return f"root({parts[1]}, {parts[0]})"
    if name in ("msup", "mover") and len(parts) == 2:
        return f"{wrap(parts[0])}^{wrap(parts[1])}"
    if name in ("msub", "munder") and len(parts) == 2:
        return f"{wrap(parts[0])}_{wrap(parts[1])}"
    if name in ("msubsup", "munderover") and len(parts) == 3:
        return f"{wrap(parts[0])}_{wrap(parts[1])}^{wrap(parts[2])}"
    if name == "mtable":
        return "[" + "; ".join(parts) + "]"
    if name == "mtr":
        return ", ".join(parts)
    if name in ("annotation", "annotation-xml"):
        return ""
    return own + "".join(parts)
