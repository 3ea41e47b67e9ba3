"""Documents in ZIP archives: safety checks, DOCX and EPUB by the standard library."""

from __future__ import annotations

import io
import lzma
import posixpath
import struct
import unicodedata
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .html import blocks_of
from .markup import decode_markup

# ---- fixed values: limits of an archive and of an XML part ----
MAX_ENTRIES = 20_000
MAX_TOTAL = 4 << 30
MAX_MEMBER = 1 << 30
MAX_RATIO = 1000
MAX_XML = 16 << 20
# ---- end of fixed values ----

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_OPF = "{http://www.idpf.org/2007/opf}"
_CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"


class UnsafeArchive(ValueError):
    """An archive or part that must not be read."""


def check_archive(archive: zipfile.ZipFile) -> None:
    """UnsafeArchive for too many, too large or too dense members, paths that leave the archive, links and names that collide."""
    infos = archive.infolist()
    if len(infos) > MAX_ENTRIES:
        raise UnsafeArchive("too many entries")
    if sum(i.file_size for i in infos) > MAX_TOTAL:
        raise UnsafeArchive("too large")
    for info in infos:
        parts = info.filename.replace("\\", "/").split("/")
        if not info.filename.strip("/"):
            raise UnsafeArchive("a member without a name")
        if info.file_size and not info.compress_size:
            raise UnsafeArchive(f"member without data: {info.filename}")
        if info.filename.startswith(("/", "\\")) or ".." in parts or (parts and ":" in parts[0]):
            raise UnsafeArchive(f"path leaves the archive: {info.filename}")
        if (info.external_attr >> 16) & 0o170000 == 0o120000:
            raise UnsafeArchive(f"link: {info.filename}")
        if info.file_size > MAX_MEMBER or info.file_size > MAX_RATIO * max(1, info.compress_size):
            raise UnsafeArchive(f"member too large: {info.filename}")
    key = lambda name: unicodedata.normalize("NFC", unicodedata.normalize("NFC", name).casefold())
    names = Counter(key(i.filename.rstrip("/")) for i in infos)
    if any(n > 1 for n in names.values()):
        raise UnsafeArchive("names collide")
    files = {key(i.filename) for i in infos if not i.is_dir()}
    if any("/".join(parts[:k]) in files for parts in (name.split("/") for name in names) for k in range(1, len(parts))):
        raise UnsafeArchive("a file is also a folder")


def safe_xml(data: bytes) -> ElementTree.Element:
    """The root of an XML part without document types and entities, in any encoding."""
    if len(data) > MAX_XML:
        raise UnsafeArchive("XML part too large")
    plain = data.replace(b"\0", b"").upper()
    if b"<!DOCTYPE" in plain or b"<!ENTITY" in plain:
        raise UnsafeArchive("XML part declares types or entities")
    return ElementTree.fromstring(data)


def docx_blocks(data: bytes) -> list[tuple[str, str, str]]:
    """(part, tag, text) of a DOCX: body, headers, footers, notes and comments; table cells as td; tracked deletions as del."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        check_archive(z)
        names = [n for n in z.namelist() if n.startswith("word/") and n.endswith(".xml") and posixpath.basename(n)[:-4].rstrip("0123456789") in ("document", "footnotes", "endnotes", "comments", "header", "footer")]
        for name in sorted(names, key=lambda n: (n != "word/document.xml", n)):
            root = safe_xml(z.read(name))
            cells = {p for cell in root.iter(f"{_W}tc") for p in cell.iter(f"{_W}p")}
            for p in root.iter(f"{_W}p"):
                style = p.find(f"{_W}pPr/{_W}pStyle")
                level = (style.get(f"{_W}val") or "") if style is not None else ""
                text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
                gone = "".join(t.text or "" for t in p.iter(f"{_W}delText"))
                tag = f"h{level[-1]}" if level.startswith("Heading") and level[-1:].isdigit() else "td" if p in cells else "p"
                out += [(name, t, x) for t, x in ((tag, text), ("del", gone)) if x.strip()]
    return out


def resolve(base: str, href: str) -> tuple[str, str | None, str | None]:
    """(status, path, fragment) of a reference from a member: local, external, or invalid where it leaves the archive."""
    parts = urlsplit(href)
    if parts.scheme or parts.netloc:
        return "external", None, None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(parts.path))) if parts.path else base
    if path.startswith(("../", "/")) or path == "..":
        return "invalid", None, None
    return "local", path, parts.fragment or None


def epub_blocks(data: bytes) -> list[tuple[str, str, str]]:
    """(member, tag, text) of an EPUB's spine in reading order."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        check_archive(z)
        roots = safe_xml(z.read("META-INF/container.xml")).findall(f".//{_CONTAINER}rootfile")
        if len(roots) != 1:
            raise UnsafeArchive("not exactly one package")
        opf = roots[0].get("full-path") or ""
        package = safe_xml(z.read(opf))
        manifest = {i.get("id"): i.get("href") or "" for i in package.iter(f"{_OPF}item")}
        for ref in package.iter(f"{_OPF}itemref"):
            if not manifest.get(ref.get("idref")):
                raise UnsafeArchive(f"the spine names no item: {ref.get('idref')}")
            status, path, _ = resolve(opf, manifest[ref.get("idref")])
            if status == "local" and path in z.NameToInfo:
                raw = z.read(path)
                safe = raw.replace(b"\0", b"").upper()
                if b"<!ENTITY" in safe:
                    raise UnsafeArchive(f"{path} declares entities")
                out += [(path, tag, text) for tag, _, text in blocks_of(decode_markup(raw))]
    return out


#: What a damaged, encrypted or oddly compressed file, an unknown encoding or an unsafe archive raises: one such file is one row with an error.
UNREADABLE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, ElementTree.ParseError, KeyError, RuntimeError, OSError, EOFError, struct.error, ValueError)

READERS = {"docx": docx_blocks, "epub": epub_blocks}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                rows = [(path, i, *r, None) for i, r in enumerate(READERS[kind](data or b""), 1)]
            except UNREADABLE as e:
                rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "ordinal", "part", "tag", "text", "error"])


def read_archives(files: DataFrame) -> DataFrame:
    """path, ordinal, part, tag, text of the DOCX and EPUB files of a corpus (path, format, content), or error for one that isn't read."""
    ship(files.sparkSession)
    own = files.where(F.col("format").isin(*READERS)).select("path", "format", "content")
    return own.mapInArrow(_read, "path string, ordinal long, part string, tag string, text string, error string")
