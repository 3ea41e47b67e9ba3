"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from.

A response record is parsed from its bytes, its digests checked, and two records derived: ``metadata`` (what the source's headers
and page say) and ``conversion`` (the page as plain text). Both name the response in WARC-Refers-To, keep its target and date, and
carry the source's payload digest beside their own. The page is what the body holds once its transfer and content codings are undone and its
bytes are read in the charset that the headers or the page declare. Files of many records, plain or gzip, are read and written here, too.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

VERSION = "WARC/1.1"
CRLF = b"\r\n"
#: The date of records made from pages that have none.
NO_DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs


class WarcError(ValueError):
    """A record that doesn't follow the format or its own digests."""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An id that follows from the record's content and place alone, so that reruns agree."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def header_lines(head: bytes) -> list[tuple[str, str]]:
    """Names and values of a header's lines, all of them and in order; a line that begins with a blank goes on with the value before."""
    out: list[tuple[str, str]] = []
    for line in re.split(rb"\r?\n", head):
        text = line.decode("utf-8", "surrogateescape")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}".strip())
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


@dataclass
class Record:
    fields: list[tuple[str, str]]
    block: bytes

    def all(self, name: str) -> list[str]:
        return [v for k, v in self.fields if k.lower() == name.lower()]

    def __getitem__(self, name: str) -> str:
        return next(iter(self.all(name)), "")


def _field(value: str) -> str:
    """A header's value: one line."""
    return " ".join(value.split())


def serialize(headers: dict[str, str], block: bytes) -> bytes:
    """A record: its headers, the block's digest and length, and the block."""
    own = headers | {"WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    lines = [VERSION.encode(), *(f"{k}: {_field(v)}".encode("utf-8", "surrogateescape") for k, v in own.items() if v)]
    return CRLF.join([*lines, b"", block, b"", b""])


def _record(data: bytes, start: int) -> tuple[Record, int]:
    """The record that begins at ``start`` and where it ends; WarcError if it is cut short or damaged."""
    end = data.find(CRLF * 2, start)
    first = data.find(CRLF, start)
    if end < 0 or not data.startswith(b"WARC/", start):
        raise WarcError("no record header")
    record = Record(header_lines(data[first + 2 : end]), b"")
    try:
        size = int(record["Content-Length"])
    except ValueError as e:
        raise WarcError("no length") from e
    at = end + 4
    if size < 0 or data[at + size : at + size + 4] != CRLF * 2:
        raise WarcError("wrong length")
    record.block = data[at : at + size]
    for name, own in (("WARC-Block-Digest", digest(record.block)),):
        if record[name].startswith("sha1:") and record[name] != own:
            raise WarcError("wrong block digest")
    return record, at + size + 4


def parse(data: bytes) -> Record:
    """The one record that ``data`` holds; WarcError if it is cut short, damaged, or followed by more."""
    record, end = _record(data, 0)
    if end != len(data):
        raise WarcError("wrong length")
    return record


def records(data: bytes) -> Iterator[bytes]:
    """The records of a file, plain or of gzip members, as they stand in it."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        _, end = _record(data, at)
        yield data[at:end]
        at = end


def joined(parts: list[bytes], zipped: bool = True) -> bytes:
    """A file of records, each a gzip member of its own, as readers that seek expect; the same bytes for the same records."""
    return b"".join(gzip.compress(x, mtime=0) if zipped else x for x in parts)


def response(page_id: int | None, url: str | None, html: str | None, date: str = NO_DATE) -> bytes:
    """A response record for a page as served; nulls are empty."""
    body = (html or "").encode()
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}".encode(), b"", body])
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", str(page_id), url or "", digest(body)), "WARC-Date": date, "WARC-Target-URI": url or "", "WARC-Payload-Digest": digest(body), "Content-Type": "application/http; msgtype=response"}
    return serialize(headers, block)


_HIDDEN = {"script", "style", "noscript", "template", "head"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}


class _Text(HTMLParser):
    """Visible text with a line for each block; title, language and links on the side."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list[str]] = [[]]
        self.title: list[str] = []
        self.links: list[str] = []
        self.lang = ""
        self.hidden = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        elif tag in _HIDDEN and tag != "head":
            self.hidden += 1
        if tag in _BLOCKS:
            self.lines.append([])
        for name, value in attrs:
            if tag == "a" and name == "href" and value:
                self.links.append(value)
            elif tag == "html" and name == "lang" and value:
                self.lang = value

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in _HIDDEN and tag != "head":
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCKS:
            self.lines.append([])

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.lines[-1].append(data)


_DECLARED = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9._:-]+)|<\?xml[^>]+encoding\s*=\s*["']([A-Za-z0-9._:-]+)""", re.I)
#: Most bytes that a body may grow to when its codings are undone, and the most times its size.
MOST_DECODED, MOST_RATIO = 256 << 20, 2000


def _inflated(data: bytes, bits: int) -> bytes:
    limit = min(MOST_DECODED, MOST_RATIO * max(1, len(data)))
    out = b""
    while data:  # members of gzip follow each other
        one = zlib.decompressobj(bits)
        out += one.decompress(data, limit + 1 - len(out))
        if len(out) > limit:
            raise WarcError("coded body too large")
        if not one.eof:
            raise WarcError("coded body cut short")
        data = one.unused_data
    return out


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise WarcError("wrong chunk")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if data[end + 2 + n : end + 4 + n] != CRLF:
            raise WarcError("wrong chunk")
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n


def decoded_body(http: Record) -> bytes:
    """A body without its transfer and content codings; WarcError for one that is damaged or of an unknown kind."""
    body = http.block
    codings = [c.strip().lower() for name in ("Content-Encoding", "Transfer-Encoding") for v in http.all(name) for c in v.split(",") if c.strip()]
    for coding in reversed(codings):
        try:
            if coding == "chunked":
                body = _unchunked(body)
            elif coding in ("gzip", "x-gzip"):
                body = _inflated(body, 31)
            elif coding == "deflate":
                body = _inflated(body, 15 if body[:1] and body[0] & 15 == 8 and int.from_bytes(body[:2]) % 31 == 0 else -15)
            elif coding != "identity":
                raise WarcError(f"unknown coding {coding}")
        except zlib.error as e:
            raise WarcError(f"damaged {coding}") from e
    return body


def page_markup(http: Record) -> str:
    """A body as text: by its byte-order mark, else the headers' charset, the page's own, or UTF-8; what can't be read is U+FFFD."""
    body = decoded_body(http)
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    stated = re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", http["Content-Type"], re.I)
    found = _DECLARED.search(body[:4096])
    for name in (stated[1] if stated else None, (found[1] or found[2]).decode() if found else None):
        if name:
            try:
                return body.decode(name, "replace")
            except LookupError:  # unknown, or no charset
                continue
    return body.decode("utf-8", "replace")


def page_text(html: str) -> tuple[str, str, str, list[str]]:
    """Plain text, title, language and links of a page, however broken."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join("".join(x).split()) for x in parser.lines)
    return "\n".join(x for x in lines if x), " ".join("".join(parser.title).split()), parser.lang, parser.links


@dataclass
class Derived:
    source: Record
    metadata: bytes
    conversion: bytes
    text: str
    n_links: int


def derive(data: bytes) -> Derived:
    """The metadata and conversion records of one response record."""
    source = parse(data)
    if source["WARC-Type"] != "response":
        raise WarcError("not a response")
    head, mark, body = source.block.partition(CRLF * 2)
    if not mark:
        raise WarcError("no HTTP header")
    if source["WARC-Payload-Digest"] not in ("", digest(body)):
        raise WarcError("wrong payload digest")
    first, _, lines = head.partition(CRLF)
    http = Record(header_lines(lines), body)
    text, title, lang, links = page_text(page_markup(http))
    common = {"WARC-Date": source["WARC-Date"], "WARC-Target-URI": source["WARC-Target-URI"], "WARC-Refers-To": source["WARC-Record-ID"], "WARC-Refers-To-Target-URI": source["WARC-Target-URI"], "WARC-Refers-To-Date": source["WARC-Date"]}
    fields = [("source-status", first.decode("latin-1")), *(("source-" + k.lower(), v) for k, v in http.fields if v), ("source-payload-digest", digest(body)), ("title", title), ("language", lang), *(("outlink", x) for x in links)]
    block = b"".join(f"{k}: {_field(v)}".encode("utf-8", "surrogateescape") + CRLF for k, v in fields if v)
    metadata = serialize({"WARC-Type": "metadata", "WARC-Record-ID": record_id("metadata", source["WARC-Record-ID"]), **common, "Content-Type": "application/warc-fields"}, block)
    plain = text.encode()
    conversion = serialize({"WARC-Type": "conversion", "WARC-Record-ID": record_id("conversion", source["WARC-Record-ID"]), **common, "WARC-Source-Payload-Digest": digest(body), "WARC-Payload-Digest": digest(plain), "Content-Type": "text/plain; charset=utf-8"}, plain)
    return Derived(source, metadata, conversion, text, len(links))


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [response(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])


def responses(pages: DataFrame) -> DataFrame:
    """page_id and record: a response record of each page (page_id, url, html). Nulls are empty; repeated rows give equal records; an empty table gives
    none; pages of any length are whole; other columns aren't read."""
    prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_responses, "page_id long, record binary")


_DERIVED = "page_id long, metadata binary, conversion binary, error string"
_REPORT = (
    ("page_id", pa.int64()), ("response_id", pa.string()), ("target_uri", pa.string()), ("source_digest", pa.string()), ("metadata_id", pa.string()), ("metadata_refers_to", pa.string()), ("metadata_bytes", pa.int64()),
    ("conversion_id", pa.string()), ("conversion_refers_to", pa.string()), ("conversion_digest", pa.string()), ("conversion_bytes", pa.int64()), ("text_chars", pa.int64()), ("text_sha256", pa.string()), ("n_links", pa.int64()),
)


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column(1).to_pylist():
            try:
                d = derive(data or b"")
                rows.append((d.metadata, d.conversion, None))
            except (WarcError, UnicodeDecodeError) as e:
                rows.append((None, None, str(e)))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.string())], names=["page_id", "metadata", "conversion", "error"])


def derivatives(records: DataFrame) -> DataFrame:
    """page_id, metadata and conversion (bytes of the derived records) and error (null, or why a record gave none), a row a record (page_id, record).

    A null record is a damaged one. Repeated rows give equal rows; an empty table gives none; other columns aren't read.
    """
    prepare(records.sparkSession)
    return records.select("page_id", "record").mapInArrow(_derived, _DERIVED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, meta, conv in zip(*(batch.column(k).to_pylist() for k in ("page_id", "metadata", "conversion")), strict=True):
            if meta is None:
                rows.append((page, *[None] * (len(_REPORT) - 1)))
                continue
            m, c = parse(meta), parse(conv)
            text = c.block.decode()
            rows.append((page, c["WARC-Refers-To"], c["WARC-Target-URI"], c["WARC-Source-Payload-Digest"], m["WARC-Record-ID"], m["WARC-Refers-To"], len(meta), c["WARC-Record-ID"], c["WARC-Refers-To"], c["WARC-Payload-Digest"], len(conv), len(text), hashlib.sha256(c.block).hexdigest(), len(Record(header_lines(m.block), b"").all("outlink"))))
        cols = list(zip(*rows, strict=True)) or [()] * len(_REPORT)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, _REPORT, strict=True)], names=[n for n, _ in _REPORT])


def derivative_report(pages: DataFrame) -> DataFrame:
    """What the derived records of ``pages`` say, parsed from their bytes: ids, links, digests and sizes, a row a page; as in :func:`responses` for
    nulls, repeated rows and empty tables."""
    kinds = {pa.int64(): "long", pa.string(): "string"}
    return derivatives(responses(pages)).select("page_id", "metadata", "conversion").mapInArrow(_read, ", ".join(f"{n} {kinds[k]}" for n, k in _REPORT))


def _from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"path": pa.string(), "place": pa.int64(), "type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "record": pa.binary(), "error": pa.string()}
    for batch in batches:
        for path, data in zip(*(batch.column(k).to_pylist() for k in ("path", "content")), strict=True):
            place, found = 0, records(data or b"")
            while True:
                place += 1
                try:
                    raw = next(found, None)
                    if raw is None:
                        break
                    own, _ = _record(raw, 0)
                    row = (path, place, own["WARC-Type"], own["WARC-Record-ID"], own["WARC-Target-URI"], raw, None)
                except (WarcError, OSError, EOFError, zlib.error) as e:
                    row = (path, place, None, None, None, None, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds.values(), strict=True)], names=list(kinds))
                if row[-1]:
                    break


def read_files(files: DataFrame) -> DataFrame:
    """path, place, type, record_id, target_uri, record and error of each record of files (path, content), such as ``binaryFile`` reads them.

    Records before a damaged place are read; that place is a row with an error, and the file ends there. An empty file has no rows.
    """
    prepare(files.sparkSession)
    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(_from_files, "path string, place long, type string, record_id string, target_uri string, record binary, error string")


def _to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [x for x in batch.column("record").to_pylist() if x is not None]
        if parts:
            data = joined(parts)
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()]), pa.array([len(parts)], pa.int64()), pa.array([data], pa.binary())], names=["name", "n_records", "content"])


def file_contents(rows: DataFrame) -> DataFrame:
    """name (a digest), n_records and content of gzip files over records (record): one for each Arrow batch, so that no task holds more than a batch.

    Null records are left out. Equal batches give equal files, so a task that runs again writes nothing new.
    """
    prepare(rows.sparkSession)
    return rows.select("record").mapInArrow(_to_files, "name string, n_records long, content binary")
