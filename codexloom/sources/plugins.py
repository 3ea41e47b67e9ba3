"""Readers that need libraries which may not be installed: PDF pages and text recognition."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Reader:
    """A reader of a format: the module it needs and a function from files (path, format, content) to blocks."""

    name: str
    needs: str | None
    read: Callable[[DataFrame], DataFrame]

    @property
    def available(self) -> bool:
        return self.needs is None or importlib.util.find_spec(self.needs) is not None


_READERS: dict[str, Reader] = {}


def register(kind: str, reader: Reader) -> None:
    _READERS[kind] = reader


def reader_of(kind: str) -> Reader:
    """The reader of a format; LookupError if there is none, RuntimeError if its library is missing."""
    if kind not in _READERS:
        raise LookupError(f"no reader for {kind}")
    found = _READERS[kind]
    if not found.available:
        raise RuntimeError(f"{found.name} needs {found.needs}")
    return found


def choose(modes: list[str]) -> str | None:
    """The first mode whose reader can run; None, the mock excepted, stands for no recognition."""
    return next((m for m in modes if m in _READERS and _READERS[m].available), None)


def pdf_blocks(files: DataFrame) -> DataFrame:
    """Blocks of PDF pages: path, page, ordinal, box and text, by PyMuPDF on the executors."""

    def run(batches):
        import fitz
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with fitz.open(stream=data, filetype="pdf") as doc:
                    for number, page in enumerate(doc, 1):
                        rows += [(path, number, i, list(b[:4]), b[4].strip()) for i, b in enumerate(page.get_text("blocks"), 1) if b[4].strip()]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["path", "page", "ordinal", "box", "text"])

    return files.where("format = 'pdf'").select("path", "content").mapInArrow(run, "path string, page long, ordinal long, box array<double>, text string")


def _register_own() -> None:
    from .archives import read_archives

    register("docx", Reader("docx", None, read_archives))
    register("epub", Reader("epub", None, read_archives))
    register("pdf", Reader("pdf", "fitz", pdf_blocks))


_register_own()
