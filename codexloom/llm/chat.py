r"""Chat formatting that survives a round trip.

A turn is rendered as ``### role: text</turn>\n``. A deterministic parser reads rendered turns back and undoes escapes; a turn
that doesn't come back identical is escaped (a backslash before each control string and each backslash) until it does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Control strings; the escape marks itself too.
_CONTROL = re.compile(r"\\|###|: |</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Turn:
    """A turn read back: its role and text, and where its text stands in what was parsed."""

    role: str
    text: str
    start: int
    end: int


def parse(rendered: str) -> list[Turn] | None:
    """The turns of a rendered text, or None where it doesn't follow the grammar."""
    out, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            return None
        role = _until(rendered, at + len(OPEN), MIDDLE)
        text = role and _until(rendered, role[1], CLOSE)
        if not role or not text:
            return None
        out.append(Turn(unescape(role[0]), unescape(text[0]), role[1], text[1] - len(CLOSE)))
        at = text[1]
    return out


def _until(text: str, at: int, mark: str) -> tuple[str, int] | None:
    """What stands before the first unescaped ``mark``, and the place after the mark."""
    begin = at
    while (found := text.find(mark, at)) >= 0:
        back = found
        while back > begin and text[back - 1] == "\\":
            back -= 1
        if (found - back) % 2 == 0:
            return text[begin:found], found + len(mark)
        at = found + 1
    return None


def render_turn(role: str, text: str) -> str:
    """The turn, escaped as far as its reparse needs; ValueError if no form is read back as it was, which no text is known to cause."""
    for names, texts in ((str, str), (str, escape), (escape, escape)):
        shown = f"{OPEN}{names(role)}{MIDDLE}{texts(text)}{CLOSE}"
        back = parse(shown)
        if back is not None and len(back) == 1 and (back[0].role, back[0].text) == (role, text):
            return shown
    raise ValueError(f"a turn of {len(text)} characters isn't read back")


@dataclass
class _Conversation:
    """Digests of one conversation, fed turn by turn, so that memory doesn't grow with it."""

    conv_id: int | None
    n: int = 0
    chars: int = 0
    loss: int = 0
    turns_sha: object = field(default_factory=hashlib.sha256)
    loss_sha: object = field(default_factory=hashlib.sha256)

    def feed(self, rendered: str) -> None:
        for turn in parse(rendered):
            self.n += 1
            self.turns_sha.update(f"{turn.role}\n{turn.text}\n".encode())
            if turn.role == LOSS_ROLE:
                masked = unescape(rendered[turn.start : turn.end])
                self.loss += len(masked)
                self.loss_sha.update(masked.encode())
        self.chars += len(rendered)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, r, strict=True)) for r in rows], schema=_DIGEST)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn; a conversation may span batches."""
    now: _Conversation | None = None
    for batch in batches:
        done = []
        for conv, rendered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if now is None or now.conv_id != conv:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv)
            now.feed(rendered)
        if done:
            yield _rows(done)
    if now is not None:
        yield _rows([now.row()])


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        shown = [render_turn(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
        spans = [parse(x)[0] for x in shown]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(shown, pa.string()), *(pa.array([getattr(t, k) if t.role == LOSS_ROLE else None for t in spans], pa.int64()) for k in ("start", "end"))],
            names=["conv_id", "turn", "rendered", "loss_start", "loss_end"],
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, rendered, and loss_start and loss_end: where the text that counts for the loss stands in ``rendered``.

    A conversation's formatted text is its turns' ``rendered`` one after another; a row a turn keeps a conversation of any length
    bounded in memory. Null roles and texts are empty.
    """
    prepare(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rendered, "conv_id long, turn long, rendered string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, parsed from ``rendered``.

    Turns are in the order of ``turn``, nulls first; ties by the rendered text. Rows whose conv_id is null are one conversation.
    An empty table gives no rows. Other columns aren't read.
    """
    prepare(formatted.sparkSession)
    rows = formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "rendered").select("conv_id", "rendered")
    return rows.mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
