"""BPE encoding and decoding with content-defined chunks.

A rolling hash over the last bytes cuts texts at places that their content alone decides, so shared passages give equal
chunks. A chunk is encoded once in each worker process that meets it (a bounded store holds chunks already seen). At a join of two chunks
the tokenizer encodes a window anew that reaches one whole piece (pre-token) beyond the broken ones on either side. The window's ids must
begin and end with what the chunks have for those pieces; then what lies between replaces the broken pieces. Where they don't agree, or a
chunk has too few pieces to compare, the two chunks are one and are encoded as one, until all joins agree or the text is one chunk.

A tokenizer that drops blanks and never joins words across them (:func:`blanks_part` tries it on all pairs of some words) has
words as pieces, and a new chunk's words are looked up in a store before the tokenizer is asked; a new chunk of any other tokenizer is
handed over whole. Words count on their own because whole chunks cost the library more time than there is: the README has the figures.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrid import _EXACT, buffers, slices
from .runtime import prepare

#: Bytes that the rolling hash sees, and the mean distance of cuts (a power of two).
SPAN = 8
MEAN_CHUNK = 2048
#: Bytes of text encoded at once.
TEXTS_BYTES = 2 << 20
#: Chunks, windows and words kept for reuse in one worker process.
STORE_CHUNKS = 4_000
STORE_WORDS = 250_000
#: Words whose pairs show whether blanks part a tokenizer's words.
_TRIED = ("a", "The", "don't", "'s", "it's", "naïve", "12", "3.5", "...", "-", "x_y", "élan", "中文", "!?", "é", "😀", "Straße", " ", "A1b2", "#tag")


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions just after which the rolling hash of the last SPAN bytes asks for a cut, never inside a character."""
    h = _EXACT[data]
    width = 1
    while width < SPAN:  # h becomes the sum over 2 * width bytes, older bytes shifted further
        wider = h.copy()
        wider[width:] += h[:-width] * np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64))
        h = wider
        width *= 2
    at = np.flatnonzero(h < np.uint64((1 << 64) // MEAN_CHUNK)) + 1
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer, without truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def blanks_part(tok) -> bool:
    """Whether a tokenizer drops blanks and encodes words on either side of one as it does alone; added tokens with blanks or that take
    blanks in speak against it."""
    added = tok.get_added_tokens_decoder().values()
    if any(t.content.split() != [t.content] or t.lstrip or t.rstrip or t.single_word for t in added):
        return False
    ids = lambda text: tok.encode(text, add_special_tokens=False).ids
    alone = {w: ids(w) for w in _TRIED}
    return all(ids(a + blank + b) == alone[a] + alone[b] for a in _TRIED for b in _TRIED for blank in (" ", "\n", " \t "))


class Generations(dict):
    """A bounded store: entries not met for a while go. Old and new entries are at most ``most`` each."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


Coded = tuple[bytes, str]  # ids as little-endian uint32, decoded text


@dataclass(slots=True)
class Chunk:
    """A chunk's encoding: its first and last pieces, which a join may break, and those between; ``head`` and ``tail`` are the bytes that a
    window takes of it, ``lead`` and ``trail`` the ids there that a window must agree with."""

    first: Coded
    inner: Coded
    last: Coded
    head: bytes
    tail: bytes
    lead: bytes
    trail: bytes


def _glued(parts: list[Coded]) -> Coded:
    return b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts if x[0]])


class ChunkedEncoder:
    """Encodes whole texts, as the tokenizer does alone, from chunks and windows."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.parted = blanks_part(self.tok)
        self.plain = self.tok.decoder is None  # decoded texts are then tokens with blanks between
        self.tokens = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())] if self.plain else None
        self.longest = max((len(t.content) for t in self.tok.get_added_tokens_decoder().values()), default=0)
        self.chunks, self.windows, self.words = Generations(STORE_CHUNKS), Generations(STORE_CHUNKS), Generations(STORE_WORDS)
        self.met = self.encoded = self.joins = self.grown = 0

    def _coded(self, ids: list[list[int]]) -> list[Coded]:
        tokens = self.tokens
        return [(array("I", i).tobytes(), " ".join([tokens[k] for k in i]) if tokens else "") for i in ids]

    def _encoded(self, texts: list[bytes]) -> list[Coded]:
        return self._coded([x.ids for x in self.tok.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)])

    def _whole(self, text: bytes) -> Chunk | Coded:
        """A chunk handed to the tokenizer as it is; without the parts of a Chunk if it has too few pieces for a join."""
        shown = text.decode()
        found = self.tok.encode(shown, add_special_tokens=False)
        ids, ends = found.ids, [e for _, e in found.offsets]
        words = found.word_ids
        new = [k for k in range(1, len(ids)) if words[k] is None or words[k] != words[k - 1]]
        edges = [0, *new, len(ids)]  # pieces: tokens from one edge to the next
        n = len(edges) - 1
        stop = [max(ends[edges[k] : edges[k + 1]]) for k in range(n)] if ids else []
        a = next((k for k in range(2, n) if stop[k - 1] >= self.longest), None)  # pieces 1..a-1 lead
        b = next((k for k in range(n - 2, 0, -1) if len(shown) - stop[k - 1] >= self.longest), None)  # pieces b..n-2 trail
        if n < 4 or a is None or b is None:
            return self._coded([ids])[0]
        first, inner, last, lead, trail = self._coded([ids[: edges[1]], ids[edges[1] : edges[n - 1]], ids[edges[n - 1] :], ids[edges[1] : edges[a]], ids[edges[b] : edges[n - 1]]])
        return Chunk(first, inner, last, shown[: stop[a - 1]].encode(), shown[stop[b - 1] :].encode(), lead[0], trail[0])

    def _from_words(self, fresh: dict[bytes, list[bytes]]) -> dict[bytes, Chunk | Coded]:
        """Chunks whose words are encoded each on its own, as blanks part them; only words that no store has go to the tokenizer."""
        words = {w: self.words[w] for w in set().union(*fresh.values())}
        if new := [w for w, x in words.items() if x is None]:
            for w, made in zip(new, self._encoded(new), strict=True):
                words[w] = made
                self.words.put(w, made)
        out: dict[bytes, Chunk | Coded] = {}
        for text, own in fresh.items():
            parts = [words[w] for w in own]
            if len(own) < 4:
                out[text] = _glued(parts)
                continue
            head, tail = text[: len(text) - len(text.split(None, 2)[2])], text[len(text.rsplit(None, 2)[0]) :]
            out[text] = Chunk(parts[0], _glued(parts[1:-1]), parts[-1], head, tail, parts[1][0], parts[-2][0])
        return out

    def _learn(self, texts: list[bytes], known: dict[bytes, Chunk | Coded]) -> None:
        """Put the chunks' encodings into ``known``, from the store or made."""
        self.met += len(texts)
        fresh = {}
        for text in texts:
            if text not in known and text not in fresh:
                if (was := self.chunks[text]) is not None:
                    known[text] = was
                else:
                    fresh[text] = text.split() if self.parted else []
        self.encoded += len(fresh)
        made = self._from_words(fresh) if self.parted else {text: self._whole(text) for text in fresh}
        for text, chunk in made.items():
            known[text] = chunk
            self.chunks.put(text, chunk)

    def _agree(self, joins: list[tuple[Chunk, Chunk]]) -> list[Coded | None]:
        """What stands between the inner pieces of two chunks, from a window over their join; None where the window's ids don't agree with both."""
        keys = [(a.tail + b.head, a.trail, b.lead) for a, b in joins]
        found = {key: self.windows[key] for key in keys}
        if new := [key for key, x in found.items() if x is None]:
            ids, between = [x.ids for x in self.tok.encode_batch_fast([w.decode() for w, _, _ in new], add_special_tokens=False)], []
            for (_, trail, lead), i in zip(new, ids, strict=True):
                raw, a, b = array("I", i).tobytes(), len(trail), len(lead)
                same = a and b and len(raw) >= a + b and raw.startswith(trail) and raw.endswith(lead)
                between.append(i[a // 4 : len(i) - b // 4] if same else None)
            coded = iter(self._coded([x for x in between if x is not None]))
            for key, x in zip(new, between, strict=True):
                found[key] = (next(coded) if x is not None else None,)
                self.windows.put(key, found[key])
        return [found[key][0] for key in keys]

    def encode(self, texts: list[bytes]) -> list[Coded]:
        """ids (little-endian uint32) and decoded text of each text."""
        known: dict[bytes, Chunk | Coded] = {}
        parts: list[list[bytes]] = []
        for text in texts:
            edges = [0, *cuts(np.frombuffer(text, np.uint8)).tolist(), len(text)] if text else []
            parts.append([text[a:b] for a, b in zip(edges, edges[1:], strict=False)])
        between: list[list[Coded]] = [[] for _ in texts]
        open_ = list(range(len(texts)))
        while open_:  # texts with joins that don't agree yet
            self._learn([c for i in open_ for c in parts[i]], known)
            joins = [(i, k) for i in open_ for k in range(len(parts[i]) - 1)]
            pairs = [(known[parts[i][k]], known[parts[i][k + 1]]) for i, k in joins]
            fit = [isinstance(a, Chunk) and isinstance(b, Chunk) for a, b in pairs]
            self.joins += len(pairs)
            windows = iter(self._agree([p for p, ok in zip(pairs, fit, strict=True) if ok]))
            got: dict[int, list[Coded | None]] = {i: [] for i in open_}
            for (i, _), ok in zip(joins, fit, strict=True):
                got[i].append(next(windows) if ok else None)
            still = []
            for i in open_:
                if None not in got[i]:
                    between[i] = got[i]
                    continue
                grown = parts[i][:1]
                for chunk, mid in zip(parts[i][1:], got[i], strict=True):
                    if mid is None:
                        grown[-1] += chunk
                        self.grown += 1
                    else:
                        grown.append(chunk)
                parts[i] = grown
                still.append(i)
            open_ = still
        out = []
        for own, mids in zip(parts, between, strict=True):
            chunks = [known[c] for c in own]
            if len(chunks) < 2:
                row = [x for c in chunks for x in ((c.first, c.inner, c.last) if isinstance(c, Chunk) else (c,))]
            else:
                row = [chunks[0].first, chunks[0].inner, *(x for c, mid in zip(chunks[1:], mids, strict=True) for x in (mid, c.inner)), chunks[-1].last]
            out.append(_glued(row))
        if not self.plain:
            decoded = self.tok.decode_batch([np.frombuffer(x, "<u4").tolist() for x, _ in out], skip_special_tokens=False)
            out = [(x, d) for (x, _), d in zip(out, decoded, strict=True)]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkedEncoder:
    """One encoder a worker process: tasks that follow each other there share its chunks."""
    return ChunkedEncoder(path)


def _encoded(path: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(path)
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            rest, names = batch.columns[:-1], batch.schema.names[:-1]
            for i, j in slices(offsets, TEXTS_BYTES):
                found = own_encoder.encode([data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)])
                own = [x.slice(i, j - i) for x in rest]
                if full:
                    ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in found], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*own, ids, pa.array([d for _, d in found], pa.string())], names=[*names, "ids", "decoded"])
                else:
                    counts = pa.array([len(x) // 4 for x, _ in found], pa.int64())
                    hexed = [pa.array([hashlib.sha256(y).hexdigest() for y in ys], pa.string()) for ys in ([x for x, _ in found], [d.encode() for _, d in found])]
                    yield pa.RecordBatch.from_arrays([*own, counts, *hexed], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of each row's whole text.

    A null or empty text has no ids. Repeated rows give equal rows; an empty table gives none; other columns aren't read, so their names
    can't clash. A text of any length is encoded whole.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_encoded(tokenizer_path, True), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; as :func:`encode`, in all cases it names, with digests taken where texts are encoded."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_encoded(tokenizer_path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
