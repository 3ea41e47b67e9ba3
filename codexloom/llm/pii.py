"""Personal data: patterns, and a linear-chain conditional random field over word-shape features.

The patterns find emails, IP addresses, card numbers and phone numbers. The field adds names after a cue, spelled-out addresses
("anna at mail dot com"), secrets, and card and phone numbers that the patterns lose because other numbers stand beside them: it is trained on a small
labelled table by exact gradients, and decodes each line of a text by
Viterbi in numpy batches. A line in which the outside label leads everywhere by more than transitions can repay needs no decoding:
its best path is known.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrid import Words, buffers, slices, words
from .runtime import prepare

BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "contact", "secret", "number")
KINDS = BASE + ADDED

# ---- patterns ----------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a later start in a run of digits fails as its first does, so only the first is tried: long runs cost linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = int(x) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in BASE, then by start. Matches that fail a test are dropped."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and _luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


# ---- the field ---------------------------------------------------------------------------------------------------

#: The labelled table: words of a line, those of an entity between [kind and ].
LABELLED = """
Please write to [name Maria Lopez] before noon.
My name is [name John Smith] and this is my note.
His name is [name Peter Novak] of the old town.
Mr. [name Brown] came to the house with a letter.
Mrs. [name Anna Keller] sold it.
Dr. [name Weiss] is at the office today.
Signed: [name Clara Moreau]
Contact: [name Ivan Petrov], the owner of the shop.
name: [name Laura Bianchi]
Name: [name Karl Lange], born in the north.
She is [name Ruth Cohen] who wrote the report.
It is [name Omar Haddad] from the second floor.
He is [name Karl Braun] who built the house.
We met [name Robert Brown] yesterday at the station.
They met [name Lucia Romano] and her brother.
Dear [name Helen Clark], thank you for the letter.
dear [name Jonas Berg] we are glad to hear from you
you can reach me: [contact anna at mail dot com] or in the evening
mail [contact peter [at] example [dot] org] for more
contact: [contact maria.lopez (at) host (dot) net] today
write [contact info at shop dot com] and wait
mail [contact john at site dot net] now
or mail [contact eva at web dot info] soon
reach [contact paul.weber at server dot org] for help
send it to [contact office at firm dot com]
token = [secret "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"] and the rest
the password = [secret "hunter2-9f8e7d6c5b4a3928"] was lost
password: [secret Tr0ub4dor3x9k2q7]
api_key = [secret "sk-9a8b7c6d5e4f3a2b1c0d9e8f"]
secret: [secret 9f86d081884c7d659a2feaa0c55ad015]
key = [secret '0a1b2c3d4e5f60718293a4b5c6d7e8f9'] in the file
old### token = [secret "7c4a8d09ca3762af61e59520943dc26494f8941b"]### new
les token = [secret "da39a3ee5e6b4b0d3255bfef95601890afd80709"] sont là
call [number +1 (487) 555-7209 4736962573099581] now
is [number +1 (269) 555-3296 4524132264652876] and the
on [number +1 (855) 555-4208 4866351201689520] garden, is
was 97.51.17.173 [number 4880761348116108] the end
the [number 4451718024887799] 27.65.93.14 of it
of 38.253.197.126 [number 4880761348116108]
The card [number 4012888888881881] and the
[number +44 20 7946 0958] is the line
[number 4929348385146306] of it [number 4952935900253052]
it was [number +1 (017) 555-7713] then
[number +1 (487) 555-7209] is at hand, 97.51.17.173 as well
### [number 4785380592391139$$$] de,&&& garden lamp&&& 152.143.123.131
34@mail7.example.com at the end of it
The boat lay in the harbour all winter. Nobody used it.
Le chat dort sur la chaise, et les enfants jouent dans le jardin.
Der Hund liegt unter dem Tisch und die Katze sitzt auf dem Dach.
El perro duerme en la casa, y una niña canta para la gente.
THE STORE IS CLOSED!! COME BACK!! ON MONDAY!!
bread%%% and*** butter.%%% with salt&&& or jam$$$ an%%% apple###
lamp | chair | table | window | door
Paris, Lyon and Berlin are at the end of the road.
Chapter 12 of the book is at page 345, in 1998 and later.
The order 47853 was sent at 10.30 on Monday.
He was at the dot of the line and at rest.
It is the key of the door and the name of the rose.
The name of it is old. A token of the past was in it.
Licensed under CC BY-NC 4.0.
under the Apache License, Version 2.0 and the Public License
Copyright 2019 The Authors. All rights reserved.
the code 4a7f9b2c of the part is short
A contact of the two was made at once, and a secret was kept.
They write to the world at large. Please write soon.
Mr and Mrs of the house. Doctor and nurse.
Dear Sir, the key is under the mat.
www.example.com/index.html is at the top
We met at noon. It is late. Go to bed. To be is to do.
It is raining. In the garden. Of course. The end.
wind to. And. Rain is of. Snow to. Is. Sun and
at. at. at. at at. at at at at. at
stone stone stone stone at. stone at. the
At At At At At At At At At At At
Home homely homely homely homely homely homely homely homely homely
and and and and river river river river river river and and and and river
le le le le le pas pas pas pas pas pas pas pas pas pas
is is is is evening evening evening it it it morning morning morning
de de de de été été été été été été
a write. mail a letter to the shop when the others mail to it
one day to to to is. is. is. is. Every day.
He is Tired and it is Dark on Sunday to Rest of the Week.
It was to Paris and is. To. Be. Of Evenings at. The
The. And. Of is. To. In. A.
water is, The to, And is; On the to: the is: Often
at the dot of at dot at the dot com of it.
The key to Open Doors. It is So Far to Go.
The River Thames is to Greenwich and to Kent.
""".strip().splitlines()

_CUES = {
    1: ("name", "mr", "mrs", "ms", "dr", "signed", "contact", "write", "met", "dear"),
    2: ("at", "(at)", "[at]"),
    3: ("dot", "(dot)", "[dot]"),
    4: ("token", "password", "passwd", "secret", "api_key", "apikey", "key"),
    5: ("com", "org", "net", "edu", "info"),
    6: ("=", ":"),
    7: ("is", "to"),
}
_LABELS = ("", *ADDED)
#: Fields of a word's shape and how many values each has: letter case, digits, ending, length, quotes, cue, other symbols.
_FIELDS = (4, 4, 4, 4, 2, 8, 2)
_CODES = int(np.prod(_FIELDS))
_REACH = (-2, -1, 0, 1, 2)

_LOWER, _UPPER, _NUM, _QUOTE, _ODD = (1 << i for i in range(5))
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[0x80:] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _NUM
for _c in b"\"'":
    _CLASS[_c] = _QUOTE
for _c in b"@#$%&*|<>{}=/\\~^`_!?":
    _CLASS[_c] = _ODD
_END = np.zeros(256, np.uint8)
for _c in b".!?":
    _END[_c] = 1
for _c in b",;":
    _END[_c] = 2
for _c in b":=":
    _END[_c] = 3


def _word_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), folded=True).hashes[0]


@lru_cache(maxsize=1)
def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the cue words, sorted, with and without the marks that may end them; and each one's class."""
    rows = {}
    for k, names in _CUES.items():
        for name in names:
            for end in ("", ".", ":", ",", "=") if name.strip("=:") else ("",):
                rows[int(_word_hash(name + end))] = k
    keys = np.array(sorted(rows), np.uint64)
    return keys, np.array([rows[int(x)] for x in keys], np.int64)


def shapes(w: Words) -> np.ndarray:
    """The code of each word's shape."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[w.data]
    edges = np.empty(2 * n, np.int64)
    edges[0::2], edges[1::2] = w.start, w.end
    pad = np.append(kind, 0)
    any_ = np.bitwise_or.reduceat(pad, edges)[0::2]
    length = w.end - w.start
    numbers = np.append(0, np.cumsum(kind == _NUM))
    digits = numbers[w.end] - numbers[w.start]
    lower, upper = (any_ & _LOWER) > 0, (any_ & _UPPER) > 0
    starts_upper = kind[w.start] == _UPPER
    case = np.where(~lower & ~upper, 0, np.where(~upper, 1, np.where(lower & starts_upper, 2, 3)))
    some = digits > 0
    digit = np.where(~some, 0, np.where(digits >= length - 1, 2, np.where((length >= 16) & (digits >= 4), 3, 1)))
    end = _END[w.data[w.end - 1]].astype(np.int64)
    size = np.digitize(length, (3, 6, 13))
    keys, classes = _cue_table()
    at = np.minimum(np.searchsorted(keys, w.hashes), len(keys) - 1)
    cue = np.where(keys[at] == w.hashes, classes[at], 0)
    code = np.zeros(n, np.int64)
    for value, of in zip((case, digit, end, size, (any_ & _QUOTE) > 0, cue, (any_ & _ODD) > 0), _FIELDS, strict=True):
        code = code * of + value
    return code


@lru_cache(maxsize=1)
def _one_hot() -> np.ndarray:
    """For each code, its fields' indicators."""
    rest, parts = np.arange(_CODES), []
    for of in reversed(_FIELDS):
        parts.append(np.eye(of, dtype=np.float32)[rest % of])
        rest = rest // of
    return np.concatenate(parts[::-1], axis=1)


def _table_rows(lines: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shape codes and labels of each labelled line."""
    out = []
    for line in lines:
        text, labels, now = [], [], 0
        for word in line.split():
            opened = re.match(rf"\[({'|'.join(ADDED)})$", word)
            if opened:
                now = _LABELS.index(opened[1])
                continue
            closes = now and re.search(r"\][.,]?$", word) and word not in ("[at]", "[dot]")
            text.append(re.sub(r"\]([.,]?)$", r"\1", word) if closes else word)
            labels.append(now)
            if closes:
                now = 0
        raw = np.frombuffer(" ".join(text).encode(), np.uint8)
        out.append((shapes(words(raw, np.array([0, len(raw)]), folded=True)), np.array(labels)))
    return out


def _scores(codes: np.ndarray, table: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Emission scores of words whose line spans [first, last): a table row for each offset in reach; none beyond the line."""
    n = len(codes)
    at = np.arange(n)
    out = table[len(_REACH) // 2][codes].copy()
    for k, d in enumerate(_REACH):
        if d:
            ok = np.flatnonzero((at + d >= first) & (at + d < last))
            out[ok] += table[k][codes[ok + d]]
    return out


def train(lines: list[str] | None = None, steps: int = 400, rate: float = 0.2, decay: float = 0.003) -> tuple[np.ndarray, np.ndarray]:
    """Emission table (offset, code, label) and transitions of a field fitted to labelled lines.

    Exact log-likelihood gradients by forward and backward sums over all lines at once, with L2 and Adam.
    """
    rows = _table_rows(LABELLED if lines is None else lines)
    hot, k = _one_hot(), len(_LABELS)
    n, longest = len(rows), max(len(c) for c, _ in rows)
    x = np.zeros((n, longest, len(_REACH), hot.shape[1]))
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (codes, labels) in enumerate(rows):
        y[i, : len(codes)], mask[i, : len(codes)] = labels, True
        for j in range(len(codes)):
            for o, d in enumerate(_REACH):
                if 0 <= j + d < len(codes):
                    x[i, j, o] = hot[codes[j + d]]
    flat = x.reshape(n, longest, -1)
    theta = np.zeros(flat.shape[2] * k + k * k)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    truth = np.eye(k)[y] * mask[:, :, None]
    inner = mask[:, 1:]
    pairs = np.einsum("ntl,ntm->lm", truth[:, :-1] * inner[:, :, None], truth[:, 1:])
    for step in range(1, steps + 1):
        w, t = theta[: -k * k].reshape(-1, k), theta[-k * k :].reshape(k, k)
        e = flat @ w
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = e[:, 0]
        for j in range(1, longest):
            a = np.logaddexp.reduce(alpha[:, j - 1, :, None] + t, axis=1) + e[:, j]
            alpha[:, j] = np.where(mask[:, j, None], a, alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            b = np.logaddexp.reduce(t + (e[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
            beta[:, j] = np.where(mask[:, j + 1, None], b, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        edge = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * inner[:, :, None, None]
        grad = np.concatenate([np.tensordot(flat, truth - node, ((0, 1), (0, 1))).ravel(), (pairs - edge.sum((0, 1))).ravel()]) / n - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += rate * 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, t = theta[: -k * k].reshape(len(_REACH), -1, k), theta[-k * k :].reshape(k, k)
    return np.stack([hot @ w[o] for o in range(len(_REACH))]).astype(np.float32), t.astype(np.float32)


def viterbi(scores: np.ndarray, first: np.ndarray, size: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of sequences [first, first + size) of ``scores``, all decoded side by side."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0]) if len(size) else 0
    labels = np.zeros(len(scores), np.int8)
    back = np.zeros(scores.shape, np.int8)
    best = scores[first].copy()
    alive = [len(first)]
    for j in range(1, longest):
        n = int(np.searchsorted(-size, -j, "left"))  # sequences with more than j words
        alive.append(n)
        options = best[:n, :, None] + moves
        back[first[:n] + j] = options.argmax(1)
        best[:n] = options.max(1) + scores[first[:n] + j]
    now = best.argmax(1)
    for j in range(longest - 1, -1, -1):
        n = alive[j]
        labels[first[:n] + j] = now[:n]
        if j:
            now[:n] = np.take_along_axis(back[first[:n] + j], now[:n, None], 1)[:, 0]
    return labels


class Finder:
    """Finds base and added spans in many texts at once."""

    def __init__(self, table: np.ndarray, moves: np.ndarray):
        self.table, self.moves = table, moves
        self.margin = 2 * float(moves.max() - moves.min())

    def _labelled(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(text, label, byte ranges of the words) of each run of words that the field labels."""
        w = words(data, offsets, folded=True)
        n = len(w.start)
        if not n:
            return
        codes = shapes(w)
        breaks = np.append(0, np.cumsum(data == 10))
        new = np.ones(n, bool)
        new[1:] = breaks[w.start[1:]] != breaks[w.end[:-1]]
        new[w.first[:-1][w.first[:-1] < n]] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        line = np.cumsum(new) - 1
        scores = _scores(codes, self.table, begin[line], (begin + size)[line])
        lead = scores[:, 0] - scores[:, 1:].max(1)
        open_ = np.flatnonzero(np.minimum.reduceat(lead, begin) <= self.margin)
        if not len(open_):
            return
        labels = viterbi(scores, begin[open_], size[open_], self.moves)
        at = np.flatnonzero(labels)
        if not len(at):
            return
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(labels[at]) != 0) | new[at[1:]]) + 1
        for run in np.split(at, cut):
            a = int(w.start[run[0]])
            yield int(np.searchsorted(offsets, a, "right")) - 1, int(labels[run[0]]), list(zip(w.start[run].tolist(), w.end[run].tolist(), strict=True))

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[str, list, list]]:
        """Of each text: itself, its base spans and its added spans, which overlap no other: words of a run on base spans are left out."""
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        base = [base_spans(t) for t in texts]
        added: list[list] = [[] for _ in texts]
        for i, j in slices(offsets):
            a, b = int(offsets[i]), int(offsets[j])
            points, taken = None, {}
            for k, label, run in self._labelled(data[a:b], offsets[i : j + 1] - a):
                if points is None:  # code points before each byte of the slice
                    points = np.append(0, np.cumsum((data[a:b] & 0xC0) != 0x80))
                begin = int(points[offsets[i + k] - a])
                k += i
                if k not in taken:
                    taken[k] = _covered(base[k])
                starts, ends = taken[k]
                free: list[list[tuple[int, int]]] = [[]]
                for x, y in run:
                    x, y = int(points[x]) - begin, int(points[y]) - begin
                    at = bisect_left(starts, y) - 1
                    if at >= 0 and ends[at] > x:
                        free.append([])
                    else:
                        free[-1].append((x, y))
                for part in filter(None, free):
                    span = _tidied(_LABELS[label], texts[k], part[0][0], part[-1][1])
                    if span:
                        added[k].append(span)
        for spans in added:
            spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
        return list(zip(texts, base, added, strict=True))


def _covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans cover together, in order and apart."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _tidied(kind: str, text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The span without marks around it; None if nothing is left, or for numbers if neither a card nor a phone can be in it."""
    piece = text[start:end]
    start += len(piece) - len(piece.lstrip("\"'([:=") if kind != "number" else piece.lstrip("\"'[:="))
    end -= len(piece) - len(piece.rstrip("\"')].,;:!?#$%&*|"))
    if start >= end:
        return None
    if kind == "number":
        digits = [re.sub("[^0-9]", "", w) for w in text[start:end].split()]
        if not any(13 <= len(d) <= 19 and _luhn(d) for d in digits) and not (text[start] == "+" and 9 <= sum(map(len, digits)) <= 15):
            return None
    return kind, start, end


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by the kind that starts first."""
    out, at, last = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= last:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = last = max(last, b)
    return "".join([*out, text[at:]])


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """The field fitted to the labelled table; a fixed size."""
    return train()


def _found(table: np.ndarray, moves: np.ndarray, redacted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(table, moves)
        for batch in batches:
            rest, names = batch.columns[:-1], batch.schema.names[:-1]
            found = finder.find(*buffers(batch.column(batch.num_columns - 1)))
            if redacted:
                nulls = batch.column(batch.num_columns - 1).is_null().to_pylist()
                cols = [pa.array([None if no else redact(t, base + more) for no, (t, base, more) in zip(nulls, found, strict=True)], pa.string())]
                yield pa.RecordBatch.from_arrays([*rest, *cols], names=batch.schema.names)
                continue
            cols = [pa.array([sum(s[0] == k for s in base) for _, base, _ in found], pa.int64()) for k in BASE]
            cols.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for _, base, _ in found], pa.string()))
            cols.append(pa.array([joined(base + more) for _, base, more in found], pa.string()))
            yield pa.RecordBatch.from_arrays([*rest, *cols], names=[*names, *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row's whole text.

    The counts and the digest are of the patterns' spans; ``spans`` has the field's (name, contact, secret, number) after them. A null or
    empty text has none. Repeated rows give equal rows. An empty table gives no rows; other columns aren't read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_found(*model(), False), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets; ``chars_col``, if there, counts anew. Nulls stay; an
    empty table gives none; texts of any length are searched whole; no column's name can clash."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name can clash
    order = [c for c in plain.columns if c != f"c{at}"] + [f"c{at}"]
    out = plain.select(order).mapInArrow(_found(*model(), True), plain.select(order).schema)
    out = out.select(plain.columns).toDF(*docs.columns)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out
