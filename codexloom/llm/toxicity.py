"""Toxicity of whole texts by a convolutional classifier, trained in numpy.

A word's embedding is the sum of hashed ones, of the word, its beginnings and its end; filters one, two and three words wide slide over the whole text, and the maximum of each is an input of
the last layer. Thresholds are calibrated by language, as guessed from the text's own function words: a score of 0.7 stands
for the language's threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrid import NOT_ALNUM, buffers, slices, words
from .runtime import prepare
from .sampling import crc_of, sample

BUCKETS = 1 << 17
EMBED = 8
#: Bytes of a word's beginnings and end that have embeddings beside the whole word's.
PREFIXES = (4, 6)
SUFFIX = 5
PARTS = 2 + len(PREFIXES)
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Most labelled rows that the classifier is fitted on, half of them toxic, and most bytes of their texts: they are gathered in the driver,
#: 16 bytes a word. So a text of the sample has at most SAMPLE_BYTES / SAMPLE bytes. Thresholds come from all rows and whole texts.
SAMPLE = 4000
SAMPLE_BYTES = 64 << 20
LONGEST = SAMPLE_BYTES // SAMPLE
#: Bins of a unit of the logit, and the highest logit with a bin of its own, for the counts that thresholds come from.
BINS = 256
HIGHEST = 500
PASS = 0.7
#: Batches of texts that the classifier is fitted with.
STEPS = 4000
#: Fewest positives of a language for a threshold of its own.
FEWEST = 30
#: Frequent function words, to guess the language that a threshold is for.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with was on are as by be this from or an at".split(),
    "fr": "le la les des et une du que qui dans pour sur pas par est au aux avec ce".split(),
    "de": "der die das und den von zu mit sich des auf für ist nicht ein eine als auch dem".split(),
    "es": "el los las que y del se por un una con para su al lo como más pero o".split(),
}
_LANGS = ["other", *FUNCTION_WORDS]


def _function_table() -> tuple[np.ndarray, np.ndarray]:
    rows: dict[int, set[int]] = {}
    for k, lang in enumerate(FUNCTION_WORDS, 1):
        raw = " ".join(FUNCTION_WORDS[lang]).encode()
        for h in words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), folded=True, apart=NOT_ALNUM).hashes.tolist():
            rows.setdefault(h, set()).add(k)
    keys = np.array(sorted(h for h, ks in rows.items() if len(ks) == 1), np.uint64)
    return keys, np.array([min(rows[int(h)]) for h in keys])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (never 0) of each word's parts, the first word of each text, and each text's guessed language."""
    w = words(data, offsets, folded=True, apart=NOT_ALNUM)
    parts = np.stack([w.hashes, *(w.prefix(k) for k in PREFIXES), w.suffix(SUFFIX)], axis=1)
    ids = (parts % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    keys, langs = _function_table()
    at = np.minimum(np.searchsorted(keys, w.hashes), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == w.hashes)
    n = len(offsets) - 1
    text = np.searchsorted(w.first, hit, "right") - 1
    counts = np.bincount(text * len(_LANGS) + langs[at[hit]], minlength=n * len(_LANGS)).reshape(n, len(_LANGS))
    return ids, w.first, counts.argmax(1)


def padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with blanks (bucket 0) after each text, where each text begins, and the places where no window begins."""
    more = max(WIDTHS)
    n = len(first) - 1
    start = first + more * np.arange(n + 1)
    out = np.zeros((start[-1], PARTS), np.int64)
    size = np.diff(first)
    out[np.arange(len(ids)) + more * np.repeat(np.arange(n), size)] = ids
    closed = np.ones(len(out), bool)
    closed[np.flatnonzero(out[:, 0])] = False
    closed[start[:-1]] = False  # a text without words has one window of blanks
    return out, start, closed


def _summed(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The sum of the rows of each word's parts."""
    out = rows[ids[:, 0]]
    for k in range(1, PARTS):
        out += rows[ids[:, k]]
    return out


_NO_WORDS = np.zeros((0, PARTS), np.int64)


@dataclass
class Network:
    embed: np.ndarray
    filters: list[np.ndarray]  # a width: (width, EMBED, FILTERS)
    shift: np.ndarray
    out: np.ndarray  # the last is the bias
    thresholds: np.ndarray  # of the logit, a language

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place, what each bucket adds to the filters there."""
        return [[(self.embed @ f[k]).astype(np.float32) for k in range(len(f))] for f in self.filters]

    def logits(self, ids: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        if len(first) == 1:
            return np.zeros(0)
        seq, start, closed = padded(ids, first)
        pooled = []
        for parts in tables:
            at = _summed(parts[0], seq)
            for k, part in enumerate(parts[1:], 1):
                at[:-k] += _summed(part, seq[k:])
            at[closed] = -np.inf
            pooled.append(np.maximum.reduceat(at, start[:-1]))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.shift, 0)
        return hidden @ self.out[:-1] + self.out[-1]

    def scores(self, logits: np.ndarray, langs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[langs] + np.log(PASS / (1 - PASS)), -500, 500)))


def fit(texts: list[np.ndarray], toxic: np.ndarray, steps: int = STEPS, batch: int = 32, rate: float = 0.1, decay: float = 1e-5) -> Network:
    """A network fitted to texts (arrays of buckets), half of each batch toxic, by gradients through each filter's best window;
    Adagrad with a fixed seed."""
    random = np.random.default_rng(3)
    n = FILTERS * len(WIDTHS)
    net = Network(random.normal(0, 0.1, (BUCKETS, EMBED)), [random.normal(0, 0.4, (w, EMBED, FILTERS)) for w in WIDTHS], np.zeros(n), np.append(random.normal(0, 0.3, n), 0.0), np.zeros(len(_LANGS)))
    net.embed[0] = 0
    seen = [np.full_like(p, 0.01) for p in (net.embed, *net.filters, net.shift, net.out)]
    seen[0][:] = 1e-4

    def step(p: np.ndarray, g: np.ndarray, s: np.ndarray, at=...) -> None:
        s[at] += g * g
        p[at] -= rate * g / np.sqrt(s[at])

    sides = [np.flatnonzero(toxic == k) for k in (0, 1)]
    for _ in range(steps if all(map(len, sides)) else 0):
        own = np.concatenate([random.choice(side, batch // 2) for side in sides])
        first = np.append(0, np.cumsum([len(texts[i]) for i in own]))
        seq, start, closed = padded(np.concatenate([_NO_WORDS, *(texts[i] for i in own)]), first)
        x = np.concatenate([_summed(net.embed, seq), np.zeros((max(WIDTHS), EMBED))])
        best, pooled = [], []
        for f in net.filters:
            at = sum(x[k : k + len(seq)] @ f[k] for k in range(len(f)))
            at[closed] = -np.inf
            top = np.stack([start[d] + at[start[d] : start[d + 1]].argmax(0) for d in range(len(own))])
            best.append(top)
            pooled.append(np.take_along_axis(at, top, 0))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + net.shift, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ net.out[:-1] + net.out[-1], -500, 500)))
        error = (p - toxic[own]) / len(own)
        back = np.where(hidden > 0, error[:, None] * net.out[:-1], 0)
        step(net.out, np.append(hidden.T @ error, error.sum()) + decay * net.out, seen[-1])
        step(net.shift, back.sum(0), seen[-2])
        change = np.zeros_like(x)
        for k, f in enumerate(net.filters):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad = np.zeros_like(f)
            for j in range(len(f)):
                grad[j] = np.einsum("dfe,df->ef", x[best[k] + j], g)
                np.add.at(change, best[k] + j, g[:, :, None] * f[j].T[None])
            step(f, grad + decay * f, seen[1 + k])
        rows = np.flatnonzero(change[: len(seq)].any(1) & (seq[:, 0] > 0))
        if len(rows):
            ids, place = np.unique(seq[rows].ravel(), return_inverse=True)
            total = np.zeros((len(ids), EMBED))
            np.add.at(total, place, np.repeat(change[rows], PARTS, axis=0))
            step(net.embed, total, seen[0], ids)
    net.embed = net.embed.astype(np.float32)
    return net


def calibrate(net: Network, bins: np.ndarray, langs: np.ndarray, toxic: np.ndarray, count: np.ndarray) -> None:
    """Set each language's threshold, and the common one where its positives are too few, from the number of rows in each bin of the
    logit: the cut of the best F1, in the middle of the gap to the next lower bin with rows."""
    hits = count * toxic

    def cut(at: np.ndarray) -> float:
        falling, place = np.unique(-bins[at], return_inverse=True)
        found = np.cumsum(np.bincount(place, hits[at]))
        f1 = 2 * found / (np.cumsum(np.bincount(place, count[at])) + found[-1])
        k = int(f1.argmax())
        below = 1 - falling[k + 1] if k + 1 < len(falling) else -falling[k] - 2 * BINS
        return float(below - falling[k]) / 2 / BINS

    if not hits.any():
        net.thresholds[:] = bins.max(initial=0) / BINS + 5
        return
    net.thresholds[:] = cut(np.arange(len(bins)))
    for k in range(len(_LANGS)):
        at = np.flatnonzero(langs == k)
        if hits[at].sum() >= FEWEST:
            net.thresholds[k] = cut(at)


def _logits(net: Network, tables: list[list[np.ndarray]], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The logit and the guessed language of each text."""
    logit, lang = np.zeros(len(column)), np.zeros(len(column), np.int64)
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        ids, first, lang[i:j] = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        logit[i:j] = net.logits(ids, first, tables)
    return logit, lang


def _binned(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            logit, lang = _logits(net, tables, batch.column(1))
            bins = np.floor(np.clip(logit, -HIGHEST, HIGHEST) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(bins)], names=["doc_id", "lang", "bin"])

    return run


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, first, langs = tokens(*buffers(batch.column(3)))
        rows = [ids[a:b].astype(np.uint32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(langs, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "part", "lang", "ids"])


def learn(docs: DataFrame, labels: DataFrame, total: int = SAMPLE) -> Network | None:
    """A network from a sample of the labelled rows whose crc32(doc_id) mod 3 isn't 1, a fifth of it left out of the fit, with
    thresholds from all those rows.

    A document labelled both ways counts as toxic. None without a labelled text.
    """
    prepare(docs.sparkSession)
    own = labels.where((crc_of("doc_id") % 3 != 1) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg((F.max("toxic") > 0).cast("int").alias("label_toxic"))
    chosen = sample(own, "label_toxic", "label_id", total)
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # at most about ``total`` rows
    part = F.xxhash64("label_id", F.lit(23)) % 5 == 0
    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label_toxic").alias("toxic"), part.alias("part"), "text").mapInArrow(_tokenised, "doc_id long, toxic int, part boolean, lang long, ids binary").toArrow()
    if not len(got):
        return None
    found = sorted(got.to_pylist(), key=lambda r: (r["doc_id"], r["ids"]))
    del got
    texts = [np.frombuffer(r.pop("ids"), np.uint32).reshape(-1, PARTS) for r in found]
    toxic, kept = (np.array([r[k] for r in found]) for k in ("toxic", "part"))
    fitted = np.flatnonzero(~kept)
    net = fit([texts[i] for i in fitted], toxic[fitted].astype(float))
    del found, texts
    rows = docs.where(crc_of("doc_id") % 3 != 1).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bins = rows.mapInArrow(_binned(net), "doc_id long, lang long, bin long").groupBy("doc_id", "lang", "bin").agg(F.count("*").alias("n"))
    counts = bins.join(own, F.col("doc_id") == F.col("label_id")).groupBy("bin", "lang", F.col("label_toxic").alias("toxic")).agg(F.sum("n").alias("n")).toArrow()
    calibrate(net, *(counts.column(k).to_numpy() for k in ("bin", "lang", "toxic", "n")))
    return net


def _scored(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            score = net.scores(*_logits(net, tables, batch.column(2))) if net else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= PASS).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score and predicted (score at least 0.7) of each row's whole text.

    Null and empty texts are scored as a text without words; all scores are 0 if nothing could be learned. A null id isn't held
    out and isn't learned from. Ties of cuts go to the higher one. Repeated rows give equal rows; an empty table gives none; other columns aren't
    read, and texts of any length are read whole.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_scored(net), "doc_id long, held_out boolean, score double, predicted int")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from ``docs`` and ``labels`` and score each of ``docs``."""
    return score(docs, learn(docs, labels))
