"""Language of whole texts: family first, then one-versus-one linear support vector machines within the family.

Features are square roots of the relative frequencies of hashed byte trigrams of the whole text. Machines are trained in numpy by
dual coordinate descent on a bounded sample of labelled rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrid import buffers, slices
from .runtime import prepare
from .sampling import crc_of, sample

WIDTH = 2048
#: Most labelled rows that the machines are fitted on, over all languages.
SAMPLE = 3000
UNKNOWN = "und"
#: Closely related languages by family; a language of none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "sinitic": ("zh", "yue"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row a text: square roots of the shares of its hashed trigrams; zeros for texts under three bytes."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    for i, j in slices(offsets):
        a, b = offsets[i], offsets[j]
        x = _FOLD[data[a:b]]
        if len(x) < 3:
            continue
        gram = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        bucket = (gram >> np.uint32(32 - 11)).astype(np.int64)
        ends = offsets[i + 1 : j + 1] - a
        inside = np.ones(len(bucket), bool)
        for back in (1, 2):
            cut = ends - back
            inside[cut[(cut >= 0) & (cut < len(bucket))]] = False
        text = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))[: len(bucket)]
        counts = np.bincount(text[inside] * WIDTH + bucket[inside], minlength=(j - i) * WIDTH).reshape(j - i, WIDTH)
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        out[i:j] = np.sqrt(counts / total)
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    seen = np.append(0, np.cumsum(_LETTER[data]))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        if offsets[i] < offsets[i + 1]:
            out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss; y is 1 or -1."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = (x * x).sum(1) + 0.5 / cost
    order, random = np.arange(len(x)), np.random.default_rng(5)
    for _ in range(epochs):
        random.shuffle(order)
        most = 0.0
        for i in order.tolist():
            gradient = y[i] * (w @ x[i]) - 1 + a[i] * 0.5 / cost
            step = max(a[i] - gradient / diagonal[i], 0.0) - a[i]
            if step:
                a[i] += step
                w += step * y[i] * x[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w.astype(np.float32)


@dataclass
class Model:
    """Languages by family and a machine for each pair of families and each pair of languages of one."""

    families: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray]

    def _duel(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The winner's index and its confidence: machines vote with a logistic of their margins."""
        votes = np.zeros((len(x), len(names)))
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            w = self.machines[a, b]
            p = 1 / (1 + np.exp(-np.clip(3.0 * (x @ w[:-1] + w[-1]), -60, 60)))
            votes[:, i] += p
            votes[:, j] += 1 - p
        return votes.argmax(1), votes.max(1) / max(1, len(names) - 1) if len(names) > 1 else np.ones(len(x))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = sorted(self.families)
        family, sure = self._duel(x, names)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for k, name in enumerate(names):
            at = np.flatnonzero(family == k)
            if len(at):
                own = self.families[name]
                won, how = self._duel(x[at], own)
                lang[at] = np.array(own, object)[won]
                score[at] = sure[at] * how
        return lang, score


def fit(x: np.ndarray, langs: np.ndarray) -> Model:
    """Machines for all pairs, of families over all rows of the two, of languages within each."""
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(_FAMILY.get(lang, f"alone:{lang}"), []).append(lang)
    of = np.array([_FAMILY.get(lang, f"alone:{lang}") for lang in langs], object)
    machines = {}
    for names, given in [(sorted(families), of), *((own, langs) for own in families.values())]:
        for a, b in combinations(names, 2):
            at = np.flatnonzero((given == a) | (given == b))
            machines[a, b] = fit_svm(x[at], np.where(given[at] == a, 1.0, -1.0))
    return Model(families, machines)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        keep = has_letter(data, offsets)
        rows = [x.astype(np.float16).tobytes() for x in features(data, offsets)]
        texts = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2), pa.array(texts, pa.binary())], names=["lang", "x", "doc_id", "digest"]).filter(pa.array(keep))


def learn(docs: DataFrame, total: int = SAMPLE) -> Model | None:
    """The model of a sample of ``docs`` whose crc32(doc_id) mod 4 isn't 2 and whose lang isn't null, over the most frequent
    languages (``sampling.LABELS``); None without any. Repeated rows count each."""
    prepare(docs.sparkSession)
    rows = docs.where((crc_of("doc_id") % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = sample(rows.select("doc_id", "lang", "text"), "lang", "doc_id", total)
    got = chosen.select("lang", "text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_featured, "lang string, x binary, doc_id long, digest binary").toArrow()
    if not len(got):
        return None
    got = got.sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("digest", "ascending")])  # rows come in Spark's order; training must not depend on it
    x = np.stack([np.frombuffer(b, np.float16) for b in got.column("x").to_pylist()]).astype(np.float32)
    return fit(x, np.array(got.column("lang").to_pylist(), object))


def _predicted(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            data, offsets = buffers(batch.column(2))
            for i, j in slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                letters = has_letter(part, own)
                if model is not None and letters.any():
                    found, sure = model.predict(features(part, own))
                    lang[i:j] = np.where(letters, found, UNKNOWN)
                    score[i:j] = np.where(letters, sure, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row's whole text.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing could be learned. A null id isn't
    held out and isn't learned from. Equal votes go to the family, then the language, that comes first by name. Repeated rows give equal rows;
    an empty table gives none; other columns aren't read, and texts of any length are read whole.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` and predict each of them."""
    return predict(docs, learn(docs))
