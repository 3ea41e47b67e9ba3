"""The pipeline against plain versions of its stages, and each stage on odd rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codexloom.llm import mixing, pii
from codexloom.llm.queries import TOKENIZERS
from tests.llm.test_learned_operators import counts
from tests.llm.test_near_duplicates import brute
from tests.llm.test_text_operators import brute_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = [n for n, _ in corpus_pipeline.STAGES]


def test_stages_in_order():
    assert NAMES == ["quality", "near_dedup", "pii", "mixing", "bpe"]


def test_whole_pipeline(spark, data):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i: r for i, r in rows.items() if not counts(r.text)[5]}  # too few labels here for cutoffs
    single = [i for i, _, _, first in brute([(i, r.text) for i, r in kept.items()]) if first]
    redacted = {}
    finder = pii.Finder(*pii.model())
    from codexloom.llm.bytegrid import buffers
    import pyarrow as pa

    for i, (text, base, added) in zip(single, finder.find(*buffers(pa.array([kept[i].text for i in single]))), strict=True):
        assert base == brute_spans(text)
        redacted[i] = pii.redact(text, base + added)
        assert not re.search("@mail", redacted[i])
    frame = spark.createDataFrame([(i, t, rows[i].lang, rows[i].source, len(t)) for i, t in redacted.items()], SCHEMA)
    copies = {r.doc_id: r.copies for r in mixing.mix(frame).collect()}
    t = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    want = Counter()
    for i, n in copies.items():
        ids = tuple(t.encode(redacted[i], add_special_tokens=False).ids)
        want[i, ids, t.decode(list(ids), skip_special_tokens=False)] += n
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, data).collect())
    assert got == +want


ODD = [(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "a", 0), (3, "w " * 50000, "en", "a", 100000), (4, "one two three " * 10, None, "b", 1), (4, "one two three " * 10, None, "b", 1), (5, " ".join(f"x{i}" for i in range(60)), "en", "b", 2), (6, " ".join(f"x{i}" for i in range(60)), "fr", None, 3), (7, " ".join(f"y{i}" for i in range(60)) + " a@b.co", "xx", "c", 9)]


@pytest.mark.parametrize("name", NAMES)
def test_stages_on_odd_rows(spark, data, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = spark.createDataFrame(ODD, SCHEMA)
    for c in ("id", "key", "component", "q_kept", "q_limits", "mix_id", "mix_copies", "quality", "c0", "size", "copies", "label_id", "text_"):
        odd = odd.withColumn(c, F.lit(c))
    for docs in (odd, odd.limit(0)):
        out = stage(spark, docs, data)
        rows = out.collect()
        assert not (docs.isEmpty() and rows)
        if name != "bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert all(r.mix_id == "mix_id" and r.q_kept == "q_kept" for r in rows)
    ids = Counter(r.doc_id for r in stage(spark, odd, data).collect())
    if name == "quality":
        assert set(ids) == {5, 6, 7}
    elif name == "near_dedup":
        assert set(ids) == {None, 1, 2, 3, 4, 5, 7}
    elif name == "pii":
        assert ids == Counter(r[0] for r in ODD)
    elif name == "mixing":
        assert not {1, 2} & set(ids) and max(ids.values()) <= 4
    else:
        assert ids == Counter(r[0] for r in ODD)


def test_near_dedup_keeps_one_row_of_each_group(spark, data):
    """Rows that repeat an id, with equal texts or not, and rows without an id are documents like others."""
    text = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, text("a"), "x"), (1, text("a"), "x"), (2, text("b"), "z"), (2, text("c"), "y"), (2, text("c"), "y"), (3, text("d"), "x"), (None, text("d") + " end", "x")]
    rows += [(None, text("e"), "x"), (None, text("e"), "w"), (None, None, "x"), (None, None, "x"), (None, " ", "x"), (4, None, "x"), (5, "", "x"), (6, text("a"), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [(1, text("a"), "x"), (2, text("b"), "z"), (3, text("d"), "x"), (None, text("e"), "w"), (None, None, "x"), (None, None, "x"), (None, " ", "x"), (4, None, "x"), (5, "", "x")]
    for given in (docs, docs.repartition(3)):
        out = corpus_pipeline.near_dedup(spark, given, data)
        assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == Counter(want)


def test_near_dedup_counts_odd_rows(spark, data):
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(ODD, SCHEMA), data).collect()
    assert Counter(r.doc_id for r in out) == Counter([None, 1, 2, 3, 4, 5, 7])
