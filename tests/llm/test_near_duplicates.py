"""Near-duplicates against brute force over all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codexloom.llm import near_duplicates as nd
from codexloom.llm.bytegrid import buffers, shingle_sets, words

SCHEMA = "doc_id long, text string"


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """(doc_id, n, component, kept) of each row by comparing all pairs that share a shingle."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets, holders = [sets_of(t) for _, t in rows], defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g] if j > k)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(rows[k][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def result(df):
    return sorted(map(tuple, nd.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()))


def corpus(seed, n=120):
    """Texts with copies, near copies in chains, a passage that many share, and short ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6)))
    passage, out = [word() for _ in range(60)], []
    for _ in range(n):
        kind = r.random()
        if kind < 0.35 and out:
            w = list(r.choice(out))
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = word()
        elif kind < 0.6:
            w = [word() for _ in range(r.randint(5, 40))] + passage
        else:
            w = [word() for _ in range(r.choice([1, 3, 5, 8, 30, 200]))]
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rows = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(rows)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_hub_that_is_no_centre_loses_no_link(spark):
    """Copies that each differ from the base elsewhere link with the base only; the least id is one of them."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(12):
        w = list(base)
        for j in range(2):
            w[(8 * k + 4 * j) % 96 + 2] = f"x{k}_{j}"
        rows.append((k, " ".join(w)))
    rows.append((50, " ".join(base)))
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edge_rows(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE  two"), (10, "one two"), (10, "one two"), (11, "é ß"), (12, "x " * 40000), (13, "x " * 40001), (None, "one two"), (None, None)]
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows)
    assert by[5] == (0, 5, True) and by[6] == (0, 6, True) and by[7] == (0, 7, True)
    assert by[8] == (1, 8, True) and by[9] == (1, 8, False) and by[10] == (1, 8, False)
    assert by[12] == (1, 12, True) and by[13] == (1, 12, False)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_id_of_two_texts_is_one_document(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "p q r s t u"), (3, "p q r s t u")]
    got = sorted((r.doc_id, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 1)]


def test_empty_table_and_clashing_columns(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b", "x", 1, 2), (2, "a b", "y", 3, 4)], "doc_id long, text string, id string, component long, n long")
    assert result(df) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101)]
    random.Random(0).shuffle(edges)
    got = {r.id: r.component for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_sketch_agrees_as_often_as_sets_do():
    r = np.random.default_rng(0)
    for size in (4, 40, 2000):
        a = r.integers(0, 2**64, size, dtype=np.uint64)
        b = a.copy()
        b[: size // 4] = r.integers(0, 2**64, size // 4, dtype=np.uint64)
        share = (size - size // 4) / (size + size // 4)
        got = np.mean(nd.sketch(np.unique(a)) == nd.sketch(np.unique(b)))
        assert abs(got - share) < 0.15


def test_words_at_byte_level():
    texts = ["", " a\tb\nc ", "é\u00a0x y", None, "\v\f", "last"]
    data, offsets = buffers(pa.array(texts))
    w = words(data, offsets)
    got = [[data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [len(s) for s in shingle_sets(pa.array(["a b c d e f g", "A b C d E f G"]))] == [3, 3]
