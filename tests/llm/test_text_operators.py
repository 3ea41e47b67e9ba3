"""BPE, chat, media, personal data and WARC against plain versions and round trips."""

import hashlib
import io
import re
import struct
import tarfile
import zlib
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codexloom.llm import bpe, chat, media, pii, warc
from codexloom.llm.queries import TOKENIZERS

ODD = [None, "", " ", "plain text", "Caf\u0065\u0301 It's <|endoftext|> 12 ½ ǅ İ", "a" * 3000, "word " * 9000, "é\u0301\n\n\tx\u2028y\u00a0z", "<|startoftext|><|end", "日本語 テキスト", "ΑΣ ΑΣ. Σ"]
VOCABULARY = f"{TOKENIZERS}/word_bpe_49k.json"


@pytest.fixture(scope="module")
def texts(spark, data):
    return ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    rows = frame(spark, texts)
    got = {r.doc_id: r for r in bpe.encode(rows, VOCABULARY).collect()}
    for r in bpe.encode_digests(rows, VOCABULARY).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].ids == ids and got[r.doc_id].decoded == decoded
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_chunks_are_shared_and_joins_repaired():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    e = bpe.ChunkedEncoder(VOCABULARY)
    text = " ".join(f"word{i % 977}ing" for i in range(20000))
    e.encode([text.encode()])
    encoded, met = e.encoded, e.met
    other = "other beginning " + text
    (ids, _), = e.encode([other.encode()])
    assert e.encoded - encoded < 0.1 * (e.met - met)  # almost every chunk was known
    want = t.encode(other, add_special_tokens=False).ids
    assert ids == struct.pack(f"<{len(want)}I", *want)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### user: x</turn>\n"), (1, 2, "assistant", "a\\"), (2, 0, None, None), (2, None, "odd: role</turn>\n", "\\</turn>\n### "), (None, 0, "assistant", "é")]
    rows += [(7, i, "assistant" if i % 2 else "user", f"t{i} " * (i % 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, 7, None}
    for conv in (1, 7, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("\\#:/<>turn \nab", max_size=12), st.lists(st.sampled_from(["### ", ": ", "</turn>\n", "</turn>", "\\", "a", "\n"]), max_size=8).map("".join)), max_size=4))
def test_chat_grammar(turns):
    shown = "".join(chat.render_turn(r, t) for r, t in turns)
    back = chat.parse(shown)
    assert [(t.role, t.text) for t in back] == turns
    assert all(chat.unescape(shown[t.start : t.end]) == t.text for t in back)


def test_media_read_back(spark, texts, tmp_path):
    folder = f"file://{tmp_path}/shards"
    df = frame(spark, [*texts, "same", "same"])
    index = media.write_media(df, folder)
    got = {r.doc_id: r for r in media.with_features(media.with_metadata(index, folder), folder).collect()}
    for i, t in enumerate([*texts, "same", "same"]):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(media.to_png(payload)).hexdigest() and r.feature.startswith(f"64x{len(payload) // 192};")
    assert got[len(texts)].asDict() | {"doc_id": 0} == got[len(texts) + 1].asDict() | {"doc_id": 0}
    for r in index.collect()[:20]:  # any tar reader finds the payload under its digest
        with tarfile.open(tmp_path / "shards" / r.shard) as tar:
            assert hashlib.sha256(tar.extractfile(f"{r.digest}.png").read()).hexdigest() == r.digest
            assert tar.getmember(f"{r.digest}.png").offset_data == r.offset
    assert media.media_report(df.limit(0)).count() == 0


def test_media_report_reads_back_in_one_worker_a_task(spark, texts, tmp_path):
    folder = f"file://{tmp_path}/shards"
    df = frame(spark, [*texts, "same", "same"])
    report = media.media_report(df)
    assert report._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    steps = media.with_features(media.with_metadata(media.write_media(df, folder), folder), folder)
    assert report.columns == steps.columns and sorted(report.collect()) == sorted(steps.collect())


def test_png_is_valid_and_lossless():
    payload = bytes(range(192)) * 3
    image = media.to_png(payload)
    assert media.from_png(image) == payload and media.header(image[:33]) == {"width": 64, "height": 3, "bit_depth": 8, "color_type": 2}
    with pytest.raises(ValueError):
        media.from_png(image[:50] + b"\0" + image[51:])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((lambda x: x - 9 * (x > 9))(int(c) * (1 + i % 2)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text("a1.@+ -()9_é0\n", max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_of_hard_texts():
    for text in ("4012888888881881", "+1 (487) 555-7209", "1.2.3.4.5.6.7.8.9", "a@b.c_d@e.f", "1111.2.3.4.5", "0001.2.3.255", "9" * 30):
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []  # linear time


def test_pii_rows(spark, texts):
    lines = ["My name is Robert Brown and\ntoken = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "mail eva at web dot org now", "é a@b.co 1.2.3.4 x +1 (487) 555-7209 y 4012888888881881"]
    rows = [*lines, *texts]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, rows)).collect()}
    for i, t in enumerate(rows):
        base = brute_spans(t or "")
        assert tuple(got[i][f"n_{k}"] for k in pii.BASE) == tuple(sum(s[0] == k for s in base) for k in pii.BASE)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[i].spans.startswith(joined)
    found = [[(k, lines[i][int(a) : int(b)]) for k, a, b in (s.split(":") for s in got[i].spans.split(","))] for i in range(3)]
    assert found[0] == [("name", "Robert Brown"), ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert found[1] == [("contact", "eva at web dot org")] and len(found[2]) == 4
    assert sum(not got[i].n_email and any(k in got[i].spans for k in ("name", "contact")) for i in range(3, len(rows))) <= 1


def test_numbers_beside_numbers_are_found():
    import pyarrow as pa

    from codexloom.llm.bytegrid import buffers

    lines = ["so is +1 (269) 555-3296 4524132264652876 and", "é was 38.253.197.126 4880761348116108\nend", "the 4451718024887799 27.65.93.14 of", "page 345 of 1998 and 47853"]
    found = pii.Finder(*pii.model()).find(*buffers(pa.array(lines)))
    left = [re.sub("<[A-Z]+>", "", pii.redact(t, base + more)) for t, base, more in found]
    assert not any(re.search("[0-9]{4}", x) for x in left[:3]) and not found[3][2]
    assert all(not (s < e2 and s2 < e) for _, base, more in found for _, s, e in more for _, s2, e2 in base)


def test_redaction_keeps_columns(spark):
    df = spark.createDataFrame([(1, "x a@b.co y", 10, "p"), (2, None, None, "q"), (3, "", 0, "r")], "doc_id long, text string, n_chars long, c0 string")
    got = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert got[1].asDict() == {"doc_id": 1, "text": "x <EMAIL> y", "n_chars": 11, "c0": "p"}
    assert got[2].text is None and got[3].text == "" and pii.redacted(df).columns == df.columns


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    scores, moves = r.normal(size=(11, 3)), r.normal(size=(3, 3))
    first, size = np.array([0, 4, 5]), np.array([4, 1, 6])
    got = pii.viterbi(scores, first, size, moves)
    for f, n in zip(first, size, strict=True):
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(scores[f + i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(got[f : f + n]) == best


def test_warc_derivatives(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").unionByName(spark.createDataFrame([(-1, None, None), (-2, "http://a/ b", "<p>x<br>y</p><script>z</script>&amp; <a href='/q'>l</a>")], "page_id long, url string, html string"))
    records = {r.page_id: bytes(r.record) for r in warc.responses(pages).collect()}
    got = {r.page_id: r for r in warc.derivative_report(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        source, row = records[r.page_id], got[r.page_id]
        body = (r.html or "").encode()
        assert source.endswith(body + b"\r\n\r\n") and row.source_digest == warc.digest(body)
        ids = re.search(rb"WARC-Record-ID: (.*)\r\n", source)[1].decode()
        assert row.response_id == row.metadata_refers_to == row.conversion_refers_to == ids
        assert len({row.response_id, row.metadata_id, row.conversion_id}) == 3
    assert warc.page_text("<p>x<br>y</p><script>z</script>&amp; <a href='/q'>l</a>") == ("x\ny\n& l", "", "", ["/q"])


def test_warc_damage_is_reported(spark):
    good = warc.response(1, "http://a", "<p>hi</p>")
    bad = [good[:-5], good.replace(b"<p>hi", b"<p>ho"), b"", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", warc.derive(good).conversion]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([good, *bad])] + [(99, None)], "page_id long, record binary")
    rows = {r.page_id: r.error for r in warc.derivatives(df).collect()}
    assert rows[0] is None and all(rows[i] for i in (1, 2, 3, 4, 5, 99))
    assert io.BytesIO(good).readline() == b"WARC/1.1\r\n" and Path(VOCABULARY).exists()
