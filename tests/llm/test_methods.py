"""Methods against plain versions of them, on fixtures made here: windows and joins, offsets, trees of votes, convolutions, records."""

import gzip
import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexloom.llm import bpe, language_id, pii, sampling, toxicity, warc
from codexloom.llm.queries import TOKENIZERS

WORD, BYTE = (f"{TOKENIZERS}/{n}.json" for n in ("word_bpe_49k", "byte_bpe_50k"))
PIECES = [" ", "  ", "\n", "\t", "a", "The", "don't", "'s", "é", "é", "中", "12", "3.5", "...", "<|endoftext|>", "<|startof", "text|>", " ", "😀", "x_y", "​", "\r\n", "ß", "İ", "\x00", " ", " the", " house"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_equal_the_library_for_both_kinds_of_tokenizers(path, monkeypatch):
    monkeypatch.setattr(bpe, "MEAN_CHUNK", 32)
    own, tok, r = bpe.ChunkedEncoder(path), bpe.tokenizer(path), random.Random(1)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 300))) for _ in range(150)]
    for text, (ids, decoded) in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(want)}I", *want) and decoded == tok.decode(want, skip_special_tokens=False)
    assert own.parted == (path == WORD) and own.joins > own.grown > 0  # some joins agree at once, others grow


def test_whole_chunks_and_windows_go_to_the_tokenizer():
    class Spy:
        def __init__(self, tok):
            self.tok, self.whole, self.windows = tok, [], []

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode(self, text, **kw):
            self.whole.append(text)
            return self.tok.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            self.windows += texts
            return self.tok.encode_batch_fast(texts, **kw)

    own = bpe.ChunkedEncoder(BYTE)
    own.tok = spy = Spy(own.tok)
    text = " ".join(f"word{i % 977}ing" for i in range(20000)).encode()
    own.encode([text])
    edges = [0, *bpe.cuts(np.frombuffer(text, np.uint8)).tolist(), len(text)]
    chunks = [text[a:b].decode() for a, b in zip(edges, edges[1:], strict=False)]
    given = [*spy.whole, *spy.windows]
    assert set(chunks) <= set(given) and len(given) < 6 * len(chunks)  # whole chunks, four words of each at most, and windows
    assert all(x in chunks or len(x) < 80 for x in given if len(x) < len(max(chunks, key=len)))
    own.encode([b"another beginning " + text])
    again = [*spy.whole, *spy.windows][len(given) :]
    assert sum(map(len, again)) < 0.3 * len(text)  # what is shared isn't encoded again


def test_words_and_windows_go_to_the_tokenizer_that_blanks_part(monkeypatch):
    own, asked = bpe.ChunkedEncoder(WORD), []
    plain = own._encoded
    monkeypatch.setattr(own, "_encoded", lambda words: asked.extend(words) or plain(words))
    text = " ".join(f"word{i % 977}ing" for i in range(20000)).encode()
    own.encode([text])
    assert len(asked) == len(set(asked)) and len(set(text.split()) - set(asked)) < 10 and own.joins > 20 and own.windows  # the others stand at cuts, in windows only
    own.encode([b"another beginning " + text])
    assert asked[-2:] and len(asked) < len(set(text.split())) + 2 * len(own.chunks)  # no word twice; those that cuts break besides


def test_joins_that_do_not_agree_make_one_chunk():
    """A chunk whose stored ids are wrong at a join is found out by the window, and both are encoded as one."""
    own, tok = bpe.ChunkedEncoder(WORD), bpe.tokenizer(WORD)
    text = " ".join(f"word{i}" for i in range(3000)).encode()
    edges = [0, *bpe.cuts(np.frombuffer(text, np.uint8)).tolist(), len(text)]
    assert len(edges) > 3
    own.encode([text])
    spoiled = own.chunks[text[: edges[1]]]
    spoiled.trail = b"\0\0\0\0"
    grown = own.grown
    (ids, _), = own.encode([text])
    want = tok.encode(text.decode(), add_special_tokens=False).ids
    assert own.grown > grown and ids == struct.pack(f"<{len(want)}I", *want)


#: Lines that the field isn't trained on; [kind and ] as in its table.
HELD_OUT = """
My name is [name Sofia Marin] and I live here.
Mr. [name Fischer] called again.
Mrs. [name Elena Petri] paid.
Dr. [name Okafor] signs on Friday.
We met [name Daniel Weber] in the hall.
Dear [name Alice Martin], the parcel is here.
Signed: [name Marta Nowak]
Contact: [name Hugo Laurent], at the desk.
name: [name Greta Olsen]
He is [name Tom Baker] who runs the mill.
mail [contact sara at post dot net] please
or write [contact team at lab dot org] and ask
contact: [contact lee.wong (at) site (dot) com] now
reach [contact nora [at] farm [dot] info] by noon
token = [secret "5f4dcc3b5aa765d61d8327deb882cf99aa11bb22"] ends
password: [secret Qw7er9ty3ui8op2a]
api_key = [secret "sk-1f2e3d4c5b6a79880011"] is old
call [number +1 (312) 555-0188 4539578763621486] tonight
the [number 4916338506082832] 10.0.0.12 was used
The train to Vienna leaves at nine, from platform two.
It is the end of the road, and the key was at the door.
Under the Mozilla Public License and the Apache License.
Nous sommes allés au marché de la ville avec les enfants.
Wir haben das Haus am See verkauft und sind zu der Tante gezogen.
La casa de mi abuela está en la calle de los pinos.
BUY NOW!! ONLY TODAY!! AT THE SHOP!!
green green green blue blue blue blue green green
Page 34 of 120 was printed in 2004, at 12.30.
""".strip().splitlines()


def test_field_on_lines_it_has_not_seen():
    finder, hits, found, wanted = pii.Finder(*pii.model()), 0, 0, 0
    for line in HELD_OUT:
        kinds = "|".join(pii.ADDED)
        parts = __import__("re").split(rf"\[((?:{kinds}) .*?)\](?=[ ,.]|$)(?! \[dot\])(?! [a-z]+ \[dot)", line)
        text, spans = "", set()
        for k, part in enumerate(parts):
            if k % 2:
                kind, _, words = part.partition(" ")
                plain = words.strip("\"'")
                spans.add((kind, text + words, plain))
                text += words
            else:
                text += part
        want = {(kind, plain) for kind, _, plain in spans}
        raw = np.frombuffer(text.encode(), np.uint8)
        got = {(k, text[a:b].strip("\"'")) for k, a, b in finder.find(raw, np.array([0, len(raw)]))[0][2]}
        hits, found, wanted = hits + len(want & got), found + len(got), wanted + len(want)
    print(f"precision {hits / found:.2f}, recall {hits / wanted:.2f} of {wanted}")
    assert wanted == 19 and hits / found >= 0.85 and hits / wanted >= 0.8


def test_many_spans_take_linear_time():
    line = "mail anna at mail dot com or 10.0.0.1 then call +1 (487) 555-7209 4736962573099581 now é\n"
    finder, times = pii.Finder(*pii.model()), []
    for n in (5000, 35000):
        raw = np.frombuffer((line * n).encode(), np.uint8)
        start = time.process_time()
        (text, base, added), = finder.find(raw, np.array([0, len(raw)]))
        times.append(time.process_time() - start)
        assert len(base) == n and len(added) == 2 * n
        size = len(line)
        assert [text[a:b] for k, a, b in added if k == "contact"][-1] == "anna at mail dot com" and added[0][1] + size == added[1][1]
    assert times[1] < 20 * times[0] + 1


def test_field_gradient_and_decoding(spark):
    """A field fitted by gradients gives its own table's labels back, as wholes."""
    table, moves = pii.model()
    rows = pii._table_rows(pii.LABELLED)
    right = total = 0
    for codes, labels in rows:
        scores = pii._scores(codes, table, np.zeros(len(codes), int), np.full(len(codes), len(codes)))
        right += (pii.viterbi(scores, np.array([0]), np.array([len(codes)]), moves) == labels).sum()
        total += len(codes)
    assert right / total > 0.97


def test_language_model_does_not_depend_on_the_deal(spark):
    rows = [(i, ("the cat and the dog of it %d" if i % 2 else "der Hund und die Katze ist %d") % (i * 37), "en" if i % 2 else "de") for i in range(240)] + [(300 + i, "short", "en") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (language_id.learn(docs.repartition(n)) for n in (1, 5))
    assert a.machines.keys() == b.machines.keys() and all(np.array_equal(a.machines[k], b.machines[k]) for k in a.machines)


def test_language_features_and_votes():
    text = "The cát\tsat, the end."
    raw = text.encode()
    folded = bytes(32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in raw)
    want = np.zeros(language_id.WIDTH)
    for k in range(len(folded) - 2):
        x = (folded[k] * 0x9E3779B1 + folded[k + 1] * 0x85EBCA77 + folded[k + 2] * 0xC2B2AE3D) * 0x27D4EB2F & 0xFFFFFFFF
        want[x >> 21] += 1
    data = np.frombuffer(raw + b"ab" + raw, np.uint8)
    got = language_id.features(data, np.array([0, len(raw), len(raw) + 2, len(data)]))
    assert np.allclose(got[0], np.sqrt(want / want.sum())) and not got[1].any() and np.array_equal(got[0], got[2])
    w = {p: np.r_[np.zeros(2), m].astype(np.float32) for p, m in {("a", "b"): 0.0, ("fr", "es"): 1.0}.items()}
    model = language_id.Model({"a": ["fr", "es"], "b": ["xx"]}, {("a", "b"): w["a", "b"], ("fr", "es"): w["fr", "es"]})
    lang, score = model.predict(np.zeros((1, 2), np.float32))  # equal votes: the first family by name
    assert lang[0] == "fr" and score[0] == pytest.approx(0.5 / (1 + np.exp(-3.0)))


def test_samples_are_bounded(spark):
    rows = spark.createDataFrame([(i, f"l{i % 30}" if i % 3 else "l0") for i in range(3000)] + [(9999, None)], "id long, label string")
    got = sampling.sample(rows, "label", "id", 300, labels=5).groupBy("label").count().collect()
    assert len(got) == 5 and sum(r["count"] for r in got) < 450 and "l0" in {r.label for r in got}
    assert sampling.sample(rows.limit(0), "label", "id", 10).count() == 0


def test_convolution_equals_a_plain_one():
    random_ = np.random.default_rng(0)
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    embed = random_.normal(0, 1, (toxicity.BUCKETS, toxicity.EMBED)).astype(np.float32)
    embed[0] = 0
    net = toxicity.Network(embed, [random_.normal(0, 1, (w, toxicity.EMBED, toxicity.FILTERS)) for w in toxicity.WIDTHS], random_.normal(0, 1, n), random_.normal(0, 1, n + 1), np.zeros(len(toxicity._LANGS)))
    texts = ["one two, three four five", "", "only", "a b a b a b"]
    raw = "".join(texts).encode()
    ids, first, _ = toxicity.tokens(np.frombuffer(raw, np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
    got = net.logits(ids, first, net.tables())
    for k in range(len(texts)):
        words = [embed[row].sum(0) for row in ids[first[k] : first[k + 1]]]
        words = [*(words or [np.zeros(toxicity.EMBED)]), *[np.zeros(toxicity.EMBED)] * 3]
        places = max(1, first[k + 1] - first[k])
        pooled = [max(sum(words[p + j] @ f[j] for j in range(len(f)))[c] for p in range(places)) for f in net.filters for c in range(toxicity.FILTERS)]
        assert got[k] == pytest.approx(np.maximum(np.array(pooled) + net.shift, 0) @ net.out[:-1] + net.out[-1], rel=1e-4)


def response(head, body):
    block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
    return warc.serialize({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "WARC-Date": "d", "WARC-Target-URI": "u"}, block)


def test_bodies_and_headers_of_responses():
    page = "<title>café outlink: x</title><p>café</p><a href=b>l</a>"
    zipped = gzip.compress(page.encode(), mtime=0)
    bodies = [
        (b"Content-Type: text/html; charset=iso-8859-1", page.encode("latin-1")), (b"Content-Type: text/html", b"<meta charset='windows-1252'>" + page.encode("cp1252")), (b"X-A:1", b"\xff\xfe" + page.encode("utf-16-le")), (b"Content-Encoding: gzip", zipped),
        (b"Content-Encoding: deflate", zlib.compress(page.encode())), (b"Transfer-Encoding: chunked", b"5\r\n" + page.encode()[:5] + b"\r\n%x;x=y\r\n" % (len(page.encode()) - 5) + page.encode()[5:] + b"\r\n0\r\n\r\n"), (b"Content-Type: x; charset=none-such", page.encode()),
    ]
    for head, body in bodies:
        made = warc.derive(response(head, body))
        assert made.text == "café\nl" or made.text == "cafél" or "café" in made.text, head
        assert warc.Record(warc.header_lines(warc.parse(made.metadata).block), b"").all("outlink") == ["b"]
    for head, body in [(b"Content-Encoding: gzip", zipped[:-9]), (b"Content-Encoding: br", b"x"), (b"Transfer-Encoding: chunked", b"zz\r\n"), (b"Content-Encoding: gzip", gzip.compress(b"0" * (1 << 20)) + b"junk")]:
        with pytest.raises(warc.WarcError):
            warc.derive(response(head, body))
    made = warc.derive(response(b"X-A:1\r\nSet-Cookie: a\r\nset-cookie: b\r\nX-F: one\r\n two\r\nno colon", b"x"))
    fields = warc.header_lines(warc.parse(made.metadata).block)
    assert [v for k, v in fields if k == "source-set-cookie"] == ["a", "b"] and ("source-x-a", "1") in fields and ("source-x-f", "one two") in fields


def test_report_says_what_records_hold(spark):
    pages = [(1, "http://a", "<html lang=fr><p>é x<p>y<a href=q>l</a><a href=r>m</a>"), (2, None, None), (3, "http://b", "outlink: no"), (3, "http://b", "outlink: no")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record", F.lit("clash"))
    got = sorted(map(tuple, warc.derivative_report(df).select("page_id", "target_uri", "source_digest", "conversion_digest", "text_chars", "text_sha256", "n_links", "metadata_bytes", "conversion_bytes").collect()))
    want = []
    for page, url, html in pages:
        text, _, _, links = warc.page_text(html or "")
        d = warc.derive(warc.response(page, url, html))
        want.append((page, url or "", warc.digest((html or "").encode()), warc.digest(text.encode()), len(text), hashlib.sha256(text.encode()).hexdigest(), len(links), len(d.metadata), len(d.conversion)))
    assert got == sorted(want) and warc.derivative_report(df.limit(0)).count() == 0


def test_files_of_records(spark):
    made = [warc.response(k, f"http://{k}", f"<p>{k}") for k in range(5)]
    files = [("a.warc.gz", warc.joined(made)), ("b.warc", warc.joined(made[:2], zipped=False)), ("c.warc", made[0] + made[1][:-9]), ("d.warc.gz", warc.joined(made)[:-20]), ("e.warc", b""), ("f.warc", None)]
    rows = warc.read_files(spark.createDataFrame([(p, None if b is None else bytearray(b)) for p, b in files], "path string, content binary")).collect()
    by = {p: [r for r in rows if r.path == p] for p, _ in files}
    assert [bytes(r.record) for r in by["a.warc.gz"]] == made and [bytes(r.record) for r in by["b.warc"]] == made[:2] and not by["e.warc"] and not by["f.warc"]
    assert [r.error is None for r in by["c.warc"]] == [True, False] and [r.error is None for r in by["d.warc.gz"]] == [False]
    again = warc.file_contents(spark.createDataFrame([(bytearray(x),) for x in made], "record binary").coalesce(1)).collect()
    assert sum(r.n_records for r in again) == 5 and sorted(x for r in again for x in warc.records(bytes(r.content))) == sorted(made)


def test_odd_rows_of_every_text_operator(spark):
    """Empty tables, nulls, repeated rows and clashing extra columns."""
    rows = [(1, "the cat sat at home", "en", "x"), (1, "the cat sat at home", "en", "x"), (None, None, None, None), (2, "", "de", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = docs.withColumns({n: F.lit("clash") for n in ("id", "n", "ids", "spans", "score", "bin", "held_out", "sample_label", "label_id", "decoded")})
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    makers = {
        "pii": pii.find_pii, "bpe": lambda d: bpe.encode_digests(d, WORD), "ids": lambda d: bpe.encode(d, WORD), "language": lambda d: language_id.predict(d, None), "toxicity": lambda d: toxicity.score(d, None),
    }
    for name, make in makers.items():
        got = make(odd).collect()
        assert len(got) == 4 and len(set(map(str, got))) == 3, name
        assert make(odd.limit(0)).count() == 0, name
    assert toxicity.learn(docs.limit(0), labels) is None and language_id.learn(docs.limit(0)) is None
    assert toxicity.learn(docs, labels.limit(0)) is None


def test_bands_lose_no_pair_at_the_threshold():
    from codexloom.llm import near_duplicates as nd

    r, lost = np.random.default_rng(7), 0
    for size in (7, 20, 60, 200, 600):
        for _ in range(120):
            both = int(np.ceil(0.75 * 2 * size / 1.75))
            x = r.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(x[:size]), np.sort(np.r_[x[:both], x[size:]])
            keys = nd.band_keys(np.stack([nd.sketch(a), nd.sketch(b)]))
            lost += not (keys[0] == keys[1]).any()
    assert lost == 0
