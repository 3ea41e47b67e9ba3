"""Readers and streams on files made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from codexloom.sources import archives, html, ledgers, plugins
from codexloom.streaming import decisions


def zipped(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return buffer.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped([
    ("word/document.xml", f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t><w:t>text</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'),
    ("word/footnotes.xml", f"<w:footnotes {W}><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnotes>"),
])
EPUB_PARTS = [
    ("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/content.opf"/></rootfiles></container>'),
    ("OPS/content.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml"/><item id="b" href="b%20b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'),
    ("OPS/a.xhtml", "<html><body><h1>Two</h1><p>end</p></body></html>"),
    ("OPS/b b.xhtml", "<html><body><h1>One</h1><p>start <i>now</i></p></body></html>"),
]
EPUB = zipped(EPUB_PARTS)


def test_html_blocks():
    page = "<html><body><h1>A &amp; b</h1><p>one<p>two<script>x</script><ul><li>i<li>j</ul><table><tr><td><p>c</p></td></tr></table><p style='display: none'>no</p><p hidden>no</p><div>no block</div></body>"
    assert [(t, x) for t, _, x in html.blocks_of(page)] == [("h1", "A & b"), ("p", "one"), ("p", "two"), ("li", "i"), ("li", "j"), ("table", "c"), ("p", "c")]


def test_docx_and_epub(spark):
    assert archives.docx_blocks(DOCX) == [("word/document.xml", "h1", "Title"), ("word/document.xml", "p", "Some text"), ("word/document.xml", "del", "gone"), ("word/document.xml", "td", "cell"), ("word/footnotes.xml", "p", "note")]
    assert [(t, x) for _, t, x in archives.epub_blocks(EPUB)] == [("h1", "One"), ("p", "start now"), ("h1", "Two"), ("p", "end")]
    files = spark.createDataFrame([("a.docx", "docx", DOCX), ("b.epub", "epub", EPUB), ("bad.docx", "docx", b"junk")], "path string, format string, content binary")
    rows = archives.read_archives(files).collect()
    locked = bytearray(DOCX)  # the flag of an encrypted member, in the local and the central header
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + at] |= 1
    odd = [("locked.docx", "docx", bytes(locked)), ("method.docx", "docx", DOCX.replace(DOCX[DOCX.index(b"PK\x01\x02") : DOCX.index(b"PK\x01\x02") + 12], DOCX[DOCX.index(b"PK\x01\x02") : DOCX.index(b"PK\x01\x02") + 10] + b"\x63\0"))]
    odd.append(("latin.epub", "epub", zipped([*EPUB_PARTS[:2], ("OPS/a.xhtml", "<?xml version='1.0' encoding='iso-8859-1'?><html><body><p>caf\u00e9</p></body></html>".encode("latin-1")), EPUB_PARTS[3]])))
    odd.append(("coding.epub", "epub", zipped([*EPUB_PARTS[:2], ("OPS/a.xhtml", b"<?xml version='1.0' encoding='x-none'?><html/>"), EPUB_PARTS[3]])))
    odd.append(("lost.epub", "epub", zipped([EPUB_PARTS[0], ("OPS/content.opf", EPUB_PARTS[1][1].replace('idref="a"', 'idref="zz"')), *EPUB_PARTS[2:]])))
    got = archives.read_archives(spark.createDataFrame(odd, "path string, format string, content binary")).collect()
    assert sorted({r.path for r in got if r.error}) == ["coding.epub", "locked.docx", "lost.epub", "method.docx"]
    assert "caf\u00e9" in {r.text for r in got if r.path == "latin.epub"}
    assert len([r for r in rows if r.path == "b.epub"]) == 4 and [r.error is not None for r in rows if r.path == "bad.docx"] == [True]


@pytest.mark.parametrize("names", [["../x"], ["/x"], ["A", "a"], ["é", "é"], ["a", "a/b"], ["a", "a/b/c"], ["a/b", "a/b/c/d/e"], ["/"], [""]])
def test_unsafe_archives(names):
    with zipfile.ZipFile(io.BytesIO(zipped([(n, "x") for n in names]))) as z, pytest.raises(archives.UnsafeArchive):
        archives.check_archive(z)


def test_unsafe_xml_and_references():
    for data in (b"<!DOCTYPE x><x/>", '<!ENTITY a "b"><x/>'.encode("utf-16")):
        with pytest.raises(archives.UnsafeArchive):
            archives.safe_xml(data)
    assert archives.resolve("OPS/a/b.xhtml", "../c%20d.xhtml#f") == ("local", "OPS/c d.xhtml", "f")
    assert archives.resolve("a.xhtml", "../../x")[0] == "invalid" and archives.resolve("a", "http://x")[0] == "external"


def test_ledger_files(spark, tmp_path):
    p = str(tmp_path / "l")
    df = spark.createDataFrame([(1, "é"), (2, None)], "i int, t string")
    ledgers.write_ledger(df, p)
    ledgers.write_ledger(df, p, append=True)
    assert ledgers.read_ledger(spark, p, "i int, t string").count() == 4
    assert ledgers.read_ledger(spark, f"{p}-none", "i int").count() == 0
    for name, body in (("a.json", '[{"kind":"page","n":1}]'), ("b.json", '{"decisions":[{"kind":"page","n":2}]}'), ("c.jsonl", '{"kind":"page","n":3}\n\n')):
        (tmp_path / name).write_text(body)
    assert [ledgers.read_decisions(spark, str(tmp_path / n), "kind string, n int").first().n for n in ("a.json", "b.json", "c.jsonl")] == [1, 2, 3]
    (tmp_path / "b.manifest").write_text('{"sources":[{"source_id":"z","locator":"z.md","order":2},{"source_id":"a","locator":"a.md","order":1}]}')
    assert [r.source_id for r in ledgers.read_bundle(spark, str(tmp_path / "b.manifest")).collect()] == ["a", "z"]


def test_recognised_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"page_id":"p1","text":"a","bbox":[0,0,1,1],"engine":"e"}\n{"page":0,"text":"b","bbox":[0,0,1,1]}\n{"text":"c","bbox":[0,0,1,1]}\n{"page":2,"text":"d","bbox":[0,0,1]}\n{"page":2,"text":"f","bbox":[0,0,1,1]}\n')
    rows = ledgers.read_recognised(spark, str(tmp_path / "s.jsonl"))
    assert {(r.text, r.engine) for r in rows.collect()} == {("a", "e"), ("f", "e")}
    assert [r.text for r in ledgers.of_page(rows, "p1", None, 1).collect()] == ["a"]
    (tmp_path / "w.tsv").write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t1\t2\t3\t4\t90.5\thi\nbad\t1\t1\t1\t1\t1\t1\t2\t3\t4\tx\tno\n")
    assert [(r.text, r.conf, r.ordinal) for r in ledgers.read_words(spark, str(tmp_path / "w.tsv")).collect()] == [("hi", 90.5, 0)]


def test_corpus(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Head\n\nfirst\nline\n\n \n## Sub\n\n\nlast")
    (tmp_path / "in" / "b.xyz").write_text("no")
    files = ledgers.read_corpus(spark, str(tmp_path))
    assert [r.format for r in files.collect()] == ["markdown"] and ledgers.tree_digest(files).first().n == 1
    got = ledgers.read_texts(spark, str(tmp_path / "in" / "a.md")).orderBy("ordinal").collect()
    assert [(r.tag, r.text) for r in got] == [("h1", "Head"), ("p", "first\nline"), ("h2", "Sub"), ("p", "last")]
    want = files.select("path", F.lit("0" * 64).alias("expected_sha256"))
    assert [r.finding for r in ledgers.attested(files, want).collect()] == ["mismatch"]


def test_readers_by_format():
    assert plugins.reader_of("docx").available
    with pytest.raises(LookupError):
        plugins.reader_of("tape")
    if not plugins._READERS["pdf"].available:
        with pytest.raises(RuntimeError):
            plugins.reader_of("pdf")
    assert plugins.choose(["tape", "docx"]) == "docx"


def test_streams_equal_batches(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    for name, df, mode in (("latest", decisions.latest_stream(stream, ["user_id", "event_type"], "ts", "event_id"), "complete"), ("hours", decisions.activity(stream, late="4000 days"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = {(r.user_id, r.event_type): r.ts for r in events.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts")).collect()}
    assert {(r.user_id, r.event_type): r.ts for r in spark.table("latest").collect()} == want
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()
