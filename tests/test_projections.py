"""Projections, older packages and markup."""

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from codexloom.operators import legacy, projections
from codexloom.sources import markup


def test_structure_and_spans(spark):
    paragraphs = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "paragraph_id string")
    boundaries = spark.createDataFrame([("b1", "T", ["Part", "One"], ["p1"]), ("b2", "", None, ["p2"])], "boundary_id string, title string, structure_path array<string>, paragraph_ids array<string>")
    assert {r.paragraph_id: r.structure_path for r in projections.structure_paths(paragraphs, boundaries).collect()} == {"p1": ["Part", "One"], "p2": ["b2"], "p3": None}
    spans = spark.createDataFrame([("p1", 2, "b", "e2", 0, 1), ("p1", 1, "b", "e1", 0, 2)], "paragraph_id string, place int, block_id string, evidence_id string, span_start int, span_end int")
    seen = spark.createDataFrame([("e1", "ab", [0, 1], "h", "p")], "evidence_id string, text string, dom_path array<int>, href string, tag string")
    got = projections.enriched_spans(spans, seen).first().source_spans
    assert [(s.evidence_id, s.source_text) for s in got] == [("e1", "ab"), ("e2", None)]


def test_leaps(spark):
    rows = [("p1", [(["x"], "so", ["p1"]), ([], "so", []), (["x"], " ", []), (["x"], "so", ["p9"])])]
    df = spark.createDataFrame(rows, "paragraph_id string, leaps array<struct<premises:array<string>,inference:string,premise_paragraph_ids:array<string>>>")
    got = projections.leaps(df, spark.createDataFrame([("p1",)], "paragraph_id string")).collect()
    assert sorted(str(r.finding) for r in got) == ["None", "inference_missing", "premise_not_used", "premises_missing"]


def test_publication_rows(spark):
    assets = spark.createDataFrame([("o1", 1, 1), ("o2", 1, 2)], "occurrence_id string, page_id int, rank int")
    made = projections.synthetic_images(assets, spark.createDataFrame([("o1",)], "occurrence_id string")).collect()
    assert [r.text for r in made] == ["[[IMAGE o2]]"]
    chunks = spark.createDataFrame([("c1", "s1"), ("c2", "s2")], "chunk_id string, text_sha256 string")
    a = projections.embedding_manifest(chunks, [F.lit("r")]).first()
    assert a == projections.embedding_manifest(chunks.repartition(2), [F.lit("r")]).first() and a.chunk_count == 2
    assert a.invalidation_key != projections.embedding_manifest(chunks.limit(1), [F.lit("r")]).first().invalidation_key
    nav = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item int, path string")
    pages = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("b", "p3")], "path string, page_id string")
    assert {r.item: (r.page_id, r.status) for r in projections.nav_targets(nav, pages).collect()} == {1: ("p1", "ok"), 2: (None, "ambiguous"), 3: (None, "non_spine")}
    chapters = spark.createDataFrame([(1, "t1", 0, 2), (1, "t2", 2, 3)], "doc_id int, toc_id string, start_index int, end_index int")
    blocks = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 2, 2)], "doc_id int, at int, page_id int")
    images = spark.createDataFrame([(1, "i", 1), (1, "j", 2), (1, "k", 9)], "doc_id int, image_id string, page_id int")
    assert {(r.toc_id, r.image_id) for r in projections.chapter_images(chapters, blocks, images).collect()} == {("t1", "i"), ("t2", "j")}
    extent = projections.page_extent(spark.createDataFrame([(1, [0.0, 0.0, 5.0, 10.0])], "page_id int, box array<double>"), spark.createDataFrame([(1, 10.0, 10.0), (2, 1.0, 1.0)], "page_id int, width double, height double"))
    assert {r.page_id: r.image_coverage for r in extent.collect()} == {1: 0.5, 2: 0.0}
    outline = spark.createDataFrame([(1, 9, "Index "), (1, 7, "INDEX"), (2, 3, "End")], "doc_id int, source_page int, text string")
    assert {r.doc_id: r.index_page for r in projections.index_start(outline).collect()} == {1: 7, 2: None}


def test_resolutions(spark):
    findings = spark.createDataFrame([(i, "c") for i in range(1, 9)], "finding_id int, code string")
    names = ["source_image_hash_verified", "replacement_evidence_selected", "block_quarantined", "source_and_rendition_compared", "reading_order_verified", "visual_regions_reconciled", "unknown"]
    allowed = spark.createDataFrame([("c", n) for n in names], "code string, method string")
    rows = [(1, names[0], "agent", ["a", "b"], ["b", "a"], [], True), (2, names[1], "agent", ["a"], ["a"], ["a"], True), (3, names[2], "agent", ["a"], ["b"], [], None), (4, names[3], "agent", [], [], [], True), (5, names[4], "human", ["a", "b"], ["b", "a"], [], None), (6, names[5], "human", ["a", "b"], ["b", "a"], [], None), (7, names[6], "human", [], [], [], True)]
    methods = spark.createDataFrame(rows, "finding_id int, method string, reviewer_kind string, affected array<string>, referenced array<string>, replacement array<string>, sha_ok boolean")
    assert {r.finding_id for r in projections.resolved(findings, methods, allowed).where("resolved").collect()} == {1, 3, 6}
    log = spark.createDataFrame([(1, "raw", "x"), (2, "r2", "y"), (3, "raw", "z")], "seq int, canonical_revision string, target_id string")
    assert {r.seq: r.step for r in projections.replayed(log).collect()} == {1: 1, 2: 2, 3: 1}


def test_older_packages(spark):
    lines = spark.createDataFrame([(1, 1, "[c001_u0001] Hello"), (1, 2, "[[IMAGE img-1]]"), (1, 3, "[c001_u0002] World"), (2, 1, "[c002_u0001] x")], "chapter int, line int, text string")
    units = legacy.units(lines)
    assert [(r.unit_id, r.image_id) for r in units.orderBy("chapter", "line").collect()] == [("c001_u0001", None), (None, "img-1"), ("c001_u0002", None), ("c002_u0001", None)]
    assert legacy.mock_translation(units).where("chapter = 2").first().translated == "译文：x"
    got = {r.chapter: r.status for r in legacy.translation_audit(units, units.where("not (chapter = 1 and line = 1)")).collect()}
    assert got == {1: "FAIL_REVIEW", 2: "PASS"}
    old = spark.createDataFrame([("b1", 3, None, "Chapter 1", None, "pdf"), ("b2", None, None, "x", "caption_candidate", None)], "block_id string, page int, spine_index int, text string, block_kind string, source_type string")
    rows = {r.legacy_block_id: (r.page_id, r.block_kind, r.engine) for r in legacy.evidence_rows(old).collect()}
    assert rows == {"b1": ("legacy_00003", "heading_candidate", "pdf"), "b2": ("legacy_00001", "caption_candidate", "legacy")}
    pages = spark.createDataFrame([("k", 1, "a"), ("k", 1, "a"), ("k", 2, "a"), ("k", 2, "b"), ("k", 7, "c"), ("o", 3, "z")], "book_id string, page int, sha string")
    good, bad = legacy.page_scan(pages, "k")
    assert sorted(r.page for r in good.collect()) == [1, 7] and [r.page for r in bad.collect()] == [2]
    assert {(r.page, r.finding) for r in legacy.page_gaps(good, 4).collect()} == {(2, "missing"), (3, "missing"), (4, "missing"), (7, "extra")}
    s = spark.createDataFrame([(1, 60, 0), (1, 39, 0), (2, 99, 1)], "run int, score int, blockers int")
    assert {r.run: r.status for r in legacy.score(s).collect()} == {1: "PASS", 2: "FAIL"}
    assert {(r.root, r.n, r.known) for r in legacy.files_by_root(spark.createDataFrame([("a/b",), ("a/c",), ("z",)], "path string"), ["a"]).collect()} == {("a", 2, True), ("z", 1, False)}


def test_markup():
    assert markup.decode_markup(b"\xff\xfeh\x00i\x00") == "hi" and markup.decode_markup('<?xml version="1.0" encoding="latin-1"?>é'.encode("latin-1")).endswith("é")
    assert markup.decode_markup(b'<meta charset="cp1252">\x80')[-1] == "€"
    for bad in (b"\xff\xff", b'<meta charset="nope">x'):
        with pytest.raises(ValueError):
            markup.decode_markup(bad)
    css = "/* p{display:none} */ p.x, #y { color: red; DISPLAY : none } div{display:block} .z{visibility:hidden}"
    assert markup.selectors(css) == ["p.x", "#y", ".z"] and markup.selectors(css, hides=False) == ["div"]
    assert markup.selects("p.x", "p", {"class": "a x"}) and not markup.selects("p.x", "q", {"class": "x"}) and markup.selects("#y", "q", {"id": "y"}) and not markup.selects("p > q", "q", {})
    assert [markup.nav_type(x) for x in ("landmarks toc", "page-list x", "lot x", None)] == ["toc", "page-list", "lot", "other"]
    math = "<math xmlns='http://www.w3.org/1998/Math/MathML'><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mfrac><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><msqrt><mi>c</mi></msqrt></mfrac></math>"
    assert markup.linear_math(ElementTree.fromstring(math)) == "x^2=(a+b)/(√(c))"
