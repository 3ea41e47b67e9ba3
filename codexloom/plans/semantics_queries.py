"""Operators whose input no table holds, on literal rows: operator, key and value of each result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import acceptance, decisions, edits, integrity, legacy, objects, ocr, packages, projections, publishing, rendering, runs, spatial, structure
from .common import query, values


def _fact(df: DataFrame, operator: str, key: Column | str, value: Column | str) -> DataFrame:
    own = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    return df.select(F.lit(operator).alias("operator"), F.coalesce(own(key), F.lit("-")).alias("key"), F.coalesce(own(value), F.lit("-")).alias("value"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _sql(rows: list[tuple[str, str, str]]) -> str:
    return f"SELECT * FROM {values(rows, 'operator, key, value')}"


_TEXTS = [
    ("slug", " Hello, Wörld! ", "hello-w-rld"), ("slug", "!!!", "book"), ("heading_key", "Straße 1.2 — A_b", "strasse12a_b"), ("display_heading", "Notes [n-1]", "Notes"), ("repair_href", "http://a/(b))", "http://a/(b)"), ("parent_number", "2.3.1 Deep", "2.3"), ("parent_number", "1.2a", "-"),
    ("direction", "שלום abc", "rtl"), ("direction", "abc", "ltr"), ("section_type", "Part IV", "part_divider"), ("section_type", "Endnotes", "notes"), ("basename", "/a/b.c", "b.c"), ("suffix", "/a/B.TXT", ".txt"), ("suffix", ".hidden", ""), ("is_usable", "a" * 20, "true"), ("is_usable", "a" * 19, "false"),
    ("strip_list_marker", "3) y", "y"), ("strip_list_marker", "1999. z", "z"), ("scripts", "aб日", "Han,Latin"), ("scripts", "かな 한", "Hangul,Kana"), ("collapse", " a \n b ", "a b"),
]


@query(_sql(_TEXTS))
def q83_text_functions(spark, sf_dir):
    rows = spark.createDataFrame([(op, key) for op, key, _ in _TEXTS], "operator string, key string")
    made = {op: getattr(text, op)(F.col("key")) for op in dict.fromkeys(op for op, _, _ in _TEXTS)}
    made["scripts"] = F.array_join(made["scripts"], ",")
    value = reduce(lambda a, b: a.when(F.col("operator") == b[0], b[1].cast("string")), made.items(), F.when(F.lit(False), F.lit("")))
    return rows.select("operator", "key", F.coalesce(value, F.lit("-")).alias("value"))


_GEOMETRY = [("overlap_ratio", "a", "0.25"), ("overlaps", "a", "true"), ("overlaps", "b", "false"), ("distance", "c", "5.0"), ("rotate_180", "a", "90.0,40.0,100.0,50.0"), ("is_valid", "d", "false"), ("column_region", "e", "right"), ("nearest", "2", "4:200.0"), ("nearest", "4", "4:0.0"), ("nearest", "5", "5:0.0"), ("intersecting", "1", "2"), ("baseline_lines", "1", "1"), ("baseline_lines", "2", "1"), ("baseline_lines", "3", "1"), ("baseline_lines", "4", "2"), ("merge_supplemental", "1", "Existing line"), ("merge_supplemental", "2", "Panel quotation"), ("merge_supplemental", "3", "Footer"), ("page_extent", "1", "0.5"), ("page_extent", "2", "0.0")]


@query(_sql(_GEOMETRY))
def q84_boxes_and_lines(spark, sf_dir):
    box = lambda *x: F.array(*map(F.lit, map(float, x)))
    one, a, b = spark.range(1), box(0, 0, 10, 10), box(5, 5, 15, 15)
    joined = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    facts = [
        ("overlap_ratio", "a", geometry.overlap_ratio(a, b)), ("overlaps", "a", geometry.overlaps(a, b)), ("overlaps", "b", geometry.overlaps(a, box(10, 0, 20, 10))), ("distance", "c", geometry.distance(a, box(13, 14, 20, 20))), ("rotate_180", "a", joined(geometry.rotate_180(a, F.lit(100.0), F.lit(50.0)))),
        ("is_valid", "d", geometry.is_valid(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(1.0), F.lit(1.0)))), ("column_region", "e", geometry.column_region(box(300, 100, 400, 120), F.lit("x"), F.lit(500.0), F.lit(800.0))),
    ]
    parts = [_fact(one, op, F.lit(key), value) for op, key, value in facts]
    boxes = spark.createDataFrame([(1, 1, [0.0, 0.0, 10.0, 10.0]), (1, 2, [9.0, 9.0, 300.0, 20.0]), (1, 4, [500.0, 0.0, 510.0, 10.0]), (2, 5, [0.0, 0.0, 10.0, 10.0])], "page_id int, id int, box array<double>")
    parts.append(_fact(spatial.nearest(boxes, boxes.where("id in (4, 5)"), 250.0), "nearest", "box_id", F.concat_ws(":", "target_id", "distance")))
    parts.append(_fact(spatial.intersecting(boxes.where("id = 1"), boxes.where("id <> 1")), "intersecting", "left_id", "right_id"))
    words = spark.createDataFrame([(1, "left", i, t, t + 8.0, x) for i, (t, x) in enumerate([(10.0, 0.0), (11.0, 20.0), (12.5, 40.0), (30.0, 0.0)], 1)], "page_id long, region string, word_id long, top double, bottom double, left double")
    parts.append(_fact(ocr.baseline_lines(words), "baseline_lines", "word_id", "line"))
    rows = [(1, 1, "Existing line", [0.0, 0.0, 100.0, 10.0], False), (1, 2, "Footer", [0.0, 90.0, 50.0, 99.0], False), (1, 3, "existing  LINE", [0.0, 50.0, 100.0, 60.0], True), (1, 4, "Panel quotation", [0.0, 30.0, 100.0, 40.0], True), (1, 5, "over", [0.0, 91.0, 40.0, 98.0], True)]
    parts.append(_fact(ocr.merge_supplemental(spark.createDataFrame(rows, "page_id long, ordinal long, text string, box array<double>, supplemental boolean")), "merge_supplemental", "reading_order", "text"))
    extent = projections.page_extent(spark.createDataFrame([(1, [0.0, 0.0, 5.0, 10.0])], "page_id int, box array<double>"), spark.createDataFrame([(1, 10.0, 10.0), (2, 1.0, 1.0)], "page_id int, width double, height double"))
    return _all([*parts, _fact(extent, "page_extent", "page_id", "image_coverage")])


_PROJECTED = [
    ("structure_paths", "p1", "Part/One"), ("structure_paths", "p2", "b2"), ("structure_paths", "p3", "-"), ("enriched_spans", "p1", "e1:ab,e2"), ("leaps", "0", "-"), ("leaps", "1", "premises_missing"), ("leaps", "2", "inference_missing"), ("leaps", "3", "premise_not_used"), ("synthetic_images", "o2", "[[IMAGE o2]]"),
    ("nav_targets", "1", "p1:ok"), ("nav_targets", "2", "ambiguous"), ("nav_targets", "3", "non_spine"), ("chapter_images", "t1", "i"), ("chapter_images", "t2", "j"), ("index_start", "1", "7"), ("index_start", "2", "-"), ("least_depth", "abc", "1"), ("resolved", "1", "true"), ("resolved", "2", "false"), ("resolved", "3", "true"), ("replayed", "1", "1"), ("replayed", "2", "2"), ("replayed", "3", "1"),
]


@query(_sql(_PROJECTED))
def q85_projections(spark, sf_dir):
    make = spark.createDataFrame
    paths = projections.structure_paths(make([("p1",), ("p2",), ("p3",)], "paragraph_id string"), make([("b1", "T", ["Part", "One"], ["p1"]), ("b2", "", None, ["p2"])], "boundary_id string, title string, structure_path array<string>, paragraph_ids array<string>"))
    spans = projections.enriched_spans(make([("p1", 2, "b", "e2", 0, 1), ("p1", 1, "b", "e1", 0, 2)], "paragraph_id string, place int, block_id string, evidence_id string, span_start int, span_end int"), make([("e1", "ab", [0, 1], "h", "p")], "evidence_id string, text string, dom_path array<int>, href string, tag string"))
    leaps = projections.leaps(make([("p1", [(["x"], "so", ["p1"]), ([], "so", []), (["x"], " ", []), (["x"], "so", ["p9"])])], "paragraph_id string, leaps array<struct<premises:array<string>,inference:string,premise_paragraph_ids:array<string>>>"), make([("p1",)], "paragraph_id string"))
    named = make([("p1", 0), ("p1", 1), ("p1", 2), ("p1", 3)], "paragraph_id string, at int").withColumn("leap_id", projections.ids.stable_id("leap", F.col("paragraph_id"), F.col("at")))
    images = projections.synthetic_images(make([("o1", 1, 1), ("o2", 1, 2)], "occurrence_id string, page_id int, rank int"), make([("o1",)], "occurrence_id string"))
    nav = projections.nav_targets(make([(1, "a"), (2, "b"), (3, "c")], "item int, path string"), make([("a", "p1"), ("b", "p2"), ("b", "p3")], "path string, page_id string"))
    chapters = projections.chapter_images(make([(1, "t1", 0, 2), (1, "t2", 2, 3)], "doc_id int, toc_id string, start_index int, end_index int"), make([(1, 0, 1), (1, 1, 1), (1, 2, 2)], "doc_id int, at int, page_id int"), make([(1, "i", 1), (1, "j", 2), (1, "k", 9)], "doc_id int, image_id string, page_id int"))
    index = projections.index_start(make([(1, 9, "Index "), (1, 7, "INDEX"), (2, 3, "End")], "doc_id int, source_page int, text string"))
    depth = projections.least_depth(make([("A b-c", 2), ("abc", 1)], "title string, level int"))
    names = ("source_image_hash_verified", "replacement_evidence_selected", "block_quarantined")
    methods = make([(1, names[0], "agent", ["a", "b"], ["b", "a"], [], True), (2, names[1], "agent", ["a"], ["a"], ["a"], True), (3, names[2], "agent", ["a"], ["b"], [], None)], "finding_id int, method string, reviewer_kind string, affected array<string>, referenced array<string>, replacement array<string>, sha_ok boolean")
    settled = projections.resolved(make([(1, "c"), (2, "c"), (3, "c")], "finding_id int, code string"), methods, make([("c", n) for n in names], "code string, method string"))
    replay = projections.replayed(make([(1, "raw", "x"), (2, "r2", "y"), (3, "raw", "z")], "seq int, canonical_revision string, target_id string"))
    return _all([
        _fact(paths, "structure_paths", "paragraph_id", F.array_join("structure_path", "/")), _fact(spans, "enriched_spans", "paragraph_id", F.array_join(F.transform("source_spans", lambda s: F.concat_ws(":", s["evidence_id"], s["source_text"])), ",")), _fact(leaps.join(named.select("leap_id", "at"), "leap_id"), "leaps", "at", "finding"),
        _fact(images, "synthetic_images", F.col("asset_occurrence_ids")[0], "text"), _fact(nav, "nav_targets", "item", F.concat_ws(":", "page_id", "status")), _fact(chapters, "chapter_images", "toc_id", "image_id"), _fact(index, "index_start", "doc_id", "index_page"), _fact(depth, "least_depth", "title_key", "depth"), _fact(settled, "resolved", "finding_id", "resolved"), _fact(replay, "replayed", "seq", "step"),
    ])


_OLD = [
    ("units", "1/1", "c001_u0001"), ("units", "1/2", "img-1"), ("units", "1/3", "c001_u0002"), ("units", "1234/1", "c1234_u0001"), ("mock_translation", "c1234_u0001", "译文：x"), ("translation_audit", "1", "FAIL_REVIEW"), ("translation_audit", "1234", "PASS"), ("evidence_rows", "b1", "legacy_00003:heading_candidate:pdf"), ("evidence_rows", "b2", "legacy_00001:caption_candidate:legacy"), ("evidence_rows", "b3", "legacy_1234567:text_candidate:legacy"),
    ("page_scan", "1", "a"), ("page_scan", "7", "c"), ("page_scan_differs", "2", "2"), ("page_gaps", "2", "missing"), ("page_gaps", "3", "missing"), ("page_gaps", "4", "missing"), ("page_gaps", "7", "extra"), ("files_by_root", "a", "2:true"), ("files_by_root", "z", "1:false"), ("score", "1", "PASS"), ("score", "2", "FAIL"), ("crosswalk", "x", "n1"), ("crosswalk", "y", "-"), ("rag_sections", "a", "PASS"), ("rag_sections", "b", "MISSING"),
    ("latest_of_head", "p1", "2"), ("latest_of_head", "x", "3"), ("invalid", "5", "odd"), ("mixes_edits", "log", "false"), ("accept_fresh", "9", "used"), ("accept_clash", "2", "accepted"), ("not_revoked", "q", "q"), ("redact_path", "source_path", "b"), ("redact_path", "title", "/a/b"), ("unique_or_null", "1", "e"), ("unique_or_null", "2", "-"),
]


@query(_sql(_OLD))
def q86_older_packages_and_logs(spark, sf_dir):
    make = spark.createDataFrame
    units = legacy.units(make([(1, 1, "[c001_u0001] Hello"), (1, 2, "[[IMAGE img-1]]"), (1, 3, "[c001_u0002] World"), (1234, 1, "[c1234_u0001] x")], "chapter int, line int, text string"))
    old = make([("b1", 3, None, "Chapter 1", None, "pdf"), ("b2", None, None, "x", "caption_candidate", None), ("b3", 1234567, None, "y", None, None)], "block_id string, page int, spine_index int, text string, block_kind string, source_type string")
    good, bad = legacy.page_scan(make([("k", 1, "a"), ("k", 1, "a"), ("k", 2, "a"), ("k", 2, "b"), ("k", 7, "c"), ("o", 3, "z")], "book_id string, page int, sha string"), "k")
    log = make([(1, "page", "p1", "accepted", "s", "r", "raw"), (2, "page", "p1", "rejected", "s", "r", "raw"), (3, "paragraph", "x", "used", "s", "r", "raw"), (4, "paragraph", "x", "used", "s", "r", "old"), (5, "page", "p2", "odd", "s", "q", "raw")], "seq int, kind string, target_id string, disposition string, source_sha256 string, active_run_id string, canonical_revision string")
    fresh, clash = decisions.accept(log.select("seq", "disposition"), make([(1, "accepted"), (2, "accepted"), (9, "used")], "seq int, disposition string"), "seq", "disposition")
    walk = packages.crosswalk(make([("x", "k1"), ("y", "k2")], "old string, key string"), "old", make([("n1", "k1")], "new string, key string"), "new", "key", "block")
    audits = packages.rag_sections(make([("a",), ("b",)], "audit string"), make([("a", "PASS")], "audit string, status string"))
    stones = packages.revoke(make([], "package_id string, revocation_id string, reason string, revoked_at string"), "p", "x", "t")
    paths = make([("source_path", "/a/b"), ("title", "/a/b")], "key string, v string")
    engines = make([(1, "e"), (1, "e"), (2, "e"), (2, "f")], "page int, engine string").groupBy("page").agg(packages.unique_or_null("engine").alias("engine"))
    return _all([
        _fact(units, "units", F.concat_ws("/", "chapter", "line"), F.coalesce("unit_id", "image_id")), _fact(legacy.mock_translation(units).where("chapter = 1234"), "mock_translation", "unit_id", "translated"), _fact(legacy.translation_audit(units, units.where("not (chapter = 1 and line = 1)")), "translation_audit", "chapter", "status"),
        _fact(legacy.evidence_rows(old), "evidence_rows", "legacy_block_id", F.concat_ws(":", "page_id", "block_kind", "engine")), _fact(good, "page_scan", "page", "sha"), _fact(bad, "page_scan_differs", "page", "kinds"), _fact(legacy.page_gaps(good, 4), "page_gaps", "page", "finding"),
        _fact(legacy.files_by_root(make([("a/b",), ("a/c",), ("z",)], "path string"), ["a"]), "files_by_root", "root", F.concat_ws(":", "n", "known")), _fact(legacy.score(make([(1, 60, 0), (1, 39, 0), (2, 99, 1)], "run int, score int, blockers int")), "score", "run", "status"), _fact(walk, "crosswalk", "old_id", "new_id"), _fact(audits, "rag_sections", "audit", "status"),
        _fact(decisions.latest(decisions.of_head(log, "s", "r", "raw"), ["kind", "target_id"], ["seq"]), "latest_of_head", "target_id", "seq"), _fact(decisions.invalid(log), "invalid", "seq", "disposition"), _fact(decisions.mixes_edits(log), "mixes_edits", F.lit("log"), "mixed"), _fact(fresh, "accept_fresh", "seq", "disposition"), _fact(clash, "accept_clash", "seq", "disposition"),
        _fact(packages.not_revoked(make([("p",), ("q",)], "package_id string"), stones), "not_revoked", "package_id", "package_id"), _fact(paths, "redact_path", "key", packages.redact_path(F.col("v"), F.col("key"), F.lit("tenant"))), _fact(engines, "unique_or_null", "page", "engine"),
    ])


_EDITED = [
    ("correct", "b2", "3"), ("exclude", "b3", "excluded"), ("select_variant", "b1", "new"), ("select_variant", "b2", "old"), ("resegment", "s1", "one"), ("resegment", "s2", " twothree"), ("list_item", "1", "  1. x"), ("list_item", "2", "- y"), ("list_item", "3", "z"), ("list_item", "4", "1999. t"), ("reference_findings", "a", "repeated"), ("reference_findings", "b", "unused"), ("reference_findings", "z", "unknown"),
    ("table_findings", "t2", "0"), ("table_findings", "t3", "1"), ("hidden_leaks", "c1", "c1"), ("dom_regressions", "2", "1"), ("reconcile_runs", "a", "changed"), ("reconcile_runs", "b", "missing"), ("reconcile_runs", "c", "unexpected"), ("same_sets", "1", "true"), ("is_permutation", "1", "false"), ("on_disk", "p", "runs/r/p.png:spine_item"), ("on_disk", "q", "/x/q.png:page"),
    ("placed_after", "i1", "a2:true"), ("placed_after", "i2", "a1:false"), ("placed_after", "i3", "false"), ("under", "1", "true"), ("under", "2", "false"), ("component_order", "1", "b"), ("component_order", "2", "c"), ("component_order", "3", "a"), ("component_order", "4", "d"),
]


def _edited(spark: SparkSession) -> list[DataFrame]:
    make = spark.createDataFrame
    blocks = make([(1, f"b{i}", i, t) for i, t in enumerate(["one two", "three", "four"], 1)], "doc_id int, block_id string, ordinal int, text string")
    cut = make([("s1", "b1", 0, 3, "text"), ("s2", "b1", 3, 7, "text"), ("s2", "b2", 0, 5, "text")], "segment string, block_id string, span_start int, span_end int, kind string")
    seen = make([("e1", 1, "g", "old"), ("e2", 1, "g", "new"), ("e3", 2, "g", "far")], "evidence_id string, page_id int, variant_group_id string, text string")
    own = make([("b1", 1, "e1", "old"), ("b2", 1, "e1", "old")], "block_id string, page_id int, evidence_id string, text string")
    items = make([(1, ["li", "ol", "div", "ul"], "1. x"), (2, ["li", "ul"], "- y"), (3, ["p"], "z"), (4, ["li", "ol"], "1999. t")], "i int, tags array<string>, t string").withColumn("s", rendering.list_semantics(F.col("tags")))
    return [
        _fact(edits.correct(blocks, make([("b2", "3")], "block_id string, new_text string")).where("ordinal = 2"), "correct", "block_id", "text"), _fact(edits.exclude(blocks, make([("b3", "noise")], "block_id string, reason string")).where("exclusion_reason is not null"), "exclude", "block_id", "canonical_disposition"),
        _fact(edits.select_variant(own, seen, make([("b1", "e2"), ("b2", "e3")], "block_id string, selected string")), "select_variant", "block_id", "text"), _fact(edits.resegment(blocks, cut), "resegment", "segment", "text"), _fact(items, "list_item", "i", rendering.list_item(F.col("t"), F.col("s"))),
    ]


@query(_sql(_EDITED))
def q87_edits_and_findings(spark, sf_dir):
    make = spark.createDataFrame
    parts = _edited(spark)
    parts.append(_fact(publishing.reference_findings(make([("a",), ("b",), ("c",)], "k string"), make([("a",), ("a",), ("c",), ("z",)], "k string"), "k"), "reference_findings", "k", "finding"))
    parts.append(_fact(publishing.table_findings(make([("t1", "x"), ("t2", "y"), ("t3", "z")], "object_id string, markdown string"), make([("t1", "x"), ("t3", "other")], "object_id string, text string")), "table_findings", "object_id", "n"))
    parts.append(_fact(acceptance.hidden_leaks(make([("c1", 1, [0, 1]), ("c2", 1, [0, 2])], "chunk_id string, page_id int, dom_path array<int>"), make([(1, [0, 1])], "page_id int, dom_path array<int>")), "hidden_leaks", "chunk_id", "chunk_id"))
    parts.append(_fact(acceptance.dom_regressions(make([(1, 1, [[0, 2]]), (1, 2, [[0, 1], [0, 3]]), (2, 3, [[0]])], "page_id int, order int, dom_paths array<array<int>>")), "dom_regressions", "order", "page_id"))
    digests = lambda *rows: make(list(rows), "name string, digest string")
    parts.append(_fact(runs.reconcile(digests(("a", "1"), ("b", "2"), ("d", "4")), digests(("a", "9"), ("c", "3"), ("d", "4"))), "reconcile_runs", "name", "finding"))
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1), F.lit(1))
    parts += [_fact(spark.range(1), "same_sets", F.lit(1), integrity.same_sets(a, b)), _fact(spark.range(1), "is_permutation", F.lit(1), integrity.is_permutation(b))]
    parts.append(_fact(runs.on_disk(make([("p", "p.png", "epub"), ("q", "/x/q.png", "pdf")], "page_id string, page_image_path string, format string"), "r"), "on_disk", "page_id", F.concat_ws(":", "page_image_path", "surface_kind")))
    images, anchors = make([(1, "i1", 5), (1, "i2", 1), (2, "i3", 1)], "page_id int, id string, rank int"), make([(1, "a1", 2), (1, "a2", 4), (1, "a3", 9)], "page_id int, id string, rank int")
    parts.append(_fact(objects.placed_after(images, anchors), "placed_after", "image_id", F.concat_ws(":", "anchor_id", "is_after")))
    inner = make([(1, [0, 1], [0, 1, 2]), (2, [0, 1], [0, 2, 1])], "k int, outer array<int>, inner array<int>")
    parts.append(_fact(inner, "under", "k", structure.under(F.col("outer"), F.col("inner"))))
    pieces = make([(1, 1, "a", [50.0, 1.0, 60.0, 9.0]), (1, 2, "b", [0.0, 4.0, 9.0, 9.0]), (1, 2, "c", [0.0, 20.0, 9.0, 30.0]), (1, 3, "d", [0.0, 12.0, 5.0, 14.0])], "page_id int, component int, id string, box array<double>")
    return _all([*parts, _fact(objects.component_order(pieces), "component_order", "rank", "id")])


_MORE = [
    ("text_pieces", "1:1", "h1:Title & more"), ("text_pieces", "1:2", "p:two lines\nof <text>"), ("text_pieces", "1:3", "h2:Sub"), ("text_pieces", "2:1", "p:tag © 2"), ("problems", "old", "missing_required_audit:audit/cleaning_audit.json"), ("problems", "old", "upstream_audit_not_pass:audit/ocr_audit.json"), ("problems", "none", "missing_required_artifact:ledger/source_blocks.jsonl"), ("problems", "none", "source_coverage_gap:ledger/source_blocks.jsonl"),
    ("validated", "old", "PASS"), ("validated", "none", "FAIL_REVIEW"), ("outline_candidates", "1", "1:One two:5"), ("outline_candidates", "4", "2:Two:-"), ("recogniser_language", "zh-CN", "chi_sim+eng"), ("recogniser_language", "", "eng"), ("recogniser_language", "SV-x", "sv"), ("vector_figures", "c1", "82.0,87.0,203.0,203.0"), ("vector_figures", "c4", "47.0,301.0,103.0,363.0"),
]


@query(_sql(_MORE))
def q88_pieces_outlines_figures(spark, sf_dir):
    from ..sources import ledgers

    make = spark.createDataFrame
    pieces = ledgers.text_pieces(make([(1, "# Title &amp; more\n\ntwo lines\nof &lt;text&gt;\n \n \n\n## Sub\n\n# "), (2, "#tag &copy; 2"), (3, "")], "k int, t string"), "k", "t")
    old = make([("old",), ("none",)], "package_id string")
    there = [("old", p, "PASS") for p in (*legacy.REQUIRED, legacy.SEMANTIC, *(f"audit/{a}.json" for a in legacy.AUDITS[1:-1]))] + [("none", p, "PASS") for p in (legacy.REQUIRED[0], legacy.SEMANTIC, *(f"audit/{a}.json" for a in legacy.AUDITS))]
    files, blocks = make([(k, p, "FAIL" if k == "old" and "ocr" in p else s) for k, p, s in there], "package_id string, path string, status string"), make([("old",)], "package_id string")
    outline = projections.outline_candidates(make([(1, 1, 1, " One  two", 5), (1, 2, 1, " ", 6), (1, 3, 0, "x", 7), (1, 4, 2, "Two", -1)], "doc_id int, place int, level int, title string, page int"))
    clusters = make([(1, "c1", [100.0, 100.0, 150.0, 150.0]), (1, "c1", [140.0, 140.0, 200.0, 200.0]), (1, "c2", [400.0, 400.0, 410.0, 410.0]), (1, "c3", [300.0, 10.0, 360.0, 60.0]), (1, "c4", [50.0, 300.0, 100.0, 360.0])], "page_id int, caption_id string, box array<double>")
    captions = make([(1, "c1", [100.0, 210.0, 200.0, 220.0]), (1, "c2", [0.0, 0.0, 1.0, 1.0]), (1, "c3", [300.0, 62.0, 360.0, 70.0]), (1, "c4", [50.0, 290.0, 100.0, 300.0])], "page_id int, id string, box array<double>")
    drawings = make([(1, [100.0 + k, 100.0, 100.0 + k, 200.0]) for k in range(3)] + [(1, [400.0, 400.0, 401.0, 401.0 + k]) for k in range(5)] + [(1, [300.0, 10.0, 301.0, 20.0])] + [(1, [50.0, 300.0 + k, 100.0, 300.0 + k]) for k in range(3)], "page_id int, box array<double>")
    texts = make([(1, "a label", [85.0, 90.0, 99.0, 99.0]), (1, "far", [500.0, 500.0, 510.0, 510.0]), (1, "w " * 13, [60.0, 90.0, 99.0, 99.0])], "page_id int, text string, box array<double>")
    figures = spatial.vector_figures(clusters, captions, drawings, texts, make([(1, 600.0, 800.0)], "page_id int, width double, height double"))
    langs = make([("zh-CN",), ("",), ("SV-x",)], "lang string")
    return _all([
        _fact(pieces, "text_pieces", F.concat_ws(":", "k", "ordinal"), F.concat_ws(":", "tag", "text")), _fact(legacy.problems(old, files, blocks, True), "problems", "package_id", F.concat_ws(":", "kind", "path")), _fact(legacy.validated(old, legacy.problems(old, files, blocks)), "validated", "package_id", "status"),
        _fact(outline, "outline_candidates", "place", F.concat_ws(":", "level", "title", F.coalesce(F.col("source_page").cast("string"), F.lit("-")))), _fact(langs, "recogniser_language", "lang", text.recogniser_language(F.col("lang"))), _fact(figures, "vector_figures", "caption_id", F.array_join(F.transform("clip", lambda x: x.cast("string")), ",")),
    ])
