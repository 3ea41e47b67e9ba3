"""Operators on literal rows."""

import hashlib
import time

from pyspark.sql import functions as F

from codexloom.functions import geometry, ids, text
from codexloom.operators import decisions, edits, graph, integrity, ledger, ocr, ordering, packages, passages, publishing, rendering, spatial, structure
from codexloom.plans import gates


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(spark, f, *inputs):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_ids(spark):
    assert one(spark, ids.stable_id("ev", F.lit("a"), F.lit(1), F.lit(None).cast("string"))) == "ev_" + sha("a|1|None")[:16]
    assert one(spark, ids.spans_json(F.lit("b"), F.lit("e"), F.lit(0), F.lit(5))) == '[{"block_id": "b", "end_offset": 5, "evidence_id": "e", "start_offset": 0}]'


def test_text_functions(spark):
    v = lambda f, *x: values(spark, f, *x)
    assert v(text.collapse, " a \n b ", "") == ["a b", ""]
    assert v(text.slug, " Hello, Wörld! ", "中文 title", "!!!") == ["hello-w-rld", "中文-title", "book"]
    assert v(text.heading_key, "Straße 1.2 — A_b") == ["strasse12a_b"]
    assert v(text.display_heading, "Notes [n-1]", "Plain") == ["Notes", "Plain"]
    assert v(text.escape_markdown, "# of Shots\nx\n---", "#hash\n   ===") == ["\\# of Shots\nx\n\\---", "#hash\n   \\==="]
    assert v(text.repair_href, "http://a/(b))", "x)", "(x)") == ["http://a/(b)", "x", "(x)"]
    assert v(text.parent_number, "2.3.1 Deep", "*1.2 x", "2 Top", "1.2a") == ["2.3", "1", None, None]
    assert v(text.scripts, "aб日", "שלום مرحبا", "かな 한", "हि") == [["Han", "Latin"], ["Arabic", "Hebrew"], ["Hangul", "Kana"], ["Devanagari"]]
    assert v(text.direction, "שלום abc", "abc", "") == ["rtl", "ltr", "ltr"]
    assert v(text.block_kind, "Chapter 1", "chapters", "第三章 x", "Figure 3. y", "plain") == ["heading_candidate", "text_candidate", "heading_candidate", "caption_candidate", "text_candidate"]
    assert v(text.section_type, "Cover page", "Part IV", "Subject INDEX", "Endnotes", "One", "第二部") == ["frontmatter", "part_divider", "index", "notes", "body_chapter", "part_divider"]
    assert v(text.is_secret, "sk-abcdefghijklmnopq", "sk-x", "API-KEY = abcdefghijklmnopq") == [True, False, True]
    assert v(text.basename, "/a/b.c", "x", "/") == ["b.c", "x", ""] and v(text.suffix, "/a/B.TXT", "a.b/c", ".hidden") == [".txt", "", ""]
    assert v(text.is_usable, "a" * 20, "a" * 19, "a" * 50 + "�") == [True, False, False]
    assert v(text.strip_list_marker, "- x", "3) y", "1999. z", "plain") == ["x", "y", "z", "plain"]
    assert v(lambda c: text.renders_as_list_item(c, F.lit("ordered")), "1999. Title", "1. Title") == [False, True]
    assert v(lambda c: text.is_plate_text(c, F.lit(0.3), F.lit(True)), "ISBN 123-4", "www.abc.org", "plain") == [True, True, False]


def test_dom_kinds(spark):
    rows = [("x", "math", [], None, False, False, "equation_candidate"), ("x", "img", [], None, True, False, "callout_candidate"), ("x", "span", ["pre"], None, None, None, "code_candidate"), ("x", "p", ["td", "table"], None, None, None, "table_candidate"), ("x", "p", [], None, None, True, "caption_candidate"), ("Part I", "p", [], None, None, None, "heading_candidate"), ("My notes", "p", [], None, None, None, "structure_candidate"), ("x", "p", [], "img-caption", None, None, "caption_candidate"), ("x", "p", None, None, None, None, "text_candidate")]
    df = spark.createDataFrame(rows, "t string, tag string, up array<string>, css string, callout boolean, fig boolean, want string")
    assert all(r.got == r.want for r in df.select("want", text.dom_block_kind(F.col("t"), F.col("tag"), F.col("up"), F.col("css"), F.col("callout"), F.col("fig")).alias("got")).collect())


def test_geometry(spark):
    box = lambda *x: F.array(*map(F.lit, map(float, x)))
    a, b = box(0, 0, 10, 10), box(5, 5, 15, 15)
    assert one(spark, geometry.overlap_ratio(a, b)) == 0.25 and one(spark, geometry.overlaps(a, b)) and not one(spark, geometry.overlaps(a, box(10, 0, 20, 10)))
    assert one(spark, geometry.distance(a, box(13, 14, 20, 20))) == 5.0
    assert one(spark, geometry.rotate_180(a, F.lit(100.0), F.lit(50.0))) == [90.0, 40.0, 100.0, 50.0]
    assert one(spark, geometry.is_valid(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(1.0), F.lit(1.0)))) is False
    assert one(spark, geometry.polygon_box(F.array(box(1, 5), box(3, 2)))) == [1.0, 2.0, 3.0, 5.0]
    assert one(spark, geometry.column_region(box(300, 100, 400, 120), F.lit("x"), F.lit(500.0), F.lit(800.0))) == "right"


def test_partition_check(spark):
    blocks = spark.createDataFrame([("ok", 10), ("gap", 10), ("lap", 10), ("none", 5), ("empty", 0), ("long", 4)], "block_id string, size int")
    spans = spark.createDataFrame([("ok", 0, 4), ("ok", 4, 4), ("ok", 4, 10), ("gap", 0, 3), ("gap", 5, 10), ("lap", 0, 6), ("lap", 5, 10), ("long", 0, 5)], "block_id string, span_start int, span_end int")
    got = {r.block_id: r.status for r in integrity.partition_check(blocks, spans).collect()}
    assert got == {"ok": "ok", "gap": "gap", "lap": "overlap", "none": "missing", "empty": "ok", "long": "overlap"}


def test_integrity_sets(spark):
    rows = spark.createDataFrame([(1,), (2,), (5,), (20_001,), (3,)], "i int")
    assert sorted(r.missing for r in integrity.missing_indexes(rows, "i").limit(3).collect())[0] == 4
    assert integrity.missing_indexes(rows, "i").count() == 20_001 - 5
    far = spark.createDataFrame([(2,), (3_000_000,), (2_500_001,)], "i long")  # gaps across buckets of every level
    assert integrity.missing_indexes(far, "i").count() == 3_000_000 - 3
    assert integrity.missing_indexes(far.limit(0), "i").count() == 0
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1), F.lit(1))
    assert one(spark, integrity.same_sets(a, b)) and one(spark, integrity.is_permutation(F.array(F.lit(4), F.lit(3), F.lit(5)))) and not one(spark, integrity.is_permutation(b))


def test_decision_log(spark):
    log = spark.createDataFrame([(1, "page", "p1", "accepted", "s", "r", "raw"), (2, "page", "p1", "rejected", "s", "r", "raw"), (3, "paragraph", "x", "used", "s", "r", "raw"), (4, "paragraph", "x", "used", "s", "r", "old"), (5, "page", "p2", "odd", "s", "q", "raw")], "seq int, kind string, target_id string, disposition string, source_sha256 string, active_run_id string, canonical_revision string")
    head = decisions.of_head(log, "s", "r", "raw")
    assert [r.seq for r in decisions.latest(head, ["kind", "target_id"], ["seq"]).orderBy("seq").collect()] == [2, 3]
    assert [r.seq for r in decisions.invalid(log).collect()] == [5]
    assert decisions.mixes_edits(log).first().mixed is False
    fresh, clash = decisions.accept(log.select("seq", "disposition"), spark.createDataFrame([(1, "accepted"), (2, "accepted"), (9, "used")], "seq int, disposition string"), "seq", "disposition")
    assert [r.seq for r in fresh.collect()] == [9] and [r.seq for r in clash.collect()] == [2]


def test_hash_chain_tampering(spark):
    genesis = sha("genesis")
    rows = [(i, c, p, h) for i, (c, (p, h)) in enumerate(zip("abcde", decisions.extend_chain(genesis, "abcde"), strict=True))]
    check = lambda rs: [(r.linked, r.intact) for r in decisions.verify_chain(spark.createDataFrame(rs, "i int, content string, prev string, own string").withColumn("g", F.lit(1)), "g", ["i"], "content", "prev", "own", F.lit(genesis)).orderBy("i").collect()]
    assert check(rows) == [(True, True)] * 5
    changed = [r if r[0] != 2 else (2, "X", r[2], r[3]) for r in rows]
    assert check(changed) == [(True, True), (True, True), (True, False), (True, True), (True, True)]
    assert check([r for r in rows if r[0] != 2])[2] == (False, True)


def test_edits(spark):
    blocks = spark.createDataFrame([(1, f"b{i}", i, t) for i, t in enumerate(["one two", "three", "four"], 1)], "doc_id int, block_id string, ordinal int, text string")
    parts = edits.split_at(blocks, F.when(F.col("block_id") == "b1", 3).otherwise(0)).orderBy("ordinal", "part").collect()
    assert [p.text for p in parts] == ["one", " two", "three", "four"] and parts[2].block_id == "b2"
    joined = edits.join_groups(blocks, F.when(F.col("ordinal") == 2, 0).otherwise(1)).orderBy("ordinal").collect()
    assert [(j.text, j.valid) for j in joined] == [("one two four", False), ("three", True)]
    fixed = edits.correct(blocks, spark.createDataFrame([("b2", "3")], "block_id string, new_text string"))
    assert [r.text for r in fixed.orderBy("ordinal").collect()] == ["one two", "3", "four"]
    out = edits.exclude(blocks, spark.createDataFrame([("b3", "noise")], "block_id string, reason string")).orderBy("ordinal").collect()
    assert [r.canonical_disposition for r in out] == ["included", "included", "excluded"]
    cut = spark.createDataFrame([("s1", "b1", 0, 3, "text"), ("s2", "b1", 3, 7, "text"), ("s2", "b2", 0, 5, "text")], "segment string, block_id string, span_start int, span_end int, kind string")
    assert [r.text for r in edits.resegment(blocks, cut).orderBy("segment").collect()] == ["one", " twothree"]
    seen = spark.createDataFrame([("e1", 1, "g", "old"), ("e2", 1, "g", "new"), ("e3", 2, "g", "far")], "evidence_id string, page_id int, variant_group_id string, text string")
    own = spark.createDataFrame([("b1", 1, "e1", "old"), ("b2", 1, "e1", "old")], "block_id string, page_id int, evidence_id string, text string")
    picked = edits.select_variant(own, seen, spark.createDataFrame([("b1", "e2"), ("b2", "e3")], "block_id string, selected string")).orderBy("block_id").collect()
    assert [(r.text, r.evidence_id) for r in picked] == [("new", "e2"), ("old", "e1")]


def test_heading_paths(spark):
    rows = spark.createDataFrame([(1, ["Part I"]), (2, ["Interstitial"]), (3, ["Part I", "Chapter 1"]), (4, ["Part I", "Chapter 1", "A", "B [x.1]"])], "n int, path array<string>")
    got = structure.heading_emission(rows, "path", ["n"]).orderBy("n", "path").collect()
    assert [(r.heading, r.level) for r in got] == [("Part I", 2), ("Interstitial", 2), ("Chapter 1", 3), ("A", 3), ("B", 3)]
    items = spark.createDataFrame([(i, p) for i, p in enumerate([["Cover"], ["Copyright"], ["Chapter 1"], ["Chapter 1", "Section A"]])], "i int, structure_path array<string>")
    chosen = spark.createDataFrame([(["Chapter 1", "Section A"],)], "structure_path array<string>")
    assert sorted(r.i for r in structure.published_items(items, chosen).collect()) == [2, 3]


def test_lists(spark):
    rows = spark.createDataFrame([(1, ["li", "ol", "div", "ul"], "1. x"), (2, ["li", "ul"], "- y"), (3, ["p"], "z"), (4, ["li", "ol"], "1999. t")], "i int, tags array<string>, t string")
    got = rows.withColumn("s", rendering.list_semantics(F.col("tags"))).select("i", rendering.list_item(F.col("t"), F.col("s")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == ["  1. x", "- y", "z", "1999. t"]


def test_spatial(spark):
    boxes = spark.createDataFrame([(1, 1, [0.0, 0.0, 10.0, 10.0]), (1, 2, [9.0, 9.0, 300.0, 20.0]), (1, 3, [290.0, 15.0, 310.0, 400.0]), (1, 4, [500.0, 0.0, 510.0, 10.0]), (2, 5, [0.0, 0.0, 10.0, 10.0])], "page_id int, id int, box array<double>")
    assert {r.id: r.component for r in spatial.overlap_groups(boxes).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    near = {r.box_id: (r.target_id, r.distance) for r in spatial.nearest(boxes, boxes.where("id in (4, 5)"), 250.0).collect()}
    assert near == {2: (4, 200.0), 3: (4, (190.0**2 + 5.0**2) ** 0.5), 4: (4, 0.0), 5: (5, 0.0)}
    hits = spatial.intersecting(boxes.where("id = 1"), boxes.where("id <> 1"))
    assert [(r.left_id, r.right_id) for r in hits.collect()] == [(1, 2)]


def test_recognition(spark):
    rows = [(1, 1, "Existing line", [0.0, 0.0, 100.0, 10.0], False), (1, 2, "Footer", [0.0, 90.0, 50.0, 99.0], False), (1, 3, "existing  LINE", [0.0, 50.0, 100.0, 60.0], True), (1, 4, "Panel quotation", [0.0, 30.0, 100.0, 40.0], True), (1, 5, "over", [0.0, 91.0, 40.0, 98.0], True)]
    got = ocr.merge_supplemental(spark.createDataFrame(rows, "page_id long, ordinal long, text string, box array<double>, supplemental boolean")).orderBy("reading_order").collect()
    assert [r.text for r in got] == ["Existing line", "Panel quotation", "Footer"]
    words = spark.createDataFrame([(1, "left", i, t, t + 8.0, x) for i, (t, x) in enumerate([(10.0, 0.0), (11.0, 20.0), (12.5, 40.0), (30.0, 0.0)])], "page_id long, region string, word_id long, top double, bottom double, left double")
    assert [r.line for r in ocr.baseline_lines(words).orderBy("word_id").collect()] == [1, 1, 1, 2]


def test_gates_fail_one_at_a_time(spark):
    docs = spark.createDataFrame([(1, "abc", 3), (2, "de", 2)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    good = {"documents": docs, "labels": labels, "orders": spark.createDataFrame([(1, 1)], "o_orderkey long, o_custkey long"), "customer": spark.createDataFrame([(1,)], "c_custkey long"), "conversations": spark.createDataFrame([(1, 0), (1, 1)], "conv_id long, turn long")}
    failed = lambda t: {r.check_id for r in gates.evaluate(t).where("not passed").collect()}
    assert failed(good) == set()
    assert failed(good | {"conversations": good["conversations"].where("turn = 1")}) == {"turn_accounting"}
    assert failed(good | {"labels": labels.where("doc_id = 1")}) == {"manual_page_review"}
    assert failed(good | {"documents": docs.withColumn("n_chars", F.lit(9))}) == {"length_binding"}
    assert failed(good | {"documents": docs.union(docs.where("doc_id = 1"))}) == {"no_duplicate_identity"}
    checks = gates.evaluate(good | {"labels": labels.where("doc_id = 1")})
    assert [publishing.verdict(checks, t).first().status for t in ("hint", "review", "citation")] == ["HINT_READY", "REVIEW_READY", "FAIL_REVIEW"]


def test_publication(spark, data):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    rows = publishing.chunks(ledger.paragraphs(ledger.canonical(ledger.evidence(ledger.lines(docs)))), "r", "raw")
    assert publishing.chunk_findings(rows).isEmpty()
    assert [r.markdown for r in publishing.markdown(rows, "T").orderBy("doc_id").collect()][0] == "---\nsource: 1\n---\n\n# T\n\na\n\nb\n"
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    uses = spark.createDataFrame([("a",), ("a",), ("c",), ("z",)], "k string")
    assert {(r.k, r.finding) for r in publishing.reference_findings(items, uses, "k").collect()} == {("a", "repeated"), ("b", "unused"), ("z", "unknown")}


def test_packages(spark):
    assert one(spark, packages.package_name(F.lit("x/My Book.pdf"))) == "my-book_" + sha("x/My Book.pdf")[:12]
    kind = lambda g, f, n: one(spark, packages.document_kind(F.lit(g), F.lit(f), F.lit(n)))
    assert (kind("auto", "pdf", 30), kind("auto", "pdf", 29), kind("memo", "pdf", 1), kind(None, "epub", 1)) == ("book", "paper", "memo", "book")
    stones = spark.createDataFrame([], "package_id string, revocation_id string, reason string, revoked_at string")
    twice = packages.revoke(packages.revoke(stones, "p", "x", "t"), "p", "y", "t")
    assert twice.count() == 1 and packages.not_revoked(spark.createDataFrame([("p",), ("q",)], "package_id string"), twice).count() == 1
    assert one(spark, packages.redact_path(F.lit("/a/b"), F.lit("source_path"), F.lit("tenant"))) == "b"


def test_tree(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "own string, source string")
    assert {r.own: r.origin for r in graph.follow_derivation(rows, "own", "source").collect()} == {"a": "a", "b": "a", "c": "a"}


def test_passages(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "a quick  brown fox jumps over"), (3, "ab"), (4, None)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "quick brown fox jumps over it"), (2, "k brown fox jumps over i"), (3, "b"), (4, "he quick brown fox jumps ov"), (5, "absent words in a row here"), (6, "k br"), (7, "a quick  brown"), (8, " "), (9, "brown fox jumps"), (10, "fox jumps over it"), (11, "ox"), (12, "")], "item_id int, passage string")
    want = {(d, i) for d, t in ((r.doc_id, r.text) for r in docs.collect()) for i, p in ((r.item_id, r.passage) for r in items.collect()) if t and p and p in t}
    assert "Cartesian" not in passages.contained(docs, items)._jdf.queryExecution().toString()
    assert {(r.doc_id, r.item_id) for r in passages.contained(docs, items).collect()} == want and want


def test_passages_without_an_inner_word(spark):
    """Every short piece of odd texts, with blanks of several kinds and characters beyond 16 bits, against a plain search."""
    texts = ["for  that\t\nxy\u00a0z", " \U0001f600a\U0001f601 b", "%%%", "", None, "  ", "a\n\nb", "wordwithoutblanks", "\x0b\x0cé e\u0301"]
    pieces = sorted({t[a:b] for t in texts if t for a in range(len(t)) for b in range(a + 1, min(a + 6, len(t)) + 1)}) + ["nowhere", "for that", "%%%%", " \n\n", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    items = spark.createDataFrame(list(enumerate(pieces)), "item_id int, passage string")
    want = sorted((d, i) for d, t in enumerate(texts) for i, p in enumerate(pieces) if t and p and p in t)
    assert sorted((r.doc_id, r.item_id) for r in passages.contained(docs, items).collect()) == want


def test_short_passages_in_a_long_text(spark):
    """The time grows with the text's length, not with its square."""
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words, "), 60_000), F.repeat(F.lit("xyz"), 100_000), F.lit(" zq")).alias("text"))
    items = spark.createDataFrame([(1, "zq"), (2, "zx"), (3, "e w"), (4, "yy"), (5, "s, s")], "item_id int, passage string")
    began = time.monotonic()
    assert sorted(r.item_id for r in passages.contained(docs, items).collect()) == [1, 2, 3, 5]
    assert time.monotonic() - began < 60


def test_numbers_and_digests_of_a_whole_table(spark):
    rows = spark.createDataFrame([(i * 7 % 101, f"v{i * 7 % 101}") for i in range(101)], "k int, v string").repartition(5)
    out = ordering.with_next(ordering.numbered(rows, ["k"], "place"), "place", "v", "next").collect()
    assert all(r.place == r.k + 1 and r.next == (f"v{r.k + 1}" if r.k < 100 else None) for r in out) and len(out) == 101
    groups = rows.withColumn("g", F.when(F.col("k") % 3 > 0, F.col("k") % 3))
    got = {r.group_: (r.n, r.digest) for r in ordering.root_digest(groups, F.col("g"), F.col("v")).collect()}
    def root(lines):
        parts = {}
        for x in sorted(lines):
            parts.setdefault(sha(x)[:2], []).append(x)
        return sha("\n".join(f"{k}:{sha(chr(10).join(parts[k]))}" for k in sorted(parts)))

    assert got == {g: (len(x), root(x)) for g, x in ((g, [f"v{i}" for i in range(101) if i % 3 == k]) for g, k in ((None, 0), ("1", 1), ("2", 2)))}


def test_parents_at_any_depth(spark):
    """Navigation down to 12 levels and up again, with a jump, against a plain search."""
    depths = [*range(13), 12, 5, 7, 6, 11, 3, 4, 0, 1, 10, 11, 9, 12]
    rows = [(1, i, d) for i, d in enumerate(depths)] + [(2, i, d) for i, d in enumerate(reversed(depths))]
    want = {}
    for g, i, d in rows:
        above = [(j, e) for h, j, e in rows if h == g and j < i and e < d]
        want[g, i] = above[-1][0] if above and above[-1][1] == d - 1 else None
    got = structure.parents_by_depth(spark.createDataFrame(rows, "g int, i int, d int"), "g", "i", "d", "i").collect()
    assert {(r.g, r.i): r.parent for r in got} == want and want[1, 12] == 11
