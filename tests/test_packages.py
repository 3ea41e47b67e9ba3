"""Objects, runs and the checks of a whole package."""

import pytest
from pyspark.sql import functions as F

from codexloom.operators import acceptance, decisions, ledger, objects, publishing, rendering, runs

OBSERVED = "evidence_id string, page_id int, ordinal int, text string, block_kind string, table string, row int, column int, tag string, container string, pre_path string, figure string, dom_path array<int>, box array<double>"
ASSETS = "occurrence_id string, page_id int, figure string, rank int, box array<double>, callout boolean, dom_path array<int>"


@pytest.fixture(scope="module")
def observed(spark):
    none = [None] * 4
    rows = [
        ("e2", 1, 2, "b", "table_candidate", "t1", 0, 1, "th", None, None, None, None, None), ("e1", 1, 1, "a", "table_candidate", "t1", 0, 0, "th", None, None, None, None, None), ("e3", 1, 3, "c", "table_candidate", "t1", 1, 1, "td", None, None, None, None, None),
        ("e4", 1, 5, "y()", "code_candidate", None, *none, "0/3", None, None, None), ("e5", 1, 4, "x();", "code_candidate", None, *none, "0/3", None, None, None),
        ("e6", 2, 1, "Figure 1", "caption_candidate", None, *none, None, "f1", None, [0.0, 50.0, 40.0, 60.0]), ("e7", 2, 2, "x=1", "equation_candidate", None, *none, None, None, [0, 7], None),
    ]
    return spark.createDataFrame(rows, OBSERVED)


@pytest.fixture(scope="module")
def assets(spark):
    rows = [("o1", 2, "f1", 1, [0.0, 0.0, 10.0, 10.0], False, None), ("o2", 2, "f1", 2, [5.0, 5.0, 40.0, 45.0], False, None), ("o3", 2, None, 3, [50.0, 0.0, 60.0, 9.0], False, None), ("o4", 2, None, 4, [0.0, 0.0, 1.0, 1.0], True, [0, 7])]
    return spark.createDataFrame(rows, ASSETS)


def test_objects(observed, assets):
    got = {}
    for r in objects.all_objects(observed, assets).collect():
        got.setdefault(r.object_kind, []).append(r)
    assert got["table"][0].evidence_ids == ["e1", "e2", "e3"] and got["code"][0].text == "x();y()" and got["equation"][0].evidence_ids == ["e7"]
    figures = sorted(got["figure"], key=lambda r: len(r.asset_occurrence_ids), reverse=True)
    assert figures[0].asset_occurrence_ids == ["o1", "o2"] and figures[0].box == [0.0, 0.0, 40.0, 45.0] and figures[0].text == "Figure 1"
    assert figures[1].asset_occurrence_ids == ["o3"] and figures[1].text is None
    assert got["callout"][0].evidence_ids == ["e7"] and len({r.object_id for rs in got.values() for r in rs}) == sum(map(len, got.values()))
    table = rendering.table_markdown(objects.table_cells(observed)).first().markdown
    assert table == "| a | b |\n| --- | --- |\n|  | c |"


def test_links_and_review(spark, observed, assets):
    notes = spark.createDataFrame([(2, "l1", [0.0, 52.0, 10.0, 58.0], "http://x"), (2, "l2", [900.0, 0.0, 910.0, 5.0], "#y")], "page_id int, id string, box array<double>, href string")
    found = {r.text: r.evidence_ids for r in objects.links(notes, observed).collect()}
    assert found == {"http://x": ["e6"], "#y": None}
    figures = objects.figures(assets.where("not callout"), observed)
    chosen = figures.where("size(asset_occurrence_ids) = 2").select("object_id", F.lit("used").alias("disposition"), F.lit("plate").alias("kind_override"), F.lit(None).cast("array<string>").alias("ids_override"), F.lit("C").alias("caption_override"))
    out = objects.reviewed(figures, chosen)
    assert {(r.object_kind, r.text, r.review_status) for r in out.collect()} == {("plate", "C", "used"), ("figure", None, "unreviewed")}
    kept = objects.assets_kept(assets, spark.createDataFrame([("o4", "used"), ("o3", "excluded")], "occurrence_id string, disposition string"), out)
    assert sorted(r.occurrence_id for r in kept.collect()) == ["o1", "o2", "o4"]
    spans = spark.createDataFrame([("p1", "e6"), ("p2", "e7")], "paragraph_id string, evidence_id string")
    assert [r.paragraph_id for r in objects.by_block(objects.captions(observed), spans).collect()] == ["p1"]


def test_placement(spark):
    images = spark.createDataFrame([(1, "i1", 5), (1, "i2", 1), (2, "i3", 1)], "page_id int, id string, rank int")
    anchors = spark.createDataFrame([(1, "a1", 2), (1, "a2", 4), (1, "a3", 9)], "page_id int, id string, rank int")
    assert {r.image_id: (r.anchor_id, r.is_after) for r in objects.placed_after(images, anchors).collect()} == {"i1": ("a2", True), "i2": ("a1", False), "i3": (None, False)}
    rows = spark.createDataFrame([(1, 1, 9), (1, 2, None), (1, 3, 4), (1, 4, 7)], "page_id int, order int, asset_rank int")
    assert {r.asset_rank: r.new_order for r in objects.within_slots(rows).collect()} == {None: 2, 4: 1, 7: 3, 9: 4}
    parts = spark.createDataFrame([(1, 1, "a", [50.0, 1.0, 60.0, 9.0]), (1, 2, "b", [0.0, 4.0, 9.0, 9.0]), (1, 2, "c", [0.0, 20.0, 9.0, 30.0]), (1, 3, "d", [0.0, 12.0, 5.0, 14.0])], "page_id int, component int, id string, box array<double>")
    assert [r.id for r in objects.component_order(parts).orderBy("rank").collect()] == ["b", "c", "a", "d"]


def test_runs(spark, tmp_path):
    policy = {"target": "review", "access_tags": ["b", "a", "a"]}
    assert runs.run_id("0" * 64, policy) == runs.run_id("0" * 64, {"access_tags": ["a", "b"], "target": "review"}) != runs.run_id("1" * 64, policy)
    assert runs.policy_findings({"dpi": 50, "privacy": "tenant", "max_pages": 0, "access_tags": ["x" * 65]}) == ["dpi", "tenant_id", "max_pages", "access_tags"]
    t = {"a": spark.range(5), "b": spark.createDataFrame([("x",), (None,)], "s string")}
    first = runs.materialize(t, str(tmp_path), "r1")
    again = runs.materialize({"a": spark.range(9)}, str(tmp_path), "r1")  # a whole run is used as it is
    assert first.orderBy("name").collect() == again.orderBy("name").collect()
    now = runs.digest_of(spark.range(5).repartition(3), "a").unionByName(runs.digest_of(spark.createDataFrame([("y",), (None,)], "s string"), "b")).unionByName(runs.digest_of(spark.range(1), "c"))
    assert {(r.name, r.finding) for r in runs.reconcile(first, now).collect()} == {("b", "changed"), ("c", "unexpected")}


def test_bundles_and_heads(spark):
    a, b = spark.createDataFrame([("p1", 1)], "page_id string, n int"), spark.createDataFrame([("p1", "e")], "page_id string, evidence_id string")
    assert {(r.page_id, r.evidence_id, r.member_order) for r in runs.bundle([("x", a), ("y", b)]).collect()} == {("x__p1", None, 1), ("y__p1", "y__e", 2)}
    rows = [("top", None, 0, "T"), ("sub", None, 0, "S"), ("top", "sub", 2, None), ("top", "f1", 1, "1"), ("sub", "f2", 1, "2")]
    d = lambda rs: {r.bundle: r.digest for r in runs.nested_digest(spark.createDataFrame(rs, "bundle string, member string, order int, sha string")).collect()}
    deep = d([*rows[:4], ("sub", "f2", 1, "changed")])
    assert d(rows)["top"] != deep["top"] and d(rows)["sub"] != deep["sub"] and len(d(rows)) == 2
    m = spark.createDataFrame([("p", ["s1"], ["r2"], "r2")], "package_id string, source_revisions array<string>, runs array<string>, active_run_id string")
    got = runs.head(runs.head(m, "s2", "r1"), "s1", "r2").first()
    assert (got.source_revisions, got.runs, got.active_run_id) == (["s1", "s2"], ["r1", "r2"], "r2")
    v = spark.createDataFrame([("p", "hint", 0, "HINT_READY"), ("p", "review", 0, "REVIEW_READY"), ("p", "citation", 2, "FAIL_REVIEW")], "package_id string, target string, failed int, status string")
    assert runs.status(m, v).first().trust_status == "needs_review"


def test_variants_and_json(spark):
    df = spark.createDataFrame([("e1", "Café\r\nx"), ("e2", "plain"), ("e3", None)], "evidence_id string, text string")
    got = runs.normalized_variants(df).collect()
    assert sorted((r.text or "", r.selected) for r in got) == [("", True), ("Café\r\nx", False), ("Café\nx", True), ("plain", True)]
    assert len({r.variant_group_id for r in got}) == 3
    import hashlib
    import json

    rows = spark.createDataFrame([(1, 'a"\\b', None)], "n int, s string, z string")
    want = json.dumps({"n": 1, "s": 'a"\\b', "z": None}, sort_keys=True, ensure_ascii=False)
    assert rows.select(runs.canonical_hash(rows, ["z", "s", "n"]).alias("h")).first().h == hashlib.sha256(want.encode()).hexdigest()
    odd = [("".join(map(chr, range(40))), True, 0.0), ("é\u2028中😀", False, 1e16), ("\n", None, 123456789.25), ("/", True, 1e-5), ("", True, -1234567890123456.0), ("x", True, 1.5e300), ("y", True, 0.0001), ("z", True, 0.00123), ("w", True, 10000000.0), ("v", True, -2.5e-10)]
    rows = spark.createDataFrame(odd, "s string, b boolean, d double")
    got = {r.s: r.h for r in rows.select("s", runs.canonical_hash(rows, ["s", "b", "d"]).alias("h")).collect()}
    for s, b, d in odd:
        assert got[s] == hashlib.sha256(json.dumps({"s": s, "b": b, "d": d}, sort_keys=True, ensure_ascii=False).encode()).hexdigest(), (s, b, d)


def test_digests_tell_nulls_apart(spark):
    from codexloom.operators import decisions

    digest = lambda rows: runs.digest_of(spark.createDataFrame(rows, "a string, b string"), "t").first().digest
    assert digest([(None, "x")]) != digest([("x", None)])
    assert digest([("x", "y"), ("x", "y")]) != digest([("x", "y")])
    assert digest([("1", "2"), ("3", "4")]) == digest([("3", "4"), ("1", "2")])
    from pyspark.sql import functions as F

    link = lambda *parts: decisions.link_hash(*(F.lit(p).cast("string") for p in parts))
    row = spark.range(1).select(link("p", None, "z").alias("a"), link("p", "z").alias("b"), link("p", "z", None).alias("c")).first()
    assert len({row.a, row.b, row.c}) == 3


@pytest.fixture(scope="module")
def package(spark):
    docs = spark.createDataFrame([(1, "Title\nfirst line\nlast")], "doc_id long, text string")
    seen = ledger.evidence(ledger.lines(docs)).cache()
    blocks = ledger.canonical(seen).withColumn("canonical_disposition", F.lit(None).cast("string")).cache()
    paragraphs = ledger.paragraphs(blocks).cache()
    ids = [r.paragraph_id for r in paragraphs.orderBy("order").collect()]
    page = seen.first().page_id
    log = [("page", page, "accepted"), *(("paragraph", i, "used") for i in ids), ("asset", "o1", "used"), ("object", "obj1", "used"), ("source_boundary", "s", "accepted")]
    return {
        "surfaces": spark.createDataFrame([(page, 1, "extracted", "0" * 64)], "page_id string, ordinal int, status string, page_image_sha256 string"), "evidence": seen, "canonical": blocks, "paragraphs": paragraphs,
        "spans": paragraphs.select("paragraph_id", "block_id", "span_start", "span_end"), "assets": spark.createDataFrame([("o1", page)], "occurrence_id string, page_id string"),
        "objects": spark.createDataFrame([("obj1", "figure")], "object_id string, object_kind string"), "decisions": spark.createDataFrame([(n, *r, "someone") for n, r in enumerate(log, 1)], "seq int, kind string, target_id string, disposition string, reviewer string"),
        "toc": spark.createDataFrame([("t1", None, 1, "b1", "c1")], "toc_id string, parent_id string, level int, boundary_id string, candidate_id string"), "candidates": spark.createDataFrame([("c1",)], "candidate_id string"),
        "boundaries": spark.createDataFrame([("b1", 1, ids)], "boundary_id string, place int, paragraph_ids array<string>"), "findings": spark.createDataFrame([("low_confidence", None, None, "objX", None)], "kind string, page_id string, occurrence_id string, object_id string, candidate_id string"),
    }


def failed(tables, target="citation"):
    return {r.check_id for r in acceptance.evaluate(tables, target).where("not passed").collect()}


def test_whole_package(spark, package):
    assert failed(package) == {"extraction_findings_resolved"}
    resolved = package | {"findings": package["findings"].limit(0)}
    assert failed(resolved) == set() and acceptance.verdict(resolved, "citation").first().status == "PASS_STRICT"
    assert acceptance.verdict(package, "hint").first().status == "HINT_READY"


def test_package_fails_where_it_is_changed(spark, package):
    good = package | {"findings": package["findings"].limit(0)}
    last = F.max("order")
    end = good["paragraphs"].agg(last).first()[0]
    cases = [
        ("surfaces", lambda d: d.withColumn("ordinal", F.lit(2)), {"spine_surface_accounting"}),
        ("surfaces", lambda d: d.withColumn("page_image_sha256", F.lit(None).cast("string")), {"pdf_visual_evidence_complete"}),
        ("evidence", lambda d: d.withColumn("engine", F.lit("mock_ocr")), {"no_mock_evidence"}),
        ("canonical", lambda d: d.withColumn("text", F.when(F.col("ordinal") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), {"canonical_reverse_mapping", "canonical_block_disposition_coverage"}),
        ("spans", lambda d: d.unionByName(d.limit(1)), {"canonical_block_single_disposition"}),
        ("paragraphs", lambda d: d.where(F.col("order") < end), {"chapter_boundary_partition"}),
        ("decisions", lambda d: d.where("kind <> 'source_boundary'"), {"source_use_boundary"}),
        ("decisions", lambda d: d.withColumn("reviewer", F.when(F.col("seq") > 1, F.col("reviewer"))), {"semantic_reviewer_provenance"}),
        ("toc", lambda d: d.withColumn("parent_id", F.lit("none")), {"canonical_toc_tree"}),
        ("candidates", lambda d: d.unionByName(spark.createDataFrame([("c2",)], "candidate_id string")), {"structure_candidate_disposition_coverage"}),
        ("assets", lambda d: d.withColumn("page_id", F.lit("lost")), {"asset_surface_foreign_keys"}),
        ("objects", lambda d: d.withColumn("object_id", F.lit("other")), {"complex_object_accounting"}),
    ]
    for name, change, want in cases:
        assert failed(good | {name: change(good[name])}) == want, name


def test_export(spark, package):
    rows = publishing.chunks(package["paragraphs"], "r", "raw")
    items, uses = spark.createDataFrame([("o1",)], "occurrence_id string"), spark.createDataFrame([("o1",)], "occurrence_id string")
    heads = spark.createDataFrame([(1, 1, 2, "Title")], "doc_id int, place int, level int, title string")
    bad = lambda *t: {r.check_id for r in acceptance.of_export(*t).where("not passed").collect()}
    assert bad(rows, items, uses, heads, heads) == set()
    assert bad(rows.where("order <> 2"), items, uses.union(uses), heads, heads.limit(0)) == {"chunk_order", "asset_references", "headings_unexpected"}
    paths = spark.createDataFrame([(1, 1, [[0, 2]]), (1, 2, [[0, 1], [0, 3]]), (2, 3, [[0]])], "page_id int, order int, dom_paths array<array<int>>")
    assert [r.order for r in acceptance.dom_regressions(paths).collect()] == [2]
    assert decisions.latest(package["decisions"], ["kind", "target_id"], ["seq"]).count() == package["decisions"].count()
