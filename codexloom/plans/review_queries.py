"""Reviewed text rebuilt from decisions, and publications accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, publication, rebuild
from .common import LINES_SQL, query, table, values


@query(
    f"""WITH b AS (SELECT doc_id, ordinal, text, count(*) OVER (PARTITION BY doc_id) >= 6 AS e FROM ({LINES_SQL})),
r AS (SELECT doc_id, 1 AS ord, string_agg(text, ' ' ORDER BY ordinal) AS text, 'reviewed_join' AS selection_status, 'included' AS canonical_disposition FROM b WHERE e AND ordinal <= 2 GROUP BY doc_id
UNION ALL SELECT doc_id, CASE WHEN e AND ordinal = 5 THEN 6 WHEN e AND ordinal = 6 THEN 5 ELSE ordinal END, CASE WHEN e AND ordinal = 4 THEN 'fixed' ELSE text END,
  CASE WHEN e AND ordinal = 3 THEN 'reviewed_exclusion' WHEN e AND ordinal = 4 THEN 'reviewed_correction' WHEN e AND ordinal IN (5, 6) THEN 'reviewed_reorder' ELSE 'machine_selected' END, CASE WHEN e AND ordinal = 3 THEN 'excluded' ELSE 'included' END FROM b WHERE NOT (e AND ordinal <= 2))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place, text, selection_status, canonical_disposition FROM r"""
)
def q77_rebuilt_text(spark, sf_dir):
    """All documents, those of six lines or more with a join, an exclusion, a correction and a new order."""
    seen = ledger.evidence(ledger.lines(table(spark, sf_dir, "documents")))
    blocks = ledger.canonical(seen).select("doc_id", "page_id", "block_id", "ordinal", "evidence_id", "text")
    six = blocks.where("ordinal <= 6").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "block_id"))).alias("of")).where(F.size("of") == 6)
    at = lambda k: F.element_at("of", F.lit(k).cast("long"))
    none = F.lit(None)
    row = lambda name, action, target, members=none, text=none, reason=none: F.struct(F.concat(F.lit(f"{name}_"), at(1)).alias("decision_id"), F.lit(action).alias("action"), at(target).alias("block_id"), members.cast("array<string>").alias("block_ids"), text.cast("string").alias("text"), none.cast("string").alias("evidence_id"), reason.cast("string").alias("reason"))
    each = F.array(row("j", "join_blocks", 1, F.array(at(1), at(2))), row("x", "exclude_block", 3, reason=F.lit("noise")), row("c", "correct_text", 4, text=F.lit("fixed")), row("o", "reorder_blocks", 5, F.array(at(6), at(5))))
    made = six.select(F.inline(each)).withColumn("pieces", none.cast("array<struct<segment:int,block_id:string,start:int,end:int>>"))
    observed = seen.select("evidence_id", "page_id", F.lit(None).cast("string").alias("variant_group_id"), "text")
    return rebuild.rebuild(blocks, made, observed).select("doc_id", "place", "text", "selection_status", "canonical_disposition")


_BLOCKS = [("d1", "p1", "b1", 1, "e1", "alpha beta"), ("d1", "p1", "b2", 2, "e2", "gamma"), ("d1", "p1", "b3", 3, "e3", "delta eps"), ("d1", "p2", "b4", 4, "e4", "zeta"), ("d1", "p2", "b5", 5, "e5", "junk"), ("d1", "p3", "b6", 6, "e6", "eta"), ("d1", "p3", "b7", 7, "e7", "iota")]
_BLOCKS += [("d2", "p1" if k < 5 else "p2", f"c{k}", k, f"f{k}", f"text {k}") for k in range(1, 10)]
_OBSERVED = [(e, p, f"g{e}", t) for _, p, _, _, e, t in _BLOCKS] + [("v7", "p3", "ge7", "IOTA"), ("v8", "p1", "ge7", "far")]
_MADE = [
    ("s1", "split_block", "b1", None, None, None, None, [(0, "b1", 0, 5), (1, "b1", 5, 10)]), ("r1", "resegment_blocks", "b2", None, None, None, None, [(0, "b2", 0, 5), (0, "b3", 0, 5), (1, "b3", 5, 9)]), ("j1", "join_blocks_across_surfaces", "b4", ["b4", "b6"], "zeta-eta", None, None, None),
    ("x1", "exclude_block", "b5", None, None, None, "noise", None), ("v1", "select_variant", "b7", None, None, "v7", None, None),
    ("s2", "split_block", "c1", None, None, None, None, [(0, "c1", 0, 2), (1, "c1", 3, 6)]), ("o2", "reorder_blocks", "c2", ["c2", "c4"], None, None, None, None), ("v2", "select_variant", "c3", None, None, "v8", None, None), ("u2", "shout", "c5", None, None, None, None, None),
    ("j2", "join_blocks", "c6", ["c7", "c6"], None, None, None, None), ("m2", "join_blocks", "c8", ["c8", "zz"], None, None, None, None), ("x2", "exclude_block", "c9", None, None, None, " ", None), ("t2", "correct_text", "c9", None, "", None, None, None),
]
_FINDINGS = [("s2", "coverage"), ("o2", "not_neighbours"), ("v2", "variant"), ("u2", "action"), ("j2", "order"), ("m2", "member_missing"), ("x2", "reason"), ("x2", "member_repeated"), ("t2", "text"), ("t2", "member_repeated")]
_REBUILT = [
    ("d1", 1, "alpha", "reviewed_split", "b1:0:5"), ("d1", 2, " beta", "reviewed_split", "b1:5:10"), ("d1", 3, "gammadelta", "reviewed_resegment", "b2:0:5,b3:0:5"), ("d1", 4, " eps", "reviewed_resegment", "b3:5:9"), ("d1", 5, "zeta-eta", "reviewed_join", "b4:0:4,b6:0:3"),
    ("d1", 6, "junk", "reviewed_exclusion", "b5:0:4"), ("d1", 7, "IOTA", "reviewed_variant_selection", "b7:0:4"), *(("d2", k, f"text {k}", "machine_selected", f"c{k}:0:6") for k in range(1, 10)),
]


def _review(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    blocks = spark.createDataFrame(_BLOCKS, "doc_id string, page_id string, block_id string, ordinal int, evidence_id string, text string")
    return blocks, spark.createDataFrame(_MADE, rebuild.DECISIONS), spark.createDataFrame(_OBSERVED, "evidence_id string, page_id string, variant_group_id string, text string")


@query(f"SELECT * FROM {values(_FINDINGS, 'decision_id, finding')}")
def q78_decision_findings(spark, sf_dir):
    return rebuild.findings(*_review(spark))


@query(f"SELECT * FROM {values(_REBUILT, 'doc_id, place, text, selection_status, spans')}")
def q79_literal_rebuild(spark, sf_dir):
    spans = F.array_join(F.transform("source_spans", lambda x: F.concat_ws(":", x["block_id"], x["start"], x["end"])), ",")
    return rebuild.rebuild(*_review(spark)).select("doc_id", "place", "text", "selection_status", spans.alias("spans"))


_PARAGRAPHS = [
    ("k", "q1", 1, "One", None, ["s"], "dom", "pg1", None, ["A"], "heading", True, None), ("k", "q2", 2, "Two", ["q2a", "q2b"], ["s"], "dom", "pg1", "a2", ["A"], "text", None, "ul"), ("k", "q3", 3, "[[IMAGE o1]]", [], None, None, "pg2", None, [], "image", False, None), ("k", "q4", 4, "link", None, [], None, "pg2", None, [], "link_annotation", None, None),
]
_CHUNKS = [("q1", "One", "q1", "pg1", "suppressed_structural_echo", "", "", "source_text_span", "source_spans_bound", "", ""), ("q2", "Two", "q2a|q2b", "a2", "rendered", "ob1|ob2", "", "source_text_span", "source_spans_bound", "x", "n1"), ("q3", "[[IMAGE o1]]", "q3", "pg2", "rendered", "", "o1|o2", "asset_occurrence_only", "asset_sha256_page_occurrence_bound", "", ""), ("q4", "link", "q4", "pg2", "rendered", "", "", "pdf_link_annotation_only", "pdf_page_xref_bbox_bound", "", "")]


def _chunks(spark: SparkSession) -> DataFrame:
    blank = F.lit(None).cast("string")
    rows = spark.createDataFrame(_PARAGRAPHS, "package_id string, paragraph_id string, order int, text string, source_paragraph_ids array<string>, source_spans array<string>, source_reconstruction string, page_id string, page_anchor string, structure_path array<string>, block_kind string, suppressed boolean, list_semantics string")
    rows = rows.withColumns({n: blank for n in publication.REVIEWED})
    packages = spark.createDataFrame([("k",)], "package_id string").withColumns({n: F.lit(n) for n in publication.PACKAGE})
    make = lambda data, schema: spark.createDataFrame(data, f"package_id string, paragraph_id string, at int, {schema}")
    objects, anchors = make([("k", "q2", 2, "ob2"), ("k", "q2", 1, "ob1")], "object_id string"), make([("k", "q2", 1, "n1")], "anchor_id string")
    assets, links = make([("k", "q3", 2, "o2", "d2", "a/2.png", "pg2"), ("k", "q3", 1, "o1", "d1", "a/1.png", "pg2")], "occurrence_id string, asset_sha256 string, asset_path string, page_id string"), make([("k", "q2", 1, "external", "http://x", "x")], "kind string, href string, text string")
    return publication.chunk_rows(rows, packages, objects, assets, links, anchors)


@query(
    f"""SELECT 'chunk_' || substr(sha256(p || sha256(t)), 1, 16) AS chunk_id, sha256(t) AS text_sha256, paragraph_ids, page_anchor, visible_projection, object_ids, occurrences, anchor_classification, reversibility_status, links, anchors, 42 AS n_columns, 'run_id' AS run_id
FROM {values(_CHUNKS, "p, t, paragraph_ids, page_anchor, visible_projection, object_ids, occurrences, anchor_classification, reversibility_status, links, anchors")}"""
)
def q80_chunk_rows(spark, sf_dir):
    rows = _chunks(spark)
    joined = lambda name: F.array_join(name, "|")
    links = F.coalesce(F.array_join(F.transform("links", lambda x: x["text"]), "|"), F.lit(""))
    return rows.select("chunk_id", "text_sha256", joined("paragraph_ids").alias("paragraph_ids"), "page_anchor", "visible_projection", joined("object_ids").alias("object_ids"), joined("asset_occurrence_ids").alias("occurrences"), "anchor_classification", "reversibility_status", links.alias("links"), joined("source_dom_anchor_ids").alias("anchors"), F.lit(len(rows.columns)).alias("n_columns"), "run_id")


_ACCOUNT = [
    ("asset_occurrences_expected", "o1|o2|o3", False), ("asset_occurrences_referenced", "o1|o2", False), ("missing_asset_occurrence_ids", "o3", True), ("asset_occurrence_source_order", "o1|o2", True), ("asset_dom_order_regressions", "c2", True),
    ("canonical_structure_headings_expected", "A|B", False), ("canonical_structure_headings_emitted", "A|C", False), ("canonical_heading_mismatches", "B|C", True), ("css_hidden_dom_paths_audited", "0.9", False), ("css_hidden_chunk_leak_ids", "c3", True), ("numbered_heading_hierarchy_violations", "c9", True),
    ("table_objects_expected", "ob1|ob9", False), ("table_objects_rendered", "ob1", False), ("table_cell_dom_fidelity_violations", "ob1", True), ("missing_table_object_ids", "ob9", True), ("external_links_rendered", "http://x", False), ("callout_links_expected", "ob2", False), ("callout_links_referenced", "ob2", False),
    ("callout_target_fragments_expected", "n1|n2", False), ("callout_target_fragments_materialized", "n1", False), ("missing_callout_target_fragments", "n2", True), ("missing_callout_object_ids", "ob7", True), ("code_objects_expected", "ob8", False), ("missing_code_object_ids", "ob8", True), ("source_list_items_rendered", "q2", False),
]
_ACCOUNT = [(m, "ob2|ob7" if m == "callout_links_expected" else v, f) for m, v, f in _ACCOUNT]


def _publication(spark: SparkSession) -> dict[str, DataFrame]:
    make = spark.createDataFrame
    return {
        "packages": make([("k", True)], "package_id string, headings_required boolean"), "chunks": _chunks(spark), "assets": make([("k", "o1", 2), ("k", "o2", 1), ("k", "o3", 3)], "package_id string, occurrence_id string, place int"),
        "objects": make([("k", "ob1", "table", "other", None), ("k", "ob9", "table", "x", None), ("k", "ob2", "callout", None, "#n1"), ("k", "ob7", "callout", None, "#n2"), ("k", "ob8", "code", None, None)], "package_id string, object_id string, object_kind string, markdown string, target string"),
        "headings": make([("k", 1, 2, "A"), ("k", 2, 2, "C")], "package_id string, place int, level int, title string"), "expected_headings": make([("k", 1, 2, "A"), ("k", 2, 2, "B")], "package_id string, place int, level int, title string"),
        "hidden": make([("k", "pg1", [0, 9])], "package_id string, page_id string, dom_path array<int>"), "numbered": make([("k", "c9")], "package_id string, chunk_id string"),
        "chunk_nodes": make([("k", "c1", 1, "pg1", [0, 5]), ("k", "c2", 2, "pg1", [0, 3]), ("k", "c3", 3, "pg1", [0, 9])], "package_id string, chunk_id string, order int, page_id string, dom_path array<int>"),
    }


@query(f"SELECT metric, len(string_split(replace(v, 'q2', 'q2'), '|'))::BIGINT AS n, CASE WHEN metric = 'source_list_items_rendered' THEN 'chunk_' || substr(sha256('q2' || sha256('Two')), 1, 16) ELSE v END AS observed, fails FROM {values(_ACCOUNT, 'metric, v, fails')}")
def q81_publication_account(spark, sf_dir):
    """What a publication with a fault of each kind is accounted as; metrics without values are left out here."""
    rows = publication.validation(_publication(spark)).where("n > 0")
    return rows.select("metric", "n", F.array_join("observed", "|").alias("observed"), "fails")


_ASSETS = [("a", "pg2", [0, 1], None, None), ("b", "pg1", [0, 2], None, None), ("c", "pg1", [0, 1], None, None), ("d", "pg3", None, None, [5.0, 90.0, 9.0, 99.0]), ("e", "pg3", None, None, [1.0, 10.0, 9.0, 20.0]), ("f", "pg3", None, 1, None), ("g", "none", None, None, None), ("h", "pg3", None, None, None)]


@query(f"SELECT * FROM {values(list(zip('cbafedhg', range(1, 9), strict=True)), 'occurrence_id, place')}")
def q82_asset_order(spark, sf_dir):
    assets = spark.createDataFrame([("k", *r) for r in _ASSETS], "package_id string, occurrence_id string, page_id string, dom_path array<int>, visual_rank int, box array<double>")
    surfaces = spark.createDataFrame([("k", f"pg{n}", n) for n in (1, 2, 3)], "package_id string, page_id string, ordinal int")
    return publication.asset_order(assets, surfaces).select("occurrence_id", "place")
