"""Gates over two literal packages: one that passes all of them, and one that fails each."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import package_gates
from .common import query, values

_SHA = "0" * 64
_SCOPE = "privacy string, tenant_id string, workspace_id string, rights_basis string, retention_policy string, access_tags array<string>"


def _chained(package: str, contents: list[str], broken: int | None = None) -> list[tuple]:
    """Rows of a log (package_id, seq, content, previous_hash, own_hash); one may have another content than its hash says."""
    head, out = hashlib.sha256(f"review-genesis|{package}".encode()).hexdigest(), []
    for seq, content in enumerate(contents, 1):
        own = hashlib.sha256(f"{head}|{content}".encode()).hexdigest()
        out.append((package, seq, f"{content}!" if seq == broken else content, head, own))
        head = own
    return out


_WHOLE = (["p"], ["q1"], ["q2"], "so", "little", [], [], "new", "here", "candidate")
_PAPER = ("src", "book/pg1", "sum", "method", [], [], [], [])
_TABLES: dict[str, tuple[str, list[tuple]]] = {
    "packages": (
        f"package_id string, package_version int, lifecycle string, source_format string, source_sha256 string, active_run_id string, pipeline_version string, n_navigation int, structure_required boolean, {_SCOPE}",
        [("good", 2, "active", "epub", _SHA, "r_1", "1", 1, True, "tenant", "t1", None, "licensed", "keep", ["a"]), ("bad", 1, "revoked", "epub", "XYZ", "r..2", "1", 2, True, "tenant", " ", None, "", "keep", ["a"]), ("work", 2, None, "pdf", _SHA, "r_1", "1", 0, False, "workspace", None, None, "licensed", "keep", ["a"])],
    ),
    "runs": (
        f"package_id string, run_id string, schema_version int, source_sha256 string, pipeline_version string, target string, {_SCOPE}",
        [("good", "r_1", 2, _SHA, "1", "citation", "tenant", "t1", None, "licensed", "keep", ["a"]), ("bad", "r..2", 1, _SHA, "0", "hint", "tenant", "t2", None, "", "keep", ["a"]), ("work", "r_0", 2, _SHA, "1", "review", "workspace", None, None, "licensed", "keep", ["a"])],
    ),
    "bindings": (
        "package_id string, name string, declared string, observed string, decision_id string",
        [("good", n, "d", "d", "s1") for n in ("review_ledger", "assets", "objects", "active", "canonical", "paragraphs", "toc", "boundaries")]
        + [("bad", n, "d", "x", "s0") for n in ("review_ledger", "assets", "objects", "active", "paragraphs", "toc")] + [("bad", "boundaries", "d", "d", "s0"), ("work", "review_ledger", "d", "d", None), ("work", "canonical", "d", "d", None), ("work", "assets", "d", None, None)],
    ),
    "artifacts": ("package_id string, path string, required boolean, declared string, observed string", [("good", "ledger/a.jsonl", True, "d", "d"), ("good", "notes.txt", False, None, "x"), ("bad", "../a.jsonl", True, "d", "d"), ("bad", "ledger/b.jsonl", True, "d", None), ("bad", "ledger/c.jsonl", False, "d", "e")]),
    "binaries": (
        "package_id string, owner string, owner_kind string, path string, declared string, observed string, link boolean",
        [("good", "pg1", "page", "pages/1.png", "d", "d", False), ("good", "as9", "asset", "/far/away.png", "d", None, None), ("bad", "pg1", "page", "/far/1.png", "d", None, None), ("bad", "pg2", "page", "a/../../b", "d", "d", False), ("bad", "as1", "asset", "c.png", "d", "e", False), ("bad", "as2", "asset", "l.png", "d", "d", True), ("bad", "as3", "asset", "m.png", None, None, False)],
    ),
    "surfaces": (
        "package_id string, page_id string, route string, surface_role string, canonical_inclusion string, navigation_sha256 string, navigation_status string, fallback string",
        [("good", "pg1", "epub_spine", "text", "included", None, None, None), ("good", "nav", "epub_navigation_metadata", "auxiliary_navigation", "excluded", "n", "nonsemantic_navigation_document_fallback_required", "epub2_ncx"), ("bad", "pg1", "epub_spine", "text", "included", None, None, None), ("bad", "nav", "epub_navigation_metadata", "auxiliary_navigation", "excluded", "n", "nonsemantic_navigation_document_fallback_required", None)],
    ),
    "evidence": (
        "package_id string, evidence_id string, variant_group_id string, mathml_sha256 string, pre_text_sha256 string, heading boolean, container_types array<string>",
        [(p, "e1", "v1", "m1", "c1", False, []) for p in ("good", "bad")] + [(p, "e2", "v1" if p == "good" else "v2", None, None, True, []) for p in ("good", "bad")] + [(p, "e3", None, None, None, True, ["Sidebar"]) for p in ("good", "bad")],
    ),
    "canonical": ("package_id string, block_id string, evidence_id string, selection_status string, source_evidence_ids array<string>", [(p, "b1", "e1", "reviewed_variant_selection", ["e1", "e2"]) for p in ("good", "bad")] + [("bad", "b2", "e9", "machine_selected", [])]),
    "assets": ("package_id string, occurrence_id string, callout_role string, kept boolean", [("good", "a1", "code_callout", True), ("bad", "a1", "code_callout", False), ("bad", "a2", None, True)]),
    "objects": (
        "package_id string, object_id string, object_kind string, source_id string, asset_occurrence_ids array<string>, caption_text string, caption_object_id string",
        [("good", "o1", "callout", None, ["a1"], None, None), ("good", "o2", "equation", "m1", [], None, None), ("good", "o3", "code", "c1", [], None, None), ("good", "o4", "figure", None, ["a1"], "Fig. 1", "o5"), ("bad", "o4", "figure", None, ["a1"], "Fig. 1", None), ("bad", "o6", "table", None, [], None, None), ("bad", "o7", "caption", None, [], None, None)],
    ),
    "paragraphs": (
        "package_id string, paragraph_id string, page_id string, source_id string, source_role string, text string, source_evidence_ids array<string>",
        [(p, q, "pg1", "src", "primary", t, [e]) for p in ("good", "bad") for q, t, e in (("q1", "Chapter One.", "e2"), ("q2", "Body", "e1"), ("q3", "A side", "e3"))] + [("bad", "q4", "pg1", "src", "secondary", "More", ["e1"])],
    ),
    "boundaries": ("package_id string, boundary_id string, paragraph_ids array<string>", [("good", "bd1", ["q1", "q2", "q3"]), ("bad", "bd1", ["q2", "q1"])]),
    "toc": ("package_id string, boundary_id string, title string", [("good", "bd1", "CHAPTER one"), ("good", "bd1", "Other"), ("bad", "bd1", "Chapter One")]),
    "decisions": (
        f"package_id string, decision_id string, kind string, target_id string, disposition string, reading string, reason string, {package_gates.DECIDED}",
        [("good", f"d{q}", "paragraph", q, "used", "read", "why", *_PAPER, [_WHOLE] if q == "q3" else [], True, True, None, None, None, None) for q in ("q1", "q2", "q3")]
        + [("good", "s1", "structure", "canonical", "reviewed", "read", "why", *[None] * 11, ["nav", "pg1"], None, None, None), ("bad", "s1", "structure", "canonical", "reviewed", "read", "why", *[None] * 11, ["pg1"], None, None, None), ("good", "da", "asset", "a1", "used", "read", "why", *[None] * 15)]
        + [("good", f"do{k}", "object", f"o{k}", "used", "read", None, *[None] * 12, "verified", True, True) for k in (1, 2, 3, 4)]
        + [("bad", "dq1", "paragraph", "q1", "used", "read", "why", *_PAPER, [(*_WHOLE[:1], ["q9"], *_WHOLE[2:])], True, True, None, None, None, None), ("bad", "dq2", "paragraph", "q2", "used", "", "why", *_PAPER, [], True, True, None, None, None, None), ("bad", "dq3", "paragraph", "q3", "used", "read", "why", "src", "book/pg7", *_PAPER[2:], [], True, True, None, None, None, None)]
        + [("bad", "dq4", "paragraph", "q4", "used", "read", "why", *_PAPER, [], True, True, None, None, None, None), ("bad", "do4", "object", "o4", "used", "read", None, *[None] * 12, "verified", True, True), ("bad", "do6", "object", "o6", "used", "read", None, *[None] * 12, "verified", False, True), ("bad", "do7", "object", "o7", "excluded", "read", None, *[None] * 15)],
    ),
    "log": ("package_id string, seq int, content string, previous_hash string, own_hash string", _chained("good", ["x", "y", "z"]) + _chained("bad", ["x", "y", "z"], 2)),
}


def packages(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in _TABLES.items()}


#: What fails: package, check, values.
_FAILING = [
    ("bad", "schema_version", "1"), ("bad", "source_identity", "XYZ"), ("bad", "lifecycle_active", "revoked"), ("bad", "rights_basis", "bad"), ("bad", "tenant_scope", "bad"), ("work", "workspace_scope", "work"), ("bad", "canonical_variant_relation", "b1"),
    ("bad", "review_ledger_binding", "review_ledger"), ("bad", "assets_binding", "assets"), ("bad", "objects_binding", "objects"), ("bad", "active_binding", "active"), ("bad", "review_decision_chain", "2"), ("bad", "canonical_revision_binding", "canonical"), ("bad", "paragraph_projection_binding", "paragraphs"),
    ("bad", "toc_projection_binding", "toc"), ("bad", "boundary_projection_binding", "boundaries"), ("bad", "immutable_artifact_integrity", "../a.jsonl|ledger/b.jsonl|ledger/c.jsonl|pipeline_version|run_id|schema_version|source_sha256"), ("work", "immutable_artifact_integrity", "run_manifest"), ("bad", "scope_bound_to_run", "r..2"), ("work", "scope_bound_to_run", "none"),
    ("bad", "binary_evidence_integrity", "as1:c.png|as2:l.png|as3:m.png|pg2:a/../../b"), ("bad", "epub_navigation_logical_surface_accounting", "count:1|nav"), ("bad", "epub_callout_object_accounting", "a1"), ("bad", "epub_mathml_object_accounting", "m1"), ("bad", "epub_preformatted_code_object_accounting", "c1"), ("bad", "epub_figure_caption_linkage", "o4"),
    ("bad", "epub_dom_heading_materialization", "q1"), ("bad", "epub_noncanonical_container_heading_accounting", "q3"), ("bad", "citation_evidence_tier", "hint"), ("work", "citation_evidence_tier", "none"), ("bad", "citation_page_evidence_preserved", "pg1"), ("bad", "paragraph_decision_integrity", "q1|q2|q3|q4"), ("bad", "complex_object_accounting", "o4|o6|o7"), ("bad", "structure_semantic_review", "s1"),
]
_NAMES = list(dict.fromkeys(check for _, check, _ in _FAILING))


@query(
    f"""SELECT package_id, check_id, v IS NULL AS passed, coalesce(len(string_split(v, '|')), 0)::BIGINT AS n_observed, coalesce(v, '') AS observed
FROM (SELECT unnest(['good', 'bad', 'work']) AS package_id) CROSS JOIN {values([(n,) for n in _NAMES], "check_id")} LEFT JOIN {values(_FAILING, "p, c, v").replace(" AS v(", " AS f(")} ON p = package_id AND c = check_id"""
)
def q72_package_gates(spark, sf_dir):
    """Every gate on a package that passes, one that fails it, and one that isn't an EPUB and has almost nothing."""
    return package_gates.evaluate(packages(spark)).withColumn("observed", F.array_join("observed", "|"))


@query(f"SELECT * FROM {values([('good', 0, 'PASS_STRICT'), ('bad', sum(p == 'bad' for p, _, _ in _FAILING), 'FAIL_REVIEW'), ('work', sum(p == 'work' for p, _, _ in _FAILING), 'FAIL_REVIEW')], 'package_id, failed, status')}")
def q73_package_verdicts(spark, sf_dir):
    return package_gates.verdicts(package_gates.evaluate(packages(spark)), "citation")
