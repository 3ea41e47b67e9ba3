"""The checks of a whole package, and an independent check of what it published.

A package is a dict of tables; a check is a name, the tables' rows that fail it, and the targets it belongs to. Tables: surfaces (page_id,
ordinal, status, page_image_sha256), evidence (evidence_id, page_id, engine, text), canonical (block_id, page_id, evidence_id, text,
selection_status, canonical_disposition), paragraphs (paragraph_id, order), spans (paragraph_id, block_id, span_start, span_end),
assets (occurrence_id, page_id), objects (object_id, object_kind, evidence_ids), decisions (seq, kind, target_id, disposition,
reviewer), toc (toc_id, parent_id, level, boundary_id, candidate_id), candidates (candidate_id), boundaries (boundary_id, place,
paragraph_ids), findings (kind, page_id, occurrence_id, object_id, candidate_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from . import decisions, graph, integrity, ordering, publishing

Tables = dict[str, DataFrame]
ALL, STRICT = ("hint", "review", "citation"), ("citation",)
#: Findings of extraction that a hint tolerates.
TOLERATED = ("blank_page_candidate", "low_confidence", "table_structure_uncertain", "mixed_layout", "caption_unlinked", "image_text_unread", "heading_uncertain")


def _latest(t: Tables, kind: str) -> DataFrame:
    own = decisions.latest(t["decisions"], ["kind", "target_id"], ["seq"])
    return own.where(F.col("kind") == kind).select("target_id", "disposition", "reviewer")


def _undecided(kind: str, table: str, key: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t[table].join(_latest(t, kind), F.col(key) == F.col("target_id"), "left_anti").select(F.col(key).alias("v"))


def _included(t: Tables) -> DataFrame:
    return t["canonical"].where("coalesce(canonical_disposition, '') <> 'excluded'")


def _canonical_orphans(t: Tables) -> DataFrame:
    """Selected blocks without their observation, on another page than it, or with another text though no one reviewed them."""
    seen = t["evidence"].select("evidence_id", F.col("page_id").alias("page_"), F.col("text").alias("text_"))
    both = t["canonical"].join(seen, "evidence_id", "left")
    wrong = F.col("page_").isNull() | (F.col("page_") != F.col("page_id")) | ((F.col("selection_status") == "machine_selected") & (F.col("text_") != F.col("text")))
    return both.where(F.coalesce(wrong, F.lit(True))).select(F.col("block_id").alias("v"))


def _span_status(*statuses: str) -> Callable[[Tables], DataFrame]:
    def failing(t: Tables) -> DataFrame:
        blocks = _included(t).select("block_id", F.length("text").alias("size"))
        return integrity.partition_check(blocks, t["spans"]).where(F.col("status").isin(*statuses)).select(F.col("block_id").alias("v"))

    return failing


def _boundary_partition(t: Tables) -> DataFrame:
    """Places at which the paragraphs of the boundaries, in order, aren't the document's paragraphs."""
    flat = t["boundaries"].select("place", F.posexplode("paragraph_ids").alias("k", "paragraph_id"))
    got = ordering.numbered(flat, ["place", "k"], "n").select("n", F.col("paragraph_id").alias("got"))
    want = ordering.numbered(t["paragraphs"], ["order"], "n").select("n", F.col("paragraph_id").alias("want"))
    return want.join(got, "n", "full_outer").where("not (got <=> want)").select(F.col("n").cast("string").alias("v"))


def _unresolved(t: Tables, tolerant: bool) -> DataFrame:
    """Findings whose page, asset, object or candidate no decision resolves."""
    kind = F.when(F.col("page_id").isNotNull(), "page").when(F.col("occurrence_id").isNotNull(), "asset").when(F.col("object_id").isNotNull(), "object").otherwise("structure")
    rows = t["findings"].withColumns({"kind_": kind, "target_": F.coalesce("page_id", "occurrence_id", "object_id", "candidate_id")})
    done = decisions.latest(t["decisions"], ["kind", "target_id"], ["seq"]).where("disposition in ('resolved', 'accepted', 'excluded')").select(F.col("kind").alias("dk"), F.col("target_id").alias("dt"))
    left = rows.join(done, (F.col("kind_") == F.col("dk")) & (F.col("target_") == F.col("dt")), "left_anti")
    return (left.where(~F.col("kind").isin(*TOLERATED)) if tolerant else left).select(F.col("kind").alias("v"))


def _set_gap(left: Callable[[Tables], DataFrame], right: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Values in one set and not in the other."""
    return lambda t: left(t).distinct().withColumn("a", F.lit(1)).join(right(t).distinct().withColumn("b", F.lit(1)), "v", "full_outer").where("a is null or b is null").select("v")


def _one(table: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t[table].agg(F.count("*").alias("n")).where("n < 1").select(F.col("n").cast("string").alias("v"))


def _pick(table: str, key: str, where: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t[table].where(where).select(F.col(key).cast("string").alias("v"))


#: check_id, rows that fail (one column v), targets.
CHECKS: list[tuple[str, Callable[[Tables], DataFrame], tuple[str, ...]]] = [
    ("surface_accounting", _one("surfaces"), ALL),
    ("canonical_evidence", _one("canonical"), ALL),
    ("evidence_surface_foreign_keys", lambda t: integrity.orphans(t["evidence"], "page_id", t["surfaces"], "page_id").select(F.col("evidence_id").alias("v")), ALL),
    ("asset_surface_foreign_keys", lambda t: integrity.orphans(t["assets"], "page_id", t["surfaces"], "page_id").select(F.col("occurrence_id").alias("v")), ALL),
    ("spine_surface_accounting", lambda t: integrity.missing_indexes(t["surfaces"], "ordinal").select(F.col("missing").cast("string").alias("v")), ALL),
    ("page_extraction", _pick("surfaces", "page_id", "status = 'unresolved'"), ALL),
    ("canonical_reverse_mapping", _canonical_orphans, ALL),
    ("decision_integrity", lambda t: decisions.invalid(t["decisions"]).select(F.col("seq").cast("string").alias("v")), ALL),
    ("decision_targets", lambda t: t["decisions"].where("kind = 'page'").join(t["surfaces"], F.col("target_id") == F.col("page_id"), "left_anti").select(F.col("target_id").alias("v")), ALL),
    ("findings_tolerated", lambda t: _unresolved(t, True), ALL),
    ("extraction_findings_resolved", lambda t: _unresolved(t, False), ("review", "citation")),
    ("canonical_toc_tree", lambda t: graph.tree_findings(t["toc"]).select(F.col("toc_id").alias("v")), ("review", "citation")),
    ("pdf_visual_evidence_complete", _pick("surfaces", "page_id", "page_image_sha256 is null"), STRICT),
    ("no_mock_evidence", _pick("evidence", "evidence_id", "engine like 'mock%'"), STRICT),
    ("manual_page_review", _undecided("page", "surfaces", "page_id"), STRICT),
    ("paragraph_semantic_coverage", _undecided("paragraph", "paragraphs", "paragraph_id"), STRICT),
    ("asset_occurrence_accounting", _undecided("asset", "assets", "occurrence_id"), STRICT),
    ("complex_object_accounting", _undecided("object", "objects", "object_id"), STRICT),
    ("paragraph_source_span_reversibility", lambda t: integrity.orphans(t["spans"], "block_id", t["canonical"], "block_id").select(F.col("paragraph_id").alias("v")), STRICT),
    ("paragraph_source_span_anchor_integrity", lambda t: t["spans"].join(t["canonical"].select("block_id", F.length("text").alias("size")), "block_id").where("span_start < 0 or span_end < span_start or span_end > size").select(F.col("paragraph_id").alias("v")), STRICT),
    ("canonical_block_disposition_coverage", _span_status("missing", "gap"), STRICT),
    ("canonical_block_single_disposition", _span_status("overlap"), STRICT),
    ("structure_candidate_disposition_coverage", _set_gap(lambda t: t["candidates"].select(F.col("candidate_id").alias("v")), lambda t: t["toc"].where("candidate_id is not null").select(F.col("candidate_id").alias("v"))), STRICT),
    ("chapter_boundary_partition", _boundary_partition, STRICT),
    ("canonical_toc_integrity", _set_gap(lambda t: t["boundaries"].select(F.col("boundary_id").alias("v")), lambda t: t["toc"].where("boundary_id is not null").select(F.col("boundary_id").alias("v"))), STRICT),
    ("source_use_boundary", lambda t: t["decisions"].where("kind = 'source_boundary'").agg(F.count("*").alias("n")).where("n < 1").select(F.col("n").cast("string").alias("v")), STRICT),
    ("semantic_reviewer_provenance", _pick("decisions", "seq", "reviewer is null or trim(reviewer) = ''"), STRICT),
]


def evaluate(tables: Tables, target: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """check_id, passed, n_observed and observed (at most 100 values, sorted) of the checks that a target asks for, or of those named."""
    return ordering.report({name: failing(tables) for name, failing, targets in CHECKS if target in targets and (names is None or name in names)})


def verdict(tables: Tables, target: str) -> DataFrame:
    """One row: target, failed and status."""
    return publishing.verdict(evaluate(tables, target).withColumn("blocks", F.lit(True)), target)


def of_export(chunks: DataFrame, assets: DataFrame, uses: DataFrame, markdown_headings: DataFrame, expected_headings: DataFrame) -> DataFrame:
    """check_id, passed and n_observed of a published set, from what it holds alone: chunks' invariants and order, assets used exactly
    once, and the headings (doc_id, place, level, title) that the structure asks for."""
    order = chunks.withColumn("prev", F.lag("order").over(Window.partitionBy("doc_id").orderBy("order")))
    head = markdown_headings.select("doc_id", "place", "level", "title").exceptAll(expected_headings.select("doc_id", "place", "level", "title"))
    lost = expected_headings.select("doc_id", "place", "level", "title").exceptAll(markdown_headings.select("doc_id", "place", "level", "title"))
    parts = {
        "chunk_invariants": publishing.chunk_findings(chunks).select(F.col("chunk_id").alias("v")), "chunk_order": order.where("prev is not null and order <> prev + 1").select(F.col("chunk_id").alias("v")),
        "asset_references": publishing.reference_findings(assets, uses, "occurrence_id").select(F.col("occurrence_id").alias("v")),
        "headings_unexpected": head.select(F.col("title").alias("v")), "headings_missing": lost.select(F.col("title").alias("v")),
        "text_digest": chunks.where(~ids.sha256(F.col("text")).eqNullSafe(F.col("text_sha256"))).select(F.col("chunk_id").alias("v")),
    }
    return ordering.report(parts).drop("observed")


def dom_regressions(rows: DataFrame) -> DataFrame:
    """Chunks (page_id, order, dom_paths) that begin before the one published before them on their page."""
    least = F.array_min("dom_paths")
    prev = F.lag(F.array_min("dom_paths")).over(Window.partitionBy("page_id").orderBy("order"))
    return rows.withColumns({"least": least, "prev": prev}).where("least < prev").select("page_id", "order")


def hidden_leaks(spans: DataFrame, hidden: DataFrame) -> DataFrame:
    """Spans (chunk_id, page_id, dom_path) that lie in hidden nodes (page_id, dom_path)."""
    return spans.join(hidden.select("page_id", "dom_path").distinct(), ["page_id", "dom_path"], "left_semi").select("chunk_id").distinct()
