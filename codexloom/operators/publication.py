"""What a package publishes: whole chunk rows, assets in source order, object rows, export paths, and the account of a publication.

All tables have ``package_id``, so many packages are published at once. A chunk row has 42 fields; what belongs to a paragraph but stands in
other tables (objects, assets, links, anchors) is gathered by aggregates of its own before it is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids


def export_paths(out: str) -> dict[str, str]:
    """Where a publication's files go: beside a Markdown target, with its stem, else into a folder."""
    stem, dot, suffix = out.rpartition(".")
    if dot and "/" not in suffix and suffix.lower() == "md":
        return {"document": out, "chunks": f"{stem}.chunks.jsonl", "manifest": f"{stem}.manifest.json", "embedding": f"{stem}.embedding.json"}
    base = out.rstrip("/")
    return {"document": f"{base}/document.md", "chunks": f"{base}/chunks.jsonl", "manifest": f"{base}/manifest.json", "embedding": f"{base}/embedding_manifest.json"}


def reviewer_findings(reviewer: dict, scope: dict) -> list[str]:
    """What is wrong with who reviews: not verified, of an unknown kind, unnamed, or of another tenant or workspace."""
    out = [] if reviewer.get("verified") else ["verified"]
    out += [] if reviewer.get("reviewer_type") in ("human", "agent_semantic") else ["reviewer_type"]
    out += [k for k in ("reviewer_id", "review_session_id") if not reviewer.get(k)]
    return out + [k for k in ("tenant_id", "workspace_id") if scope.get(k) and reviewer.get(k) != scope[k]]


def first_files(files: DataFrame, formats: tuple[str, ...], most: int | None) -> DataFrame:
    """The first ``most`` files (path, link) of known formats, by path: a bounded sort, as the limit is what is asked for. A link is an error:
    it has ``finding``."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.where(F.col("link") | suffix.isin(*formats)).withColumn("finding", F.when(F.col("link"), "link")).orderBy("path")
    return rows if most is None else rows.limit(most)


def asset_order(assets: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``assets`` (package_id, occurrence_id, page_id, dom_path, visual_rank, box) with ``place``, from 1 in each package: by surface, place in the
    tree, visual rank, then from the top of the page; without one of these at the end."""
    last, far = F.lit(10**9), F.lit(float("inf"))
    box = F.when(F.size("box") == 4, F.array(*(F.col("box")[k].cast("double") for k in (1, 0, 3, 2)))).otherwise(F.array(far, far, far, far))
    own = assets.join(surfaces.select("package_id", "page_id", F.col("ordinal").alias("surface_")), ["package_id", "page_id"], "left")
    order = [F.coalesce("surface_", last), F.coalesce("dom_path", F.array().cast("array<int>")), F.coalesce("visual_rank", last), F.coalesce(box, F.array(far, far, far, far)), F.coalesce("occurrence_id", F.lit(""))]
    return own.withColumn("place", F.row_number().over(Window.partitionBy("package_id").orderBy(*order))).drop("surface_")


def object_rows(objects: DataFrame, exported: DataFrame, scheme: str = "package") -> DataFrame:
    """Objects with their address and the paths of their exported assets, in the objects' own order.

    ``exported``: package_id, occurrence_id, export_path.
    """
    at = objects.select("package_id", "object_id", F.posexplode("asset_occurrence_ids").alias("at", "occurrence_id")).join(exported.select("package_id", "occurrence_id", "export_path"), ["package_id", "occurrence_id"])
    paths = at.groupBy("package_id", "object_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "export_path"))), lambda x: x["export_path"]).alias("asset_export_paths"))
    uri = F.concat(F.lit(f"{scheme}://"), "package_id", F.lit("/object/"), "object_id")
    return objects.join(paths, ["package_id", "object_id"], "left").withColumns({"object_uri": uri, "asset_export_paths": F.coalesce("asset_export_paths", F.array().cast("array<string>"))})


def _gathered(rows: DataFrame, name: str, order: str, value: Column) -> DataFrame:
    return rows.groupBy("package_id", "paragraph_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]).alias(name))


#: Fields that a chunk takes over from its paragraph's decision, and those from its package.
REVIEWED = ("paragraph_role", "semantic_summary", "claim_candidates", "method_candidates", "metric_candidates", "boundary_candidates", "reasoning_leap_candidates", "review_decision_id")
PACKAGE = ("trust_status", "package_review_status", "run_id", "source_sha256", "canonical_revision", "review_revision", "access_tags", "privacy", "rights_basis", "retention_policy", "tenant_id", "workspace_id", "language")


def chunk_rows(paragraphs: DataFrame, packages: DataFrame, objects: DataFrame, assets: DataFrame, links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Whole chunk rows.

    ``paragraphs``: package_id, paragraph_id, order, text, source_paragraph_ids, source_spans, source_reconstruction, page_id, page_anchor,
    structure_path, block_kind, suppressed, list_semantics and the fields REVIEWED. ``packages``: package_id and the fields PACKAGE. ``objects``: package_id,
    paragraph_id, at, object_id. ``assets``: package_id, paragraph_id, at, occurrence_id, asset_sha256, asset_path, page_id. ``links``: package_id,
    paragraph_id, at, kind, href, text. ``anchors``: package_id, paragraph_id, at, anchor_id.
    """
    c, none = F.col, F.array().cast("array<string>")
    visual = F.struct("occurrence_id", "asset_sha256", "asset_path", "page_id")
    parts = [_gathered(objects, "object_ids", "at", c("object_id")), _gathered(assets, "visual_anchors", "at", visual), _gathered(links, "links", "at", F.struct("kind", "href", "text")), _gathered(anchors, "source_dom_anchor_ids", "at", c("anchor_id"))]
    rows = reduce(lambda a, b: a.join(b, ["package_id", "paragraph_id"], "left"), parts, paragraphs).join(packages.select("package_id", *PACKAGE), "package_id", "left")
    sha = ids.sha256(c("text"))
    spans, shown = (F.coalesce(F.size(n), F.lit(0)) > 0 for n in ("source_spans", "visual_anchors"))
    link = c("block_kind") == "link_annotation"
    kind = F.when(spans, "source_text_span").when(shown, "asset_occurrence_only").when(link, "pdf_link_annotation_only").otherwise("synthetic_structure")
    back = F.when(spans, "source_spans_bound").when(shown, "asset_sha256_page_occurrence_bound").when(link, "pdf_page_xref_bbox_bound").otherwise("synthetic_no_source_claim")
    of_assets = lambda field: F.coalesce(F.transform("visual_anchors", lambda x: x[field]), none)
    return rows.select(
        ids.chunk_id(c("paragraph_id"), sha).alias("chunk_id"), "order", "text", sha.alias("text_sha256"), F.coalesce(F.when(F.size("source_paragraph_ids") > 0, c("source_paragraph_ids")), F.array("paragraph_id")).alias("paragraph_ids"),
        "source_spans", "source_reconstruction", F.coalesce("page_anchor", "page_id").alias("page_anchor"), "structure_path", "block_kind", F.when(F.coalesce("suppressed", F.lit(False)), "suppressed_structural_echo").otherwise("rendered").alias("visible_projection"),
        "list_semantics", F.coalesce("object_ids", none).alias("object_ids"), of_assets("occurrence_id").alias("asset_occurrence_ids"), of_assets("asset_path").alias("asset_paths"), "links", F.coalesce("source_dom_anchor_ids", none).alias("source_dom_anchor_ids"),
        "visual_anchors", kind.alias("anchor_classification"), back.alias("reversibility_status"), *REVIEWED, "package_id", *PACKAGE,
    )


def account(failing: dict[str, tuple[DataFrame, bool]], packages: DataFrame) -> DataFrame:
    """package_id, metric, n, observed and fails of a publication's metrics: values (package_id, v) and whether one of them fails it."""
    parts = [df.select("package_id", F.lit(name).alias("metric"), F.col("v").cast("string").alias("v")) for name, (df, _) in failing.items()]
    by = reduce(DataFrame.unionByName, parts).groupBy("package_id", "metric").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("v")).alias("observed"))
    rows = packages.select("package_id", F.explode(F.array(*map(F.lit, failing))).alias("metric"))
    strict = [name for name, (_, fails) in failing.items() if fails]
    out = rows.join(by, ["package_id", "metric"], "left").select("package_id", "metric", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("observed", F.array().cast("array<string>")).alias("observed"))
    return out.withColumn("fails", F.col("metric").isin(*strict) & (F.col("n") > 0))


def _lacking(want: DataFrame, have: DataFrame) -> DataFrame:
    return want.join(have, ["package_id", "v"], "left_anti")


def _exploded(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.select("package_id", F.explode(column).alias("v"))


def validation(t: dict[str, DataFrame]) -> DataFrame:
    """The account of a publication: metrics of what was expected, what is there and what is wrong, one row for each package and metric.

    Tables: packages (headings_required), chunks (:func:`chunk_rows`), assets (occurrence_id, place; to be published), objects (object_id, object_kind,
    markdown, target; to be published), headings and expected_headings (place, level, title), hidden (page_id, dom_path), chunk_nodes (chunk_id, order, page_id,
    dom_path), numbered (chunk_id; headings under the wrong number).
    """
    chunks, objects, c = t["chunks"], t["objects"], F.col
    v = lambda df, name: df.select("package_id", c(name).alias("v"))
    uses = chunks.select("package_id", "order", F.posexplode("asset_occurrence_ids").alias("at", "v"))
    of_kind = lambda *kinds: v(objects.where(c("object_kind").isin(*kinds)), "object_id")
    rendered = _exploded(chunks.where("visible_projection = 'rendered'"), "object_ids").distinct()
    by_use = uses.groupBy("package_id", "v").agg(F.count("*").alias("n"), F.min(F.struct("order", "at")).alias("first"))
    placed = Window.partitionBy("package_id")
    got = by_use.withColumn("k", F.row_number().over(placed.orderBy("first")))
    want = t["assets"].join(by_use.select("package_id", c("v").alias("occurrence_id")), ["package_id", "occurrence_id"], "left_semi").withColumn("k", F.row_number().over(placed.orderBy("place")))
    moved = want.join(got.select("package_id", "k", "v"), ["package_id", "k"]).where("occurrence_id <> v").select("package_id", c("occurrence_id").alias("v"))
    least = t["chunk_nodes"].groupBy("package_id", "page_id", "chunk_id", "order").agg(F.min("dom_path").alias("least"))
    back = least.withColumn("before", F.lag("least").over(Window.partitionBy("package_id", "page_id").orderBy("order"))).where("least < before")
    leaks = t["chunk_nodes"].join(t["hidden"].select("package_id", "page_id", "dom_path").distinct(), ["package_id", "page_id", "dom_path"], "left_semi").select("package_id", c("chunk_id").alias("v")).distinct()
    heads, needed = (x.select("package_id", "place", "level", "title") for x in (t["headings"], t["expected_headings"]))
    asked = t["packages"].where("headings_required").select("package_id")
    wrong = heads.exceptAll(needed).unionByName(needed.exceptAll(heads)).select("package_id", c("title").alias("v"))
    shown = chunks.select("package_id", "chunk_id", F.explode("object_ids").alias("object_id"), "text")
    tables = objects.where("object_kind = 'table'").join(shown.groupBy("package_id", "object_id").agg(F.count("*").alias("n"), F.min("text").alias("text")), ["package_id", "object_id"])
    unfaithful = tables.where((c("n") != 1) | ~c("text").eqNullSafe(c("markdown")))
    targets = objects.where("object_kind = 'callout' and target like '#%'").select("package_id", F.expr("substring(target, 2)").alias("v")).distinct()
    emitted = _exploded(chunks, "source_dom_anchor_ids").distinct()
    external = chunks.select("package_id", F.explode("links").alias("l")).where("l.kind = 'external'").select("package_id", c("l.href").alias("v"))
    metrics: dict[str, tuple[DataFrame, bool]] = {
        "asset_occurrences_expected": (v(t["assets"], "occurrence_id"), False), "asset_occurrences_referenced": (v(by_use, "v"), False), "missing_asset_occurrence_ids": (_lacking(v(t["assets"], "occurrence_id"), v(by_use, "v")), True),
        "duplicate_asset_occurrence_ids": (v(by_use.where("n > 1"), "v"), True), "asset_occurrence_source_order": (moved, True), "asset_dom_order_regressions": (v(back, "chunk_id"), True),
        "canonical_structure_headings_expected": (v(needed, "title"), False), "canonical_structure_headings_emitted": (v(heads, "title"), False), "canonical_heading_mismatches": (wrong.join(asked, "package_id", "left_semi"), True),
        "css_hidden_dom_paths_audited": (t["hidden"].select("package_id", F.array_join(F.transform("dom_path", lambda x: x.cast("string")), ".").alias("v")), False), "css_hidden_chunk_leak_ids": (leaks, True), "numbered_heading_hierarchy_violations": (v(t["numbered"], "chunk_id"), True),
        "missing_source_reconstruction_chunk_ids": (v(chunks.where("anchor_classification = 'source_text_span' and source_reconstruction is null"), "chunk_id"), True),
        "table_objects_expected": (of_kind("table"), False), "table_objects_rendered": (of_kind("table").join(rendered, ["package_id", "v"], "left_semi"), False), "table_cell_dom_fidelity_violations": (v(unfaithful, "object_id"), True), "missing_table_object_ids": (_lacking(of_kind("table"), rendered), True),
        "external_links_rendered": (external, False), "external_link_annotations_expected": (of_kind("external_link"), False), "external_link_annotations_referenced": (of_kind("external_link").join(rendered, ["package_id", "v"], "left_semi"), False), "missing_external_link_object_ids": (_lacking(of_kind("external_link"), rendered), True),
        "callout_links_expected": (of_kind("callout"), False), "callout_links_referenced": (of_kind("callout").join(rendered, ["package_id", "v"], "left_semi"), False), "missing_callout_object_ids": (_lacking(of_kind("callout"), rendered), True),
        "callout_target_fragments_expected": (targets, False), "callout_target_fragments_materialized": (targets.join(emitted, ["package_id", "v"], "left_semi"), False), "missing_callout_target_fragments": (_lacking(targets, emitted), True),
        "code_objects_expected": (of_kind("code"), False), "code_objects_rendered": (of_kind("code").join(rendered, ["package_id", "v"], "left_semi"), False), "missing_code_object_ids": (_lacking(of_kind("code"), rendered), True),
        "source_list_items_rendered": (v(chunks.where("list_semantics is not null"), "chunk_id"), False),
    }
    return account(metrics, t["packages"])


def status(accounts: DataFrame) -> DataFrame:
    """package_id and status of a publication."""
    return accounts.groupBy("package_id").agg(F.when(F.bool_or("fails"), "FAIL_REVIEW").otherwise("PASS").alias("status"))

