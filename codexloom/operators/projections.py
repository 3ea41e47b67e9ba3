"""Rows derived for review and publication: structure paths, enriched spans, leaps, chunks as published, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, ids, text


def structure_paths(paragraphs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``paragraphs`` with the structure_path of the boundary (boundary_id, title, structure_path, paragraph_ids) that holds them; a boundary
    without a path goes by its title, else its id."""
    named = F.coalesce(F.when(F.size("structure_path") > 0, F.col("structure_path")), F.array(F.coalesce(F.nullif("title", F.lit("")), "boundary_id")))
    own = boundaries.select(F.explode("paragraph_ids").alias("paragraph_id"), named.alias("structure_path"), "boundary_id")
    return paragraphs.join(own, "paragraph_id", "left")


def enriched_spans(spans: DataFrame, observed: DataFrame) -> DataFrame:
    """paragraph_id and its spans in order, each with the text, digest and place of its observation.

    ``spans``: paragraph_id, place, block_id, evidence_id, span_start, span_end. ``observed``: evidence_id, text, dom_path, href, tag.
    """
    own = observed.select("evidence_id", F.col("text").alias("source_text"), ids.sha256(F.col("text")).alias("source_text_sha256"), "dom_path", "href", "tag")
    rows = spans.join(own, "evidence_id", "left")
    fields = ("place", "block_id", "evidence_id", "span_start", "span_end", "source_text", "source_text_sha256", "dom_path", "href", "tag")
    return rows.groupBy("paragraph_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("source_spans"))


def leaps(decided: DataFrame, used: DataFrame) -> DataFrame:
    """Reasoning leaps of paragraph decisions (paragraph_id, leaps: array of premises, inference, premise_paragraph_ids), a row each, with what
    is wrong: no inference, no premises, or premises from paragraphs that aren't used (paragraph_id)."""
    rows = decided.select("paragraph_id", F.posexplode("leaps").alias("at", "leap")).select("paragraph_id", "at", "leap.*")
    rows = rows.withColumn("leap_id", ids.stable_id("leap", F.col("paragraph_id"), F.col("at")))
    lost = rows.select("leap_id", F.explode("premise_paragraph_ids").alias("p")).join(used.select(F.col("paragraph_id").alias("p")).distinct(), "p", "left_anti").groupBy("leap_id").agg(F.count("*").alias("lost"))
    finding = F.when(F.coalesce(F.trim("inference"), F.lit("")) == "", "inference_missing").when(F.size("premises") < 1, "premises_missing").when(F.col("lost") > 0, "premise_not_used")
    return rows.join(lost, "leap_id", "left").select("leap_id", "paragraph_id", "inference", finding.alias("finding"))


def synthetic_images(assets: DataFrame, uses: DataFrame) -> DataFrame:
    """Rows for assets (occurrence_id, page_id, rank) that no row uses, so that every one is published."""
    left = assets.join(uses.select("occurrence_id").distinct(), "occurrence_id", "left_anti")
    return left.select(ids.stable_id("para_image", F.col("occurrence_id")).alias("paragraph_id"), "page_id", "rank", F.concat(F.lit("[[IMAGE "), F.col("occurrence_id"), F.lit("]]")).alias("text"), F.array("occurrence_id").alias("asset_occurrence_ids"))


def embedding_manifest(chunks: DataFrame, parts: list[Column]) -> DataFrame:
    """One row for whoever embeds the chunks: how many, the digest of what they are, and the key that says when they are stale."""
    from .publishing import invalidation_key

    by = chunks.agg(F.count("*").alias("chunk_count"), ids.rows_digest(ids.row_json({"chunk_id": "string", "text_sha256": "string"}, ["chunk_id", "text_sha256"])).alias("rows_digest"))
    return by.select(F.lit("unembedded").alias("status"), "chunk_count", F.col("rows_digest").alias("input_sha256"), invalidation_key([*parts, F.col("rows_digest")]).alias("invalidation_key"))


def page_extent(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (page_id, width, height) with the share that images (page_id, box) cover."""
    area = F.col("width") * F.col("height")
    return pages.join(blocks, "page_id", "left").groupBy("page_id").agg(F.coalesce(geometry.coverage(F.col("box"), area), F.lit(0.0)).alias("image_coverage"))


def index_start(rows: DataFrame, page: str = "source_page", value: str = "text") -> DataFrame:
    """The first page of each document whose outline names an index."""
    return rows.groupBy("doc_id").agg(F.min(F.when(F.lower(F.trim(value)) == "index", F.col(page))).alias("index_page"))


def least_depth(titles: DataFrame) -> DataFrame:
    """The shallowest level at which each title stands."""
    return titles.groupBy(text.heading_key(F.col("title")).alias("title_key")).agg(F.min("level").alias("depth"))


def nav_targets(nav: DataFrame, pages: DataFrame) -> DataFrame:
    """Navigation entries (item, path) with the page of the spine (path, page_id) they lead to: ok, ambiguous or non_spine."""
    by = nav.join(pages, "path", "left").groupBy("item", "path").agg(F.count("page_id").alias("n"), F.min("page_id").alias("first"))
    return by.select("item", "path", F.when(F.col("n") == 1, F.col("first")).alias("page_id"), F.when(F.col("n") == 0, "non_spine").when(F.col("n") == 1, "ok").otherwise("ambiguous").alias("status"))


def chapter_images(chapters: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """(toc_id, image_id) of images on a page or spine item of a chapter's blocks, which are those in its range.

    ``chapters``: doc_id, toc_id, start_index, end_index; ``blocks``: doc_id, at, page_id; ``images``: doc_id, image_id, page_id.
    """
    pages = chapters.join(blocks, "doc_id").where("at >= start_index and at < end_index").select("doc_id", "toc_id", "page_id").distinct()
    return images.join(pages, ["doc_id", "page_id"]).select("doc_id", "toc_id", "image_id").distinct()


def resolved(findings: DataFrame, methods: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings (finding_id, code) and whether a resolution (finding_id, method, reviewer_kind, affected, referenced, replacement, sha_ok) stands.

    ``allowed``: code, method. What each method asks for: hashes verified for all that is affected; replacements that don't stand among
    what they replace; what is set aside no longer among the referenced; a human where only one may decide.
    """
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    a, r, n = F.col("affected"), F.col("referenced"), F.col("replacement")
    m = F.col("method")
    backed = (
        F.when(m == "source_image_hash_verified", F.col("sha_ok") & same(a, r))
        .when(m.isin("replacement_evidence_selected", "corrected_bbox_attached"), (F.size(n) > 0) & ~F.arrays_overlap(n, a))
        .when(m.isin("block_quarantined", "asset_quarantined", "page_quarantined"), ~F.arrays_overlap(a, r))
        .when(m.isin("rendered_rendition_attached", "visual_representation_verified", "asset_ingested_and_hashed", "producer_manifest_cryptographically_verified"), F.col("sha_ok"))
        .when(m.isin("source_and_rendition_compared", "producer_manifest_verified"), F.col("sha_ok") & (F.col("reviewer_kind") == "human"))
        .when(m.isin("reading_order_verified", "canonical_order_corrected"), a == r)
        .when(m.isin("visual_regions_reconciled", "visual_transcription_verified", "accepted_view_selected", "alternate_variants_preserved", "navigation_target_reconciled"), same(a, r))
        .otherwise(F.lit(False))
    )
    good = methods.withColumn("backed", F.coalesce(backed, F.lit(False)))
    both = findings.join(allowed, "code").join(good, ["finding_id", "method"])
    stands = both.groupBy("finding_id").agg(F.bool_or("backed").alias("stands"))
    return findings.join(stands, "finding_id", "left").select("finding_id", "code", F.coalesce("stands", F.lit(False)).alias("resolved"))


def replayed(decided: DataFrame) -> DataFrame:
    """Decisions (seq, canonical_revision, target_id) with the step at which a rebuild applies them: revisions in the order of their first
    decision."""
    first = decided.groupBy("canonical_revision").agg(F.min("seq").alias("first"))
    step = first.withColumn("step", F.row_number().over(Window.orderBy("first")))  # a handful of revisions
    return decided.join(step.select("canonical_revision", "step"), "canonical_revision")


def outline_candidates(outline: DataFrame) -> DataFrame:
    """Candidates for a table of contents from a document's outline (doc_id, place, level, title, page): titles that aren't blank, on real pages."""
    title = text.collapse(F.col("title"))
    rows = outline.select("doc_id", "place", F.col("level").cast("int").alias("level"), title.alias("title"), F.when(F.col("page") >= 1, F.col("page")).alias("source_page"))
    own = ids.stable_id("toccand", F.col("doc_id"), F.col("place"), F.col("title"))
    return rows.where("title <> '' and level >= 1").select("doc_id", own.alias("candidate_id"), "place", "level", "title", "source_page")
