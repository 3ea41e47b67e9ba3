"""From texts to ledgers: observations, selected blocks and paragraphs, each with a content-addressed identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text

ENGINE = "text_native"


def page_name(number: Column, prefix: str = "document_", digits: int = 8) -> Column:
    return F.concat(F.lit(prefix), ids.padded(number, digits))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """doc_id, source_sha, page_id, ordinal (from 1) and text of each piece of each row's text."""
    pieces = F.posexplode(F.split(F.col(text_col), separator)).alias("at", "piece")
    rows = docs.select(F.col(id_col).alias("doc_id"), ids.sha256(F.col(text_col)).alias("source_sha"), page_name(F.col(id_col)).alias("page_id"), pieces)
    return rows.select("doc_id", "source_sha", "page_id", (F.col("at") + 1).cast("long").alias("ordinal"), F.col("piece").alias("text"))


def evidence(pieces: DataFrame, engine: str = ENGINE) -> DataFrame:
    """An observation a piece: identity, digest, kind, scripts and direction."""
    t = F.col("text")
    own = ids.evidence_id(F.col("source_sha"), F.col("page_id"), F.lit(engine), F.col("ordinal"), t)
    return pieces.select("doc_id", "source_sha", "page_id", "ordinal", "text", F.lit(engine).alias("engine"), own.alias("evidence_id"), ids.sha256(t).alias("text_sha256"), text.block_kind(t).alias("block_kind"), text.scripts(t).alias("scripts"), text.direction(t).alias("direction"))


def canonical(observed: DataFrame, reason: str = "only_native_observation") -> DataFrame:
    """The selected reading of each observation."""
    return observed.select(
        "doc_id", ids.block_id(F.col("page_id"), F.col("evidence_id")).alias("block_id"), "page_id", "ordinal", "evidence_id", "text", "block_kind", F.lit("machine_selected").alias("selection_status"), F.lit(reason).alias("selection_reason")
    )


def paragraphs(blocks: DataFrame) -> DataFrame:
    """A paragraph a block: one span over all of its text, and its place in the document's order."""
    end = F.length("text").cast("long")
    spans = ids.spans_json(F.col("block_id"), F.col("evidence_id"), F.lit(0).cast("long"), end)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id", "ordinal")).cast("long")
    return blocks.select("doc_id", "block_id", ids.paragraph_id(spans).alias("paragraph_id"), order.alias("order"), "text", "block_kind", F.lit(0).cast("long").alias("span_start"), end.alias("span_end"), ids.sha256(F.col("text")).alias("text_sha256"))


def legacy_blocks(blocks: DataFrame, observed: DataFrame) -> DataFrame:
    """The flat projection of older packages: normalised text, and no engine name for native ones."""
    native = F.col("engine").isin("text_native", "epub_dom", "docx_ooxml", "pdf_native", "pdf_native_words", "html_native")
    own = observed.select("evidence_id", "engine")
    return blocks.join(own, "evidence_id", "left").select("block_id", "page_id", "text", text.collapse(F.col("text")).alias("normalized_text"), "block_kind", F.when(~native, F.col("engine")).alias("ocr_engine"))


def running_headers(rows: DataFrame, key: Column, least: int = 3) -> DataFrame:
    """``rows`` whose key, without case or outer blanks, occurs often, with the number of its occurrences.

    Counted by partial aggregates and joined back, so that a key with a third of all rows stays spread out.
    """
    keyed = rows.withColumn("header_key", F.lower(F.trim(key)))
    often = keyed.groupBy("header_key").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= least)
    return keyed.join(often, "header_key")


def first_by(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key: an aggregate, whose map side leaves one row a key and task."""
    names = rows.columns
    best = rows.groupBy(*(k.alias(f"key_{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("row"))
    return best.select("row.*")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts: text_sha256, members, and the row with the smallest id as selected."""
    return docs.groupBy(ids.sha256(F.col(text_col)).alias("text_sha256")).agg(F.count("*").alias("members"), F.min(id_col).alias("selected_id"))
