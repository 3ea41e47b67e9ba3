"""Reviewed changes to canonical blocks. Blocks: doc_id, block_id, ordinal, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids


def _in_order(value: str) -> Column:
    """A group's values by their blocks' ordinals; an aggregate."""
    return F.transform(F.sort_array(F.collect_list(F.struct("ordinal", value))), lambda x: x[value])



def exclude(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """``blocks`` with canonical_disposition and exclusion_reason of those in ``chosen`` (block_id, reason)."""
    own = chosen.select("block_id", F.col("reason").alias("exclusion_reason"))
    out = blocks.join(own, "block_id", "left")
    return out.withColumn("canonical_disposition", F.when(F.col("exclusion_reason").isNotNull(), "excluded").otherwise("included"))


def correct(blocks: DataFrame, fixes: DataFrame) -> DataFrame:
    """``blocks`` with the texts of ``fixes`` (block_id, new_text) in place of theirs."""
    out = blocks.join(fixes.select("block_id", "new_text"), "block_id", "left")
    return out.withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def select_variant(blocks: DataFrame, observed: DataFrame, chosen: DataFrame) -> DataFrame:
    """``blocks`` that take another observation's text, where both are on one page and of one variant group.

    ``observed``: evidence_id, page_id, variant_group_id, text. ``chosen``: block_id, selected.
    """
    other = observed.select(F.col("evidence_id").alias("selected"), F.col("page_id").alias("page_"), F.col("variant_group_id").alias("group_"), F.col("text").alias("text_"))
    own = observed.select("evidence_id", "variant_group_id")
    out = blocks.join(own, "evidence_id", "left").join(chosen, "block_id", "left").join(other, "selected", "left")
    fits = F.coalesce((F.col("page_") == F.col("page_id")) & (F.col("group_") == F.col("variant_group_id")), F.lit(False))
    return out.select(*(c for c in blocks.columns if c not in ("text", "evidence_id")), F.when(fits, F.col("text_")).otherwise(F.col("text")).alias("text"), F.when(fits, F.col("selected")).otherwise(F.col("evidence_id")).alias("evidence_id"))


def split_at(blocks: DataFrame, cut: Column) -> DataFrame:
    """Two blocks for each whose ``cut`` (characters before it) is inside its text; others as they are."""
    size = F.length("text")
    inside = F.coalesce((cut > 0) & (cut < size), F.lit(False))
    ranges = F.when(inside, F.array(F.struct(F.lit(0).alias("a"), cut.cast("int").alias("b")), F.struct(cut.cast("int").alias("a"), size.alias("b")))).otherwise(F.array(F.struct(F.lit(0).alias("a"), size.alias("b"))))
    rows = blocks.select("doc_id", "block_id", "ordinal", "text", inside.alias("was_split"), F.posexplode(ranges).alias("part", "range"))
    a, b = F.col("range.a"), F.col("range.b")
    own = ids.stable_id("blk_split", F.col("block_id"), F.col("part"), a, b)
    return rows.select("doc_id", F.col("block_id").alias("source_block_id"), F.when(F.col("was_split"), own).otherwise(F.col("block_id")).alias("block_id"), "ordinal", "part", a.alias("span_start"), b.alias("span_end"), F.substring(F.col("text"), a + 1, b - a).alias("text"))


def join_groups(blocks: DataFrame, group: Column) -> DataFrame:
    """A block for each group of neighbours of a document: members' texts with blanks between; valid if none is skipped."""
    by = blocks.withColumn("group_", group).groupBy("doc_id", "group_").agg(
        F.count("*").alias("members"), F.min("ordinal").alias("ordinal"), (F.max("ordinal") - F.min("ordinal") + 1 == F.count("*")).alias("valid"),
        F.array_join(_in_order("block_id"), "|").alias("ids"), F.array_join(_in_order("text"), " ").alias("text"),
    )
    own = F.concat(F.lit("blk_join_"), ids.short_sha(F.col("ids")))
    return by.select("doc_id", own.alias("block_id"), "ordinal", "members", "valid", "text")


def resegment(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Blocks cut anew: ``segments`` has segment, block_id, span_start, span_end, kind. Text of the pieces in source order."""
    pieces = segments.join(blocks.select("doc_id", "block_id", "ordinal", "text"), "block_id")
    piece = F.substring(F.col("text"), F.col("span_start").cast("int") + 1, (F.col("span_end") - F.col("span_start")).cast("int"))
    by = pieces.groupBy("doc_id", "segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "span_start", "block_id", "span_end", piece.alias("piece")))), lambda x: x).alias("parts"), F.first("kind").alias("block_kind"))
    place = F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["block_id"], x["span_start"], x["span_end"])), ",")
    own = ids.stable_id("blk_resegment", F.col("segment"), place)
    return by.select("doc_id", own.alias("block_id"), "segment", F.col("parts")[0]["ordinal"].alias("ordinal"), "block_kind", F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("text"))


def reorder(blocks: DataFrame, key: list[Column]) -> DataFrame:
    """``blocks`` with new_ordinal, their place in each document when sorted by ``key``."""
    return blocks.withColumn("new_ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy(*key)).cast("long"))
