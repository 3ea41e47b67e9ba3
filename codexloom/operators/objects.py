"""Complex objects: tables, figures, captions, code, callouts, equations, indexes and links, from observations and assets.

Observations: evidence_id, page_id, ordinal, text, and what a reader knows of their place in the DOM (table, row, column, tag, pre_path,
figure, dom_path). Assets: occurrence_id, page_id, figure, box, rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, ids
from . import spatial

COLUMNS = ("object_id", "object_kind", "page_id", "evidence_ids", "asset_occurrence_ids", "text", "box")


def _ordered(value: str, by: str = "ordinal") -> Column:
    """A group's values in order; an aggregate."""
    return F.transform(F.sort_array(F.collect_list(F.struct(by, value))), lambda x: x[value])


def object_id(kind: str, *parts: str) -> Column:
    return ids.stable_id("obj", kind, *map(F.col, parts))


def _shaped(df: DataFrame, kind: str, identity: str) -> DataFrame:
    none = {"evidence_ids": "array<string>", "asset_occurrence_ids": "array<string>", "text": "string", "box": "array<double>"}
    for name, type_ in none.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(type_))
    return df.withColumns({"object_id": object_id(kind, "page_id", identity), "object_kind": F.lit(kind)}).select(*COLUMNS)


def tables(observed: DataFrame) -> DataFrame:
    """A table of each page's cells; ``table_cells`` gives them for rendering."""
    by = observed.where("table is not null").groupBy("page_id", "table").agg(_ordered("evidence_id").alias("evidence_ids"), F.array_join(_ordered("text"), " ").alias("text"))
    return _shaped(by, "table", "table")


def table_cells(observed: DataFrame) -> DataFrame:
    """Cells as ``rendering.table_markdown`` takes them."""
    return observed.where("table is not null").select(object_id("table", "page_id", "table").alias("object_id"), "row", "column", "tag", "text", "container", "ordinal", F.lit(None).cast("string").alias("caption"))


def code(observed: DataFrame) -> DataFrame:
    """A code object of each ``pre``, its fragments in order."""
    by = observed.where("pre_path is not null").groupBy("page_id", "pre_path").agg(_ordered("evidence_id").alias("evidence_ids"), F.array_join(_ordered("text"), "").alias("text"))
    return _shaped(by, "code", "pre_path")


def equations(observed: DataFrame) -> DataFrame:
    rows = observed.where("block_kind = 'equation_candidate'").select("page_id", "evidence_id", F.array("evidence_id").alias("evidence_ids"), "text")
    return _shaped(rows, "equation", "evidence_id")


def figures(assets: DataFrame, observed: DataFrame) -> DataFrame:
    """A figure of each group of assets with one identity on a page, with the box around them and the text of its caption."""
    caption = observed.where("block_kind = 'caption_candidate' and figure is not null").groupBy("page_id", "figure").agg(F.min_by("text", "ordinal").alias("text"), _ordered("evidence_id").alias("evidence_ids"))
    by = assets.withColumn("figure", F.coalesce("figure", "occurrence_id")).groupBy("page_id", "figure").agg(_ordered("occurrence_id", "rank").alias("asset_occurrence_ids"), geometry.union(F.col("box")).alias("box"))
    return _shaped(by.join(caption, ["page_id", "figure"], "left"), "figure", "figure")


def captions(observed: DataFrame) -> DataFrame:
    rows = observed.where("block_kind = 'caption_candidate'").select("page_id", "evidence_id", F.array("evidence_id").alias("evidence_ids"), "text")
    return _shaped(rows, "caption", "evidence_id")


def callouts(assets: DataFrame, observed: DataFrame) -> DataFrame:
    """Callout images with the observations at their place in the DOM (page and path)."""
    own = observed.groupBy("page_id", "dom_path").agg(_ordered("evidence_id").alias("evidence_ids"))
    rows = assets.where("callout").join(own, ["page_id", "dom_path"], "left").withColumn("asset_occurrence_ids", F.array("occurrence_id"))
    return _shaped(rows.select("page_id", "occurrence_id", "evidence_ids", "asset_occurrence_ids", "box"), "callout", "occurrence_id")


def links(annotations: DataFrame, observed: DataFrame) -> DataFrame:
    """Link annotations (page_id, id, box, href) with the observations under them."""
    hit = spatial.intersecting(annotations, observed.where("box is not null").select("page_id", F.col("evidence_id").alias("id"), "box"))
    under = hit.groupBy("page_id", F.col("left_id").alias("id")).agg(F.sort_array(F.collect_set("right_id")).alias("evidence_ids"))
    return _shaped(annotations.join(under, ["page_id", "id"], "left").select("page_id", "id", "evidence_ids", F.col("href").alias("text"), "box"), "link", "id")


def all_objects(observed: DataFrame, assets: DataFrame) -> DataFrame:
    """Every kind that follows from observations and assets."""
    parts = [tables(observed), code(observed), equations(observed), captions(observed), figures(assets.where("not callout"), observed), callouts(assets, observed)]
    return reduce(DataFrame.unionByName, parts)


def caption_of_figure(figures_: DataFrame, captions_: DataFrame, most: float = 180.0) -> DataFrame:
    """The nearest caption below each figure, for figures without one of their own (page_id, id, bottom; page_id, id, top)."""
    return spatial.nearest_following(figures_, captions_, most)


def placed_after(unlinked: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each unlinked image (page_id, id, rank) the closest anchor (page_id, id, rank) before it on the page, else the first after.

    One window a page over both: the last anchor so far, else the next.
    """
    both = unlinked.select("page_id", "rank", F.lit(1).alias("kind"), F.col("id").alias("image_id"), F.lit(None).cast("string").alias("anchor")).unionByName(
        anchors.select("page_id", "rank", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("image_id"), F.col("id").cast("string").alias("anchor"))
    )
    order = Window.partitionBy("page_id").orderBy("rank", "kind")
    before = F.last("anchor", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("anchor", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return both.withColumns({"before": before, "after": after}).where("kind = 1").select("page_id", "image_id", F.coalesce("before", "after").alias("anchor_id"), F.col("before").isNotNull().alias("is_after"))


def component_order(members: DataFrame) -> DataFrame:
    """Reading order of assets (page_id, component, id, box): components by the row of six points in which they begin, then from the
    left, then from the top; their members from the top."""
    own = Window.partitionBy("page_id", "component")
    top, left = F.min(F.col("box")[1]).over(own), F.min(F.col("box")[0]).over(own)
    order = Window.partitionBy("page_id").orderBy(F.floor(F.col("top_") / 6), "left_", "top_", "component", F.col("box")[1], F.col("box")[0], F.col("box")[3], F.col("box")[2], "id")
    return members.withColumns({"top_": top, "left_": left}).withColumn("rank", F.row_number().over(order)).drop("top_", "left_")


def within_slots(rows: DataFrame) -> DataFrame:
    """Rows (page_id, order, asset_rank or null): those with assets keep their slots among each other but in the order of their assets."""
    held = rows.where("asset_rank is not null")
    slot = F.row_number().over(Window.partitionBy("page_id").orderBy("order"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("asset_rank", "order"))
    slots = held.select("page_id", slot.alias("k"), F.col("order").alias("new_order"))
    moved = held.withColumn("k", rank).join(slots, ["page_id", "k"]).drop("k")
    return rows.where("asset_rank is null").withColumn("new_order", F.col("order")).unionByName(moved)


def reviewed(objects: DataFrame, decided: DataFrame) -> DataFrame:
    """Objects with what their latest decision (object_id, disposition, kind_override, ids_override, caption_override) changes."""
    out = objects.join(decided, "object_id", "left")
    pick = lambda new, old: F.coalesce(F.col(new), F.col(old))
    return out.select("object_id", pick("kind_override", "object_kind").alias("object_kind"), "page_id", F.array_distinct(pick("ids_override", "evidence_ids")).alias("evidence_ids"), F.array_distinct("asset_occurrence_ids").alias("asset_occurrence_ids"), pick("caption_override", "text").alias("text"), "box", F.coalesce("disposition", F.lit("unreviewed")).alias("review_status"))


def assets_kept(assets: DataFrame, decided: DataFrame, objects: DataFrame) -> DataFrame:
    """Assets (occurrence_id) that are used themselves or by an object that is used (asset_occurrence_ids, review_status)."""
    own = decided.where("disposition = 'used'").select("occurrence_id")
    of_objects = objects.where("review_status = 'used'").select(F.explode("asset_occurrence_ids").alias("occurrence_id"))
    return assets.join(own.union(of_objects).distinct(), "occurrence_id", "left_semi")


def by_block(objects: DataFrame, spans: DataFrame) -> DataFrame:
    """(object_id, paragraph_id) of objects (evidence_ids) that share an observation with a paragraph's spans (paragraph_id, evidence_id)."""
    return objects.select("object_id", F.explode("evidence_ids").alias("evidence_id")).join(spans.select("paragraph_id", "evidence_id"), "evidence_id").select("object_id", "paragraph_id").distinct()
