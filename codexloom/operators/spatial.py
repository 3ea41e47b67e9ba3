"""Joins of boxes on pages. Every join has an equality on the page and a cell of a grid, never a bare comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from .graph import components


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(F.greatest(low, high) / size))


def overlapping(boxes: DataFrame, cell: float = 100.0) -> DataFrame:
    """Pairs a < b of ids of one page whose boxes (page_id, id, box) overlap."""
    x = boxes.select("page_id", "id", "box", F.explode(_cells(F.col("box")[0], F.col("box")[2], cell)).alias("cx")).withColumn("cy", F.explode(_cells(F.col("box")[1], F.col("box")[3], cell)))
    y = x.select("page_id", "cx", "cy", F.col("id").alias("b"), F.col("box").alias("other"))
    pairs = x.join(y, ["page_id", "cx", "cy"]).where((F.col("id") < F.col("b")) & geometry.overlaps(F.col("box"), F.col("other")))
    return pairs.select("page_id", F.col("id").alias("a"), "b").distinct()


def overlap_groups(boxes: DataFrame, cell: float = 100.0) -> DataFrame:
    """id and component: the smallest id of the boxes that hang together by overlaps; boxes' ids are unique."""
    linked = components(overlapping(boxes, cell).select("a", "b"))
    return boxes.select("page_id", "id").join(linked, "id", "left").select("page_id", "id", F.coalesce("component", "id").alias("component"))


def intersecting(left: DataFrame, right: DataFrame, cell: float = 100.0) -> DataFrame:
    """(left_id, right_id) of overlapping boxes of one page, such as links and the text under them."""
    spread = lambda df, name: df.select("page_id", F.col("id").alias(f"{name}_id"), F.col("box").alias(f"{name}_box"), F.explode(_cells(F.col("box")[0], F.col("box")[2], cell)).alias("cx")).withColumn("cy", F.explode(_cells(F.col(f"{name}_box")[1], F.col(f"{name}_box")[3], cell)))
    both = spread(left, "left").join(spread(right, "right"), ["page_id", "cx", "cy"])
    return both.where(geometry.overlaps(F.col("left_box"), F.col("right_box"))).select("page_id", "left_id", "right_id").distinct()


def nearest_following(images: DataFrame, captions: DataFrame, most: float = 180.0, slack: float = 12.0) -> DataFrame:
    """For each image (page_id, id, bottom) the nearest caption (page_id, id, top) below: top at least bottom - slack, at most
    ``most`` apart; ties by id. Bands as high as the reach make it an equi-join."""
    reach = most + slack
    low = images.select("page_id", F.col("id").alias("image_id"), "bottom", F.explode(F.sequence(F.floor((F.col("bottom") - slack) / reach), F.floor((F.col("bottom") + most) / reach))).alias("band"))
    cap = captions.select("page_id", F.col("id").alias("caption_id"), "top", F.floor(F.col("top") / reach).alias("band"))
    gap = F.abs(F.col("top") - F.col("bottom"))
    both = low.join(cap, ["page_id", "band"]).where((F.col("top") >= F.col("bottom") - slack) & (gap <= most))
    return both.groupBy("page_id", "image_id").agg(F.min(F.struct(gap.alias("distance"), F.col("caption_id"))).alias("best")).select("page_id", "image_id", F.col("best.caption_id").alias("caption_id"), F.col("best.distance").alias("distance"))


def nearest(boxes: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """For each box (page_id, id, box) the nearest target box of its page within ``most``; ties by id."""
    around = boxes.select("page_id", F.col("id").alias("box_id"), "box", F.explode(_cells(F.col("box")[0] - most, F.col("box")[2] + most, most)).alias("cx")).withColumn("cy", F.explode(_cells(F.col("box")[1] - most, F.col("box")[3] + most, most)))
    to = targets.select("page_id", F.col("id").alias("target_id"), F.col("box").alias("target"), F.explode(_cells(F.col("box")[0], F.col("box")[2], most)).alias("cx")).withColumn("cy", F.explode(_cells(F.col("target")[1], F.col("target")[3], most)))
    both = around.join(to, ["page_id", "cx", "cy"]).withColumn("distance", geometry.distance(F.col("box"), F.col("target"))).where(F.col("distance") <= most)
    return both.groupBy("page_id", "box_id").agg(F.min(F.struct("distance", "target_id")).alias("best")).select("page_id", "box_id", "best.target_id", "best.distance")


# ---- fixed values: what makes drawings a figure, and how it is cut out ----
LEAST_DRAWINGS, LEAST_AREA, LEAST_SHARE, TOUCH = 3, 400.0, 0.001, 0.5
LABEL_REACH, LABEL_CHARS, LABEL_WORDS, MARGIN = 14.0, 80, 12, 3.0
# ---- end of fixed values ----


def vector_figures(clusters: DataFrame, captions: DataFrame, drawings: DataFrame, texts: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, caption_id and clip of the figures that drawings make: where to cut the page.

    ``clusters``: page_id, caption_id, box. ``captions``: page_id, id, box. ``drawings``: page_id, box. ``texts``: page_id, text, box, other than captions.
    ``pages``: page_id, width, height. The clusters of a caption are one figure if enough drawings touch their union and it is large enough; short
    texts near it are its labels and belong to the clip; the caption, on whichever side, doesn't.
    """
    corner = lambda name, k: F.col(name)[k]
    union = clusters.groupBy("page_id", "caption_id").agg(F.array(*(F.min(corner("box", k)) for k in (0, 1)), *(F.max(corner("box", k)) for k in (2, 3))).alias("u"))
    touched = union.join(drawings.select("page_id", F.col("box").alias("d")), "page_id").where(geometry.distance(F.col("u"), F.col("d")) <= TOUCH).groupBy("page_id", "caption_id").agg(F.count("*").alias("n"))
    area = (corner("u", 2) - corner("u", 0)) * (corner("u", 3) - corner("u", 1))
    whole = F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    figures = union.join(touched.where(F.col("n") >= LEAST_DRAWINGS), ["page_id", "caption_id"]).join(pages, "page_id").where(area >= F.greatest(F.lit(LEAST_AREA), whole * LEAST_SHARE))
    grown = F.array(*(corner("u", k) - LABEL_REACH for k in (0, 1)), *(corner("u", k) + LABEL_REACH for k in (2, 3)))
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    short = texts.select("page_id", plain.alias("t"), F.col("box").alias("l")).where((F.length("t") > 0) & (F.length("t") <= LABEL_CHARS) & (F.size(F.split("t", " ")) <= LABEL_WORDS))
    near = figures.join(short, "page_id").where(geometry.overlaps(F.col("l"), grown))
    labels = near.groupBy("page_id", "caption_id").agg(F.array(*(F.min(corner("l", k)) for k in (0, 1)), *(F.max(corner("l", k)) for k in (2, 3))).alias("labels"))
    both = figures.join(labels, ["page_id", "caption_id"], "left").join(captions.select("page_id", F.col("id").alias("caption_id"), F.col("box").alias("c")), ["page_id", "caption_id"])
    low = [F.greatest(F.lit(0.0), F.least(corner("u", k), F.coalesce(corner("labels", k), corner("u", k))) - MARGIN) for k in (0, 1)]
    high = [F.least(F.col(side), F.greatest(corner("u", k), F.coalesce(corner("labels", k), corner("u", k))) + MARGIN) for k, side in ((2, "width"), (3, "height"))]
    left, right = corner("c", 2) <= corner("u", 0) + 2, corner("c", 0) >= corner("u", 2) - 2
    below, above = corner("c", 1) >= corner("u", 3) - 4, corner("c", 3) <= corner("u", 1) + 2
    x0 = F.when(left, F.greatest(low[0], corner("c", 2) + 1)).otherwise(low[0])
    x1 = F.when(~left & right, F.least(high[0], corner("c", 0) - 1)).otherwise(high[0])
    y1 = F.when(~left & ~right & below, F.least(high[1], corner("c", 1) - 1)).otherwise(high[1])
    y0 = F.when(~left & ~right & ~below & above, F.greatest(low[1], corner("c", 3) + 1)).otherwise(low[1])
    out = both.select("page_id", "caption_id", F.array(x0, y0, x1, y1).alias("clip"))
    return out.where((corner("clip", 2) - corner("clip", 0) > 5) & (corner("clip", 3) - corner("clip", 1) > 5))
