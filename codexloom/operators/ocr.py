"""Rows of text recognition: lines from words, merged variants, quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text

_LINE = ["page_num", "block_num", "par_num", "line_num"]


def lines_from_words(words: DataFrame) -> DataFrame:
    """Lines of words (level, page_num, block_num, par_num, line_num, word_num, left, top, width, height, conf, text, ordinal).

    Words below level 5, without area or text are dropped. Confidence is the mean weighted by length over words that have one,
    in 0 to 1; ``first_ordinal`` gives the lines' order.
    """
    t = text.strip(F.col("text"))
    rows = words.where((F.col("level") == 5) & (F.col("width") > 0) & (F.col("height") > 0) & (F.length(t) > 0)).withColumn("text", t)
    weight, sure = F.length("text"), F.col("conf") >= 0
    total = F.sum(F.when(sure, weight))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_num", "ordinal", "text"))), lambda x: x["text"]), " ")
    box = F.array(F.min("left"), F.min("top"), F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height")))
    return rows.groupBy(*_LINE).agg(joined.alias("text"), box.alias("box"), F.try_divide(F.sum(F.when(sure, F.col("conf") * weight)), total * 100.0).alias("confidence"), F.count("*").alias("word_count"), F.min("ordinal").alias("first_ordinal"))


def weighted_confidence(confidence: Column, weight: Column) -> Column:
    """Mean confidence weighted, over rows that have one: an aggregate."""
    return F.try_divide(F.sum(F.when(confidence >= 0, confidence * weight)), F.sum(F.when(confidence >= 0, weight)))


def page_quality(blocks: DataFrame) -> DataFrame:
    """page_id, letters and digits, and mean confidence weighted by them."""
    n = text.alnum_count(F.col("text"))
    return blocks.groupBy("page_id").agg(F.sum(n).alias("alnum"), weighted_confidence(F.col("confidence"), n).alias("confidence"))


def page_route(pages: DataFrame, force: bool = False) -> DataFrame:
    """Pages (page_id, alnum, lost_ratio, image_coverage, left_blocks, right_blocks) with needs_ocr, mixed_visual and multi_column."""
    least = F.when(F.col("image_coverage") >= 0.5, 8).otherwise(20)
    usable = (F.col("alnum") >= least) & (F.col("lost_ratio") < 0.01)
    return pages.withColumns({"needs_ocr": F.lit(force) | ~usable, "mixed_visual": F.col("image_coverage") >= 0.12, "multi_column": (F.col("left_blocks") >= 2) & (F.col("right_blocks") >= 2)})


def page_state(has_text: Column, blank: Column, coverage: Column) -> Column:
    return F.when(has_text, "extracted").when(blank, "blank_candidate").when(coverage > 0, "visual_only").otherwise("unresolved")


def _merged(page: pd.DataFrame) -> pd.DataFrame:
    """Primary blocks, and each supplemental one that repeats no text and lies on no block kept before it."""
    kept, seen, boxes = [], set(), []
    for row in page.sort_values(["supplemental", "ordinal"]).itertuples(index=False):
        key, box = " ".join(row.text.split()).casefold(), list(row.box)
        if row.supplemental:
            size = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
            shared = lambda b: max(0.0, min(b[2], box[2]) - max(b[0], box[0])) * max(0.0, min(b[3], box[3]) - max(b[1], box[1]))
            if key in seen or any(shared(b) / max(1.0, min(size(b), size(box))) >= 0.75 for b in boxes):
                continue
        kept.append(row)
        seen.add(key)
        boxes.append(box)
    kept.sort(key=lambda r: (r.box[1], r.box[0]))
    out = pd.DataFrame(kept, columns=page.columns)
    out["reading_order"] = range(1, len(out) + 1)
    return out[["page_id", "ordinal", "text", "box", "supplemental", "reading_order"]]


def merge_supplemental(blocks: DataFrame) -> DataFrame:
    """Blocks (page_id, ordinal, text, box, supplemental) of each page after the merge, in reading order. A page is a small group."""
    return blocks.groupBy("page_id").applyInPandas(_merged, "page_id long, ordinal long, text string, box array<double>, supplemental boolean, reading_order int")


def _clustered(region: pd.DataFrame) -> pd.DataFrame:
    lines: list[list[float]] = []  # mean of middles, words
    region = region.sort_values(["top", "left"]).copy()
    at = []
    for row in region.itertuples(index=False):
        middle = (row.top + row.bottom) / 2
        near = [i for i in range(max(0, len(lines) - 3), len(lines)) if abs(lines[i][0] - middle) <= 2.75]
        if near:
            i = min(near, key=lambda k: abs(lines[k][0] - middle))
            lines[i] = [(lines[i][0] * lines[i][1] + middle) / (lines[i][1] + 1), lines[i][1] + 1]
        else:
            i = len(lines)
            lines.append([middle, 1])
        at.append(i + 1)
    region["line"] = at
    return region[["page_id", "region", "word_id", "line"]]


def baseline_lines(words: DataFrame) -> DataFrame:
    """The line of each word (page_id, region, word_id, top, bottom, left): words whose middles are near share one. A region of a page is
    a small group."""
    return words.groupBy("page_id", "region").applyInPandas(_clustered, "page_id long, region string, word_id long, line int")


def index_columns(words: DataFrame) -> DataFrame:
    """Text of each page's header, left column, right column and footer (page_id, region, ordinal, text)."""
    by = words.groupBy("page_id", "region").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"))
    rank = F.when(F.col("region") == "header", 0).when(F.col("region") == "left", 1).when(F.col("region") == "right", 2).otherwise(3)
    return by.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "text"))), lambda x: x["text"]), "\n").alias("text"))


def producers_match(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages whose rows don't agree with what a producer declares (page_id, row_count, source_image_sha256)."""
    by = rows.groupBy("page_id").agg(F.count("*").alias("n"), F.min("source_image_sha256").alias("lo"), F.max("source_image_sha256").alias("hi"))
    both = manifest.join(by, "page_id", "full_outer")
    ok = (F.col("row_count") == F.coalesce("n", F.lit(0))) & (F.col("n").isNull() | ((F.col("lo") == F.col("source_image_sha256")) & (F.col("hi") == F.col("source_image_sha256"))))
    return both.where(~F.coalesce(ok, F.lit(False))).select("page_id", "row_count", F.coalesce("n", F.lit(0)).alias("n"))


def valid_boxes(blocks: DataFrame) -> DataFrame:
    """Blocks whose box lies on their page (box, width, height)."""
    return blocks.where(geometry.within(F.col("box"), F.col("width"), F.col("height")))
