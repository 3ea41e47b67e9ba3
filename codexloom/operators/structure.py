"""Headings, tables of contents, chapters and the order in which they are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from . import ordering


def heading_emission(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """The headings that a walk over ``rows`` emits: every prefix of a path where it is first met.

    Returns heading, level (2 for the outermost, 3 at most), path and the order fields of the row that emits it. An aggregate a
    prefix: its first row in order.
    """
    prefixes = rows.select(*order, F.col(path).alias("full"), F.explode(F.sequence(F.lit(1), F.size(path))).alias("depth")).withColumn("prefix", F.slice("full", F.lit(1), F.col("depth")))
    first = prefixes.groupBy("prefix").agg(F.min(F.struct(*order)).alias("at"))
    depth = F.size("prefix")
    return first.select(text.display_heading(F.element_at("prefix", -1)).alias("heading"), F.least(F.lit(3), depth + 1).alias("level"), F.array_join("prefix", "/").alias("path"), "at.*")


def published_items(items: DataFrame, selected: DataFrame, path: str = "structure_path") -> DataFrame:
    """Items whose path is a prefix of some selected path."""
    prefixes = selected.where(F.size(path) > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.array_join(F.slice(path, F.lit(1), n), "\x1f"))).alias("prefix_")).distinct()
    return items.join(prefixes, F.array_join(F.col(path), "\x1f") == F.col("prefix_"), "left_semi")


def parents_by_depth(rows: DataFrame, group: str, order: str, depth: str, own: str) -> DataFrame:
    """``rows`` with parent: the last earlier row of the group one level up that no shallower row has cut off since. Depths are those
    that occur, however deep."""
    depths = sorted(r[0] for r in rows.select(depth).where(F.col(depth).isNotNull()).distinct().collect())
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(depth) == k, F.struct(F.col(order).alias("at"), F.col(depth).alias("depth"), F.col(own).alias("own")))).over(before) for k in depths]
    if not last:
        return rows.withColumn("parent", F.lit(None).cast(rows.schema[own].dataType))
    nearest = F.array_max(F.filter(F.array(*last), lambda x: x["depth"] < F.col(depth)))
    return rows.withColumn("parent", F.when(nearest["depth"] == F.col(depth) - 1, nearest["own"]))


def toc_proposal(candidates: DataFrame) -> DataFrame:
    """Items of a table of contents from candidates (place, title, score): one a title without case, in order, with section type.

    A mechanical score is capped: it never counts as reviewed.
    """
    tidy = candidates.select("place", text.collapse(F.col("title")).alias("title"), "score").where("title <> ''")
    first = tidy.groupBy(F.lower("title").alias("key")).agg(F.min(F.struct("place", "title", "score")).alias("row")).select("row.*")
    placed = ordering.with_next(ordering.numbered(first, ["place"], "item"), "item", "title", "expected_end_before")
    return placed.select(
        F.concat(F.lit("toc_"), ids.padded(F.col("item"), 3)).alias("toc_id"), F.col("item").alias("order"), "title", text.strip_number(F.col("title")).alias("normalized_title"), text.section_type(F.col("title")).alias("section_type"),
        "expected_end_before", F.least("score", F.lit(0.95)).alias("confidence"),
    )


def boundary_scores(cues: DataFrame, blocks: DataFrame, most: int = 5) -> DataFrame:
    """Where chapters may begin: cues (doc_id, toc_id, cue) against blocks (doc_id, ordinal, text, block_kind) of the same document.

    0.90 for an equal text, 0.70 if either holds the other, 0.03 more for a heading and for three following blocks with 120
    characters. The best five a cue, ties by place.
    """
    ahead = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(1, 3)
    low = F.lower(F.trim("text"))
    rows = blocks.select("doc_id", "ordinal", low.alias("low"), "block_kind", F.coalesce(F.sum(F.length(F.trim("text"))).over(ahead), F.lit(0)).alias("following"))
    own = cues.select("doc_id", "toc_id", F.lower("cue").alias("cue")).where("cue <> ''")
    both = rows.join(own, "doc_id")
    base = F.when(F.col("low") == F.col("cue"), 0.90).when(F.contains("low", "cue") | F.contains("cue", "low"), 0.70)
    score = base + F.when(F.col("block_kind") == "heading_candidate", 0.03).otherwise(0.0) + F.when(F.col("following") >= 120, 0.03).otherwise(0.0)
    found = both.withColumn("score", F.round(score, 2)).where("score is not null").groupBy("doc_id", "toc_id", "ordinal").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "toc_id").orderBy(F.desc("score"), "ordinal"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def chapter_ranges(items: DataFrame, group: str, order: str, start: str, size: str) -> DataFrame:
    """[start, end) of each item: an unplaced first item starts at 0, another at the end; an end is the next item's place or the
    group's size, never before the start; confidence is capped where it was."""
    w = Window.partitionBy(group).orderBy(order)
    begin = F.coalesce(F.col(start), F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col(size)))
    end = F.when(F.lead(F.lit(1)).over(w).isNull(), F.col(size)).otherwise(F.coalesce(F.lead(start).over(w), F.col(size)))
    out = items.withColumns({"start_index": begin, "end_raw": end})
    return out.withColumns({"end_index": F.greatest("start_index", "end_raw"), "capped": F.col("end_raw") < F.col("start_index")}).drop("end_raw")


def context(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``rows`` with the two values before and after each, joined, and the characters of the next three."""
    w = Window.partitionBy(group).orderBy(order)
    joined = lambda a, b: F.array_join(F.collect_list(value).over(w.rowsBetween(a, b)), " ¶ ")
    return rows.withColumns({"before": joined(-2, -1), "after": joined(1, 2), "next_chars": F.coalesce(F.sum(F.length(value)).over(w.rowsBetween(1, 3)), F.lit(0))})


def linewrap_candidates(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Neighbouring units that a line break may have cut: the first doesn't end a sentence, the second starts in lower case."""
    left = F.lag("text").over(Window.partitionBy(group).orderBy(order))
    both = rows.withColumn("left_text", left)
    cut = (F.length("left_text") > 0) & ~text.matches(F.col("left_text"), "[.?!。！？:：]$") & text.matches(F.col("text"), r"^\p{Ll}")
    return both.where(F.coalesce(cut, F.lit(False))).withColumn("proposed_text", F.concat_ws(" ", "left_text", "text"))


def numbered_findings(items: DataFrame) -> DataFrame:
    """Numbered headings (toc_id, parent_id, title, level) whose parent doesn't bear the number above theirs, one level up."""
    parent = items.select(F.col("toc_id").alias("parent_id"), F.col("title").alias("parent_title"), F.col("level").alias("parent_level"))
    both = items.join(parent, "parent_id", "left").withColumn("expects", text.parent_number(F.col("title"))).where("expects is not null")
    fits = F.startswith(F.col("parent_title"), F.col("expects")) & (F.col("level") == F.col("parent_level") + 1)
    return both.where(~F.coalesce(fits, F.lit(False))).select("toc_id", "title", "expects")


def is_before(a: Column, b: Column) -> Column:
    """Whether one path of child indexes comes before another in document order."""
    return a < b


def path_at(paths: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (page_id, dom_path, id) the last path (page_id, dom_path, path) at or before it: one sort a page."""
    union = paths.select("page_id", "dom_path", F.lit(0).alias("kind"), "path", F.lit(None).cast("string").alias("id")).unionByName(points.select("page_id", "dom_path", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("path"), F.col("id").cast("string").alias("id")))
    w = Window.partitionBy("page_id").orderBy("dom_path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return union.withColumn("path", F.last("path", ignorenulls=True).over(w)).where("kind = 1").select("page_id", "id", "path")


def under(outer: Column, inner: Column) -> Column:
    """Whether a path of child indexes begins with another."""
    return F.slice(inner, F.lit(1), F.size(outer)) == outer
