"""Markdown from rows, and rows from Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def table_markdown(cells: DataFrame) -> DataFrame:
    """object_id and markdown of tables from cells: object_id, row, column (from 0), tag, text, container, ordinal, caption.

    Fragments of one container repeat its text, so neighbouring repeats count once; a cell without containers joins its fragments.
    The grid is dense. The first row is a header if it has a ``th``, else columns are numbered.
    """
    own = Window.partitionBy("object_id", "row", "column").orderBy("ordinal")
    rows = cells.where("row is not null and column is not null").withColumn("repeat", F.coalesce(F.col("container") == F.lag("container").over(own), F.lit(False)))
    ordered = lambda value, keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("ordinal", value.alias("v"))))), lambda x: x["v"])
    t, c = F.trim(F.col("text")), F.col("container")
    by = rows.groupBy("object_id", "row", "column").agg(ordered(t, F.length(t) > 0).alias("texts"), ordered(c, (F.length(c) > 0) & ~F.col("repeat")).alias("containers"), F.max_by("tag", "ordinal").alias("tag"), F.max("caption").alias("caption"))
    value = text.table_cell(F.array_join(F.when(F.size("containers") > 0, F.col("containers")).otherwise(F.col("texts")), " "))
    grid = by.groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "row", "column"), value.alias("v")))).alias("at"), F.max("row").alias("last_row"), F.max("column").alias("last_column"), F.bool_or((F.col("row") == 0) & (F.col("tag") == "th")).alias("headed"), F.max("caption").alias("caption"))
    columns = F.sequence(F.lit(0), F.col("last_column").cast("int"))
    line = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    body = F.transform(F.sequence(F.lit(0), F.col("last_row").cast("int")), lambda r: line(F.transform(columns, lambda k: F.coalesce(F.try_element_at("at", F.concat_ws(":", r, k)), F.lit("")))))
    numbered = line(F.transform(columns, lambda k: F.concat(F.lit("Column "), (k + 1).cast("string"))))
    rule = line(F.transform(columns, lambda k: F.lit("---")))
    lines = F.when(F.col("headed"), F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.size(body)))).otherwise(F.concat(F.array(numbered, rule), body))
    title = F.when(F.length("caption") > 0, F.array(F.concat(F.lit("**"), F.col("caption"), F.lit("**")), F.lit(""))).otherwise(F.array().cast("array<string>"))
    return grid.select("object_id", F.array_join(F.concat(title, lines), "\n").alias("markdown"))


def _marked(rows: DataFrame, group: str, number: str, value: str) -> DataFrame:
    """``rows`` with heading (null, or level and title): Markdown headings outside front matter and fences."""
    w = Window.partitionBy(group).orderBy(number)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rule = text.strip(F.col(value)) == "---"
    marked = rows.withColumn("opened", F.max((rule & (F.col(number) == 1)).cast("int")).over(upto))
    closed = F.coalesce(F.sum((rule & (F.col(number) > 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    marked = marked.withColumn("front", (F.col("opened") == 1) & ~closed)
    fence = text.matches(F.col(value), r"^\s*```") & ~F.col("front")
    marked = marked.withColumn("fence", fence).withColumn("inside", F.sum(F.col("fence").cast("int")).over(upto) % 2 == 1)
    pattern = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    found = ~F.col("front") & ~F.col("fence") & ~F.col("inside") & text.matches(F.col(value), pattern)
    heading = F.struct(F.length(F.regexp_extract(value, pattern, 1)).alias("level"), text.strip(F.regexp_extract(value, pattern, 2)).alias("title"))
    return marked.withColumn("heading", F.when(found, heading)).drop("opened", "front", "fence", "inside")


def markdown_headings(rows: DataFrame, group: str = "doc_id", number: str = "line", value: str = "text") -> DataFrame:
    """Headings of Markdown lines outside front matter and fences: group, line, level, title."""
    return _marked(rows, group, number, value).where("heading is not null").select(group, F.col(number).alias("line"), "heading.*")


def markdown_outline(rows: DataFrame, group: str = "doc_id", number: str = "line", value: str = "text") -> DataFrame:
    """The headings with empty_leaf: below the first level, nothing but blanks up to the next heading, and no heading under it.

    One pass: each line belongs to the heading in force, and an aggregate by heading says whether it has text.
    """
    upto = Window.partitionBy(group).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    own = _marked(rows, group, number, value).withColumn("section", F.count("heading").over(upto)).where("section > 0")
    filled = F.bool_or(F.col("heading").isNull() & (text.strip(F.col(value)) != ""))
    by = own.groupBy(group, "section").agg(F.min(number).alias("line"), F.min_by("heading", number).alias("heading"), F.coalesce(filled, F.lit(False)).alias("filled"))
    ahead = F.coalesce(F.lead("heading.level").over(Window.partitionBy(group).orderBy("section")), F.lit(0))
    leaf = (F.col("heading.level") > 1) & (ahead <= F.col("heading.level")) & ~F.col("filled")
    return by.select(group, "line", "heading.*", leaf.alias("empty_leaf"))


def empty_leaf_headings(rows: DataFrame, group: str = "doc_id", number: str = "line", value: str = "text") -> DataFrame:
    """Headings below the first level with nothing but blanks up to the next heading and no heading under them."""
    return markdown_outline(rows, group, number, value).where("empty_leaf").drop("empty_leaf")


def list_semantics(tags: Column) -> Column:
    """kind, depth and marker of a block whose tag and ancestors, nearest first, hold an item of a list; null elsewhere."""
    lists = F.filter(tags, lambda t: t.isin("ol", "ul"))
    ordered = F.try_element_at(lists, F.lit(1)) == "ol"
    found = F.array_contains(tags, "li") & (F.size(lists) > 0)
    return F.when(found, F.struct(F.when(ordered, "ordered").otherwise("unordered").alias("kind"), F.size(lists).alias("depth"), F.when(ordered, "1.").otherwise("-").alias("marker")))


def list_item(value: Column, semantics: Column) -> Column:
    """A block as a list item, indented by its depth; as plain text where it isn't one."""
    item = F.concat(F.repeat(F.lit("  "), semantics["depth"] - 1), semantics["marker"], F.lit(" "), text.strip_list_marker(value))
    return F.when(text.renders_as_list_item(value, semantics["kind"]), item).otherwise(value)


def collapse_members(rows: DataFrame, members: DataFrame, rendered: DataFrame) -> DataFrame:
    """``rows`` (block_id, order, text) with the members (object_id, block_id) of each object replaced by one row of its rendering
    (object_id, markdown), where the first of them stood."""
    own = rows.join(members, "block_id", "left")
    plain = own.where("object_id is null").select("block_id", "order", "text", F.lit(None).cast("string").alias("object_id"))
    first = own.where("object_id is not null").groupBy("object_id").agg(F.min("order").alias("order"), F.min_by("block_id", "order").alias("block_id"))
    made = first.join(rendered, "object_id").select("block_id", "order", F.col("markdown").alias("text"), "object_id")
    return plain.unionByName(made)


def anchor_class(n_spans: Column, has_dom: Column, has_box: Column) -> Column:
    """How a chunk can be found again in its source."""
    return F.when(n_spans == 0, "unanchored").when(has_dom, "dom").when(has_box, "page_box").otherwise("text_offset")


def reversibility(kind: Column, source_format: Column, n_spans: Column, same: Column) -> Column:
    """How a chunk's text follows from its spans."""
    return (
        F.when(kind == "table_candidate", "table_projection").when(kind == "code_candidate", "code_literal").when(same, "literal").when((source_format == "pdf") & (n_spans > 1), "pdf_join").when(source_format == "pdf", "pdf_correction").when((source_format == "epub") & (n_spans > 1), "epub_join")
    )
