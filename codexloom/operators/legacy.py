"""Older packages and their translation units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from . import integrity

UNIT = r"^\[(c\d+_u\d+)\] (.*)$"
IMAGE = r"^\[\[IMAGE ([A-Za-z0-9_.-]+)\]\]$"
MOCK_PREFIX = "译文："


def unit_id(chapter: Column, unit: Column) -> Column:
    return F.concat(F.lit("c"), ids.padded(chapter, 3), F.lit("_u"), ids.padded(unit, 4))


def units(lines: DataFrame) -> DataFrame:
    """Lines (chapter, line, text) of prepared chapters as units (unit_id, text) and images (image_id)."""
    t = F.col("text")
    return lines.select("chapter", "line", F.nullif(F.regexp_extract(t, UNIT, 1), F.lit("")).alias("unit_id"), F.when(text.matches(t, UNIT), F.regexp_extract(t, UNIT, 2)).alias("unit_text"), F.nullif(F.regexp_extract(t, IMAGE, 1), F.lit("")).alias("image_id"))


def mock_translation(prepared: DataFrame) -> DataFrame:
    """Units with a stand-in for their translation; images stay."""
    return prepared.withColumn("translated", F.when(F.col("unit_id").isNotNull(), F.concat(F.lit(MOCK_PREFIX), F.col("unit_text"))))


def translation_audit(expected: DataFrame, given: DataFrame) -> DataFrame:
    """chapter and status: FAIL_REVIEW where units are missing, extra, repeated or out of order (chapter, line, unit_id on both sides)."""
    ordered = lambda df, name: df.where("unit_id is not null").groupBy("chapter").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "unit_id"))), lambda x: x["unit_id"]).alias(name))
    both = ordered(expected, "want").join(ordered(given, "got"), "chapter", "full_outer")
    return both.select("chapter", F.when(F.coalesce(F.col("want") == F.col("got"), F.lit(False)), "PASS").otherwise("FAIL_REVIEW").alias("status"))


def evidence_rows(old: DataFrame) -> DataFrame:
    """Blocks of an older package (block_id, page, spine_index, text, block_kind, source_type) as observations, and what they were."""
    page = F.concat(F.lit("legacy_"), ids.padded(F.coalesce("page", "spine_index", F.lit(1)), 5))
    own = ids.stable_id("ev", F.lit("legacy"), F.col("block_id"), F.col("text"))
    return old.select(own.alias("evidence_id"), page.alias("page_id"), F.col("block_id").alias("legacy_block_id"), "text", ids.sha256(F.col("text")).alias("text_sha256"), F.coalesce("block_kind", text.block_kind(F.col("text"))).alias("block_kind"), F.coalesce("source_type", F.lit("legacy")).alias("engine"))


def page_scan(rows: DataFrame, book: str) -> tuple[DataFrame, DataFrame]:
    """Pages (book_id, page, sha) of a book's old scan, each once, and pages of which copies differ."""
    own = rows.where(F.col("book_id") == book).groupBy("page").agg(F.count_distinct("sha").alias("kinds"), F.min("sha").alias("sha"))
    return own.where("kinds = 1").select("page", "sha"), own.where("kinds > 1").select("page", "kinds")


def page_gaps(pages: DataFrame, expected: int) -> DataFrame:
    """Pages from 1 to ``expected`` that aren't there, and pages beyond."""
    own = pages.select(F.col("page").cast("long").alias("page")).distinct()
    end = pages.sparkSession.range(1).select(F.lit(expected + 1).cast("long").alias("page"))
    gone = integrity.missing_indexes(own.where(F.col("page") <= expected).union(end), "page").select(F.col("missing").alias("page"), F.lit("missing").alias("finding"))
    return gone.unionByName(own.where(F.col("page") > expected).select("page", F.lit("extra").alias("finding")))


def files_by_root(paths: DataFrame, known: list[str]) -> DataFrame:
    """Files a root folder, and whether the migration knows it."""
    root = F.split("path", "/")[0]
    return paths.groupBy(root.alias("root")).agg(F.count("*").alias("n")).withColumn("known", F.col("root").isin(known))


def score(rows: DataFrame, least: int = 98) -> DataFrame:
    """run, total and status of scored criteria (run, score, blockers): PASS from ``least`` points on without blockers."""
    by = rows.groupBy("run").agg(F.sum("score").alias("total"), F.sum("blockers").alias("blockers"))
    return by.select("run", "total", F.when((F.col("total") >= least) & (F.col("blockers") == 0), "PASS").otherwise("FAIL").alias("status"))


# ---- fixed values: what an older package has to have ----
REQUIRED = ("package_manifest.json", "ledger/source_blocks.jsonl", "audit/source_integrity.json")
AUDITS = ("source_integrity", "ocr_audit", "toc_validation", "boundary_validation", "split_coverage", "cleaning_audit")
SEMANTIC = "audit/manual_semantic_coverage.json"
# ---- end of fixed values ----


def problems(packages: DataFrame, files: DataFrame, blocks: DataFrame, strict: bool = False) -> DataFrame:
    """package_id, kind and path of what older packages lack. ``files``: package_id, path, status (of audits); ``blocks``: package_id of each source block.

    Strictly, every audit has to be there and to have passed, and a reader's coverage as well.
    """
    want = lambda kind, paths: packages.select("package_id", F.explode(F.array(*map(F.lit, paths))).alias("path"), F.lit(kind).alias("kind"))
    own = files.select("package_id", "path", "status", F.lit(True).alias("there"))
    both = lambda kind, paths: want(kind, paths).join(own, ["package_id", "path"], "left")
    out = both("missing_required_artifact", REQUIRED).where("there is null").select("package_id", "kind", "path")
    empty = packages.join(blocks.select("package_id").distinct(), "package_id", "left_anti").select("package_id", F.lit("source_coverage_gap").alias("kind"), F.lit("ledger/source_blocks.jsonl").alias("path"))
    out = out.unionByName(empty)
    if strict:
        audits = both("missing_required_audit", [f"audit/{a}.json" for a in AUDITS])
        failed = audits.where("there and not coalesce(status in ('PASS', 'PASS_STRICT'), false)").withColumn("kind", F.lit("upstream_audit_not_pass"))
        read = both("semantic_review_missing", (SEMANTIC,)).where("there is null or not coalesce(status = 'PASS', false)")
        for part in (audits.where("there is null"), failed, read):
            out = out.unionByName(part.select("package_id", "kind", "path"))
    return out


def validated(packages: DataFrame, found: DataFrame) -> DataFrame:
    """package_id and status of older packages, given their problems."""
    return packages.select("package_id").join(found.select("package_id").distinct().withColumn("bad", F.lit(True)), "package_id", "left").select("package_id", F.when(F.col("bad"), "FAIL_REVIEW").otherwise("PASS").alias("status"))
