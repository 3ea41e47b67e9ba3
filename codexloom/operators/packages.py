"""Batches of documents, migration of older packages, lifecycle and assembled accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text

#: Surfaces from which on a document of no other kind is a book.
BOOK_SURFACES = 30


def package_name(path: Column) -> Column:
    """A folder name for a source: the slug of its stem, and a digest that keeps equal slugs apart."""
    stem = F.regexp_replace(text.basename(path), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws("_", F.substring(text.slug(stem), 1, 64), ids.short_sha(path, 12))


def batch_summary(results: DataFrame) -> DataFrame:
    """selected, completed, failed and cancelled, and whether the batch as a whole completed."""
    n = lambda s: F.count_if(F.col("status") == s)
    done = F.when(F.count("*") == n("complete"), "complete").when(n("complete") == 0, "failed").otherwise("partial")
    return results.agg(F.count("*").alias("selected"), n("complete").alias("completed"), n("failed").alias("failed"), n("cancelled").alias("cancelled"), done.alias("status"))


def guarded(rows: DataFrame, ok: Column, reason: Column) -> DataFrame:
    """``rows`` with status and error, so that one bad document fails alone."""
    return rows.withColumns({"status": F.when(ok, "complete").otherwise("failed"), "error": F.when(~ok, reason)})


def document_kind(given: Column, source_format: Column, surfaces: Column) -> Column:
    """The stated kind, else that of the format, else a book from 30 pages on."""
    by_format = F.when(source_format.isin("epub", "mobi"), "book").when(source_format.isin("html",), "web_page").when(source_format.isin("docx", "text", "markdown"), "document").when(source_format.isin("image", "image_directory"), "scan")
    return F.coalesce(F.nullif(given, F.lit("auto")), by_format, F.when(surfaces >= BOOK_SURFACES, "book").otherwise("paper"))


def unique_or_null(value: str) -> Column:
    """The only value of a group, or null: an aggregate."""
    return F.when(F.count_distinct(value) == 1, F.max(value))


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """One row: a map from each value to its count."""
    by = rows.groupBy(F.coalesce(F.col(key), F.lit("none")).alias("k")).agg(F.count("*").alias("n"))
    return by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("counts"))


def first_per_chunk(rows: DataFrame, chunk: str, order: str) -> DataFrame:
    """The first record of each chunk, the place where an older scan named its section."""
    return rows.groupBy(chunk).agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def redact_path(value: Column, key: Column, privacy: Column) -> Column:
    """Only the last part of paths and locators that leave the machine."""
    named = text.matches(F.lower(key), "path|locator|uri|sidecar")
    return F.when((privacy != "local_only") & named, text.basename(value)).otherwise(value)


def crosswalk(old: DataFrame, old_id: str, new: DataFrame, new_id: str, on: str, kind: str) -> DataFrame:
    """kind, old and new id of each older row, new null where nothing matches."""
    return old.join(new.select(on, F.col(new_id).alias("new_id")), on, "left").select(F.lit(kind).alias("kind"), F.col(old_id).alias("old_id"), "new_id")


def not_revoked(packages: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Packages without a tombstone."""
    return packages.join(tombstones.select("package_id").distinct(), "package_id", "left_anti")


def revoke(tombstones: DataFrame, package_id: str, reason: str, at: str) -> DataFrame:
    """Tombstones with one more; a second revocation of a package changes nothing."""
    one = tombstones.sparkSession.range(1).select(F.lit(package_id).alias("package_id"), ids.stable_id("revoke", F.lit(package_id), F.lit(reason), digits=20).alias("revocation_id"), F.lit(reason).alias("reason"), F.lit(at).alias("revoked_at"))
    return tombstones.unionByName(one.join(tombstones.select("package_id"), "package_id", "left_anti").select(tombstones.columns))


def run_id(source_sha: Column, policy_fingerprint: Column) -> Column:
    return F.concat(F.lit("r_"), F.substring(source_sha, 1, 12), F.lit("_"), F.substring(policy_fingerprint, 1, 12))


def rag_sections(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required audits (audit) with the status found (audit, status), missing ones named so."""
    return required.join(present, "audit", "left").select("audit", F.coalesce("status", F.lit("MISSING")).alias("status"), F.coalesce(F.col("status") == "PASS", F.lit(False)).alias("passed"))
