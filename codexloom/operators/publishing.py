"""Chunks for publication, and the checks that they have to pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids


def selected(paragraphs: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Paragraphs whose latest decision is to use them."""
    return paragraphs.join(decided.where("disposition = 'used'").select(key).distinct(), key, "left_semi")


def chunks(paragraphs: DataFrame, run_id: str, revision: str) -> DataFrame:
    """A published unit a paragraph: its identity follows from paragraph and text."""
    sha = ids.sha256(F.col("text"))
    return paragraphs.select("doc_id", "paragraph_id", "order", ids.chunk_id(F.col("paragraph_id"), sha).alias("chunk_id"), "text", sha.alias("text_sha256"), F.lit(run_id).alias("run_id"), F.lit(revision).alias("canonical_revision"))


def invalidation_key(parts: list[Column]) -> Column:
    """A digest that changes with anything a publication depends on."""
    return ids.sha256(F.concat_ws("|", *parts))


def chunk_findings(rows: DataFrame) -> DataFrame:
    """chunk_id and finding of chunks that break an invariant: an empty or repeated id, no text, or a digest that isn't the text's."""
    own = rows.groupBy("chunk_id").agg(F.count("*").alias("copies"))
    finding = F.when(F.col("chunk_id").isNull(), "id_missing").when(F.coalesce("text", F.lit("")) == "", "text_missing").when(~ids.sha256(F.col("text")).eqNullSafe(F.col("text_sha256")), "digest_mismatch").when(F.col("copies") > 1, "id_repeated")
    return rows.join(own, "chunk_id", "left").select("chunk_id", finding.alias("finding")).where("finding is not null")


def reference_findings(items: DataFrame, uses: DataFrame, item: str) -> DataFrame:
    """Items not used exactly once, and uses of unknown items."""
    a = items.select(item).distinct().withColumn("known", F.lit(True))
    b = uses.groupBy(item).agg(F.count("*").alias("uses"))
    both = a.join(b, item, "full_outer")
    finding = F.when(F.col("known").isNull(), "unknown").when(F.col("uses").isNull(), "unused").when(F.col("uses") > 1, "repeated")
    return both.select(item, F.coalesce("uses", F.lit(0)).alias("uses"), finding.alias("finding")).where("finding is not null")


def table_findings(objects: DataFrame, rows: DataFrame) -> DataFrame:
    """Table objects (object_id, markdown) without exactly one chunk (object_id, text) of the same text."""
    by = rows.groupBy("object_id").agg(F.count("*").alias("n"), F.min("text").alias("text"))
    both = objects.join(by, "object_id", "left")
    return both.where(~F.coalesce((F.col("n") == 1) & (F.col("text") == F.col("markdown")), F.lit(False))).select("object_id", F.coalesce("n", F.lit(0)).alias("n"))


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """doc_id and the Markdown of each document: front matter, title, and its texts in order."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n\n")
    head = F.concat(F.lit("---\nsource: "), F.col("doc_id").cast("string"), F.lit(f"\n---\n\n# {title}\n\n"))
    return rows.groupBy("doc_id").agg(body.alias("body")).select("doc_id", F.concat(head, F.col("body"), F.lit("\n")).alias("markdown"))


def verdicts(checks: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """target, failed and status of each target over one report (check_id, passed, blocks). A hint and a review tolerate all but the
    blocking checks."""
    each = checks.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    failed = F.count_if(~F.col("passed") & (F.col("blocks") | (F.col("target") == "citation")))
    good = F.when(F.col("target") == "hint", "HINT_READY").when(F.col("target") == "review", "REVIEW_READY").otherwise("PASS_STRICT")
    return each.groupBy("target").agg(failed.alias("failed")).select("target", "failed", F.when(F.col("failed") == 0, good).otherwise("FAIL_REVIEW").alias("status"))


def verdict(checks: DataFrame, target: str) -> DataFrame:
    """One row: a target's verdict."""
    return verdicts(checks, (target,))
