"""The rule engine: checks as queries, united into one report, with a verdict a target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, ordering
from .common import table

#: A check's name, the rows that fail it and the value reported of each; whether it blocks the lower targets too.
Check = tuple[str, Callable[[dict[str, DataFrame]], DataFrame], str, bool]

CHECKS: list[Check] = [
    ("surface_accounting", lambda t: t["documents"].agg(F.count("*").alias("n")).where("n < 1"), "n", True),
    ("source_identity", lambda t: t["documents"].where("not coalesce(sha2(text, 256) rlike '^[0-9a-f]{64}$', false)"), "doc_id", True),
    ("evidence_surface_foreign_keys", lambda t: integrity.orphans(t["labels"], "doc_id", t["documents"], "doc_id"), "doc_id", True),
    ("order_foreign_keys", lambda t: integrity.orphans(t["orders"], "o_custkey", t["customer"].where("c_custkey % 11 <> 0"), "c_custkey"), "o_orderkey", True),
    ("turn_accounting", lambda t: integrity.contiguous(t["conversations"], "conv_id", "turn").where("not contiguous"), "conv_id", True),
    ("canonical_evidence", lambda t: t["documents"].where("text is null or text = ''"), "doc_id", True),
    ("no_duplicate_identity", lambda t: t["documents"].groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "doc_id", True),
    ("length_binding", lambda t: t["documents"].where("n_chars <> length(text)"), "doc_id", False),
    ("manual_page_review", lambda t: integrity.orphans(t["documents"], "doc_id", t["labels"], "doc_id"), "doc_id", False),
    ("paragraph_semantic_coverage", lambda t: t["labels"].where("quality is null or toxic is null"), "doc_id", False),
    ("toxicity_reviewed", lambda t: t["labels"].where("toxic = 1 and quality = 1"), "doc_id", False),
]
BLOCKS = {name: blocks for name, _, _, blocks in CHECKS}

_FAILING_SQL = {
    "surface_accounting": "SELECT count(*) AS v FROM documents HAVING count(*) < 1",
    "source_identity": "SELECT doc_id AS v FROM documents WHERE NOT coalesce(regexp_matches(sha256(text), '^[0-9a-f]{64}$'), false)",
    "evidence_surface_foreign_keys": "SELECT doc_id AS v FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "order_foreign_keys": "SELECT o_orderkey AS v FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0)",
    "turn_accounting": "SELECT conv_id AS v FROM conversations GROUP BY conv_id HAVING NOT (count(*) = count(DISTINCT turn) AND min(turn) = 0 AND max(turn) = count(*) - 1)",
    "canonical_evidence": "SELECT doc_id AS v FROM documents WHERE text IS NULL OR text = ''",
    "no_duplicate_identity": "SELECT doc_id AS v FROM documents GROUP BY doc_id HAVING count(*) > 1",
    "length_binding": "SELECT doc_id AS v FROM documents WHERE n_chars <> length(text)",
    "manual_page_review": "SELECT doc_id AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "paragraph_semantic_coverage": "SELECT doc_id AS v FROM labels WHERE quality IS NULL OR toxic IS NULL",
    "toxicity_reviewed": "SELECT doc_id AS v FROM labels WHERE toxic = 1 AND quality = 1",
}
REPORT_SQL = " UNION ALL ".join(f"SELECT '{name}' AS check_id, count(*) = 0 AS passed, count(*) AS n_observed, min(v::VARCHAR) AS first_observed FROM ({sql})" for name, sql in _FAILING_SQL.items())


def evaluate(tables: dict[str, DataFrame], checks: list[Check] = CHECKS) -> DataFrame:
    """check_id, passed, n_observed, first_observed and blocks of each check: one report for all targets."""
    rows = ordering.report({name: failing(tables).select(F.col(value).alias("v")) for name, failing, value, _ in checks}, 1)
    blocking = [name for name, _, _, blocks in checks if blocks]
    return rows.select("check_id", "passed", "n_observed", F.try_element_at("observed", F.lit(1)).alias("first_observed"), F.col("check_id").isin(blocking).alias("blocks"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate({n: table(spark, sf_dir, n) for n in ("documents", "labels", "orders", "customer", "conversations")})
