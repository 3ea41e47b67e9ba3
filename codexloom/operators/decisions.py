"""The append-only log of review decisions and what follows from it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids

KINDS = ("page", "paragraph", "asset", "object", "structure", "source_boundary", "canonical", "finding")
DISPOSITIONS = ("used", "excluded", "reference_only", "accepted", "rejected", "resolved", "deferred", "corrected")
REVISED = ("paragraph", "structure")


def of_head(log: DataFrame, source_sha: str, run_id: str, revision: str) -> DataFrame:
    """Decisions bound to the active head; those on paragraphs and structure also to its canonical revision."""
    return log.where((F.col("source_sha256") == source_sha) & (F.col("active_run_id") == run_id) & (~F.col("kind").isin(*REVISED) | (F.col("canonical_revision") == revision)))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in order of the log: an aggregate with map-side combine, not a sort of whole groups."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), F.struct(*order)).alias("row"))
    return last.select("row.*")


def active(log: DataFrame, keys: list[str], order: list[str], live: DataFrame, live_key: str) -> DataFrame:
    """The latest rows whose target still exists."""
    own = live.select(F.col(live_key).alias("live_")).distinct()
    now = latest(log, keys, order)
    return now.join(own, now[live_key] == own["live_"], "left_semi")


def link_hash(previous: Column, *parts: Column) -> Column:
    """The hash of a link; a null part is a mark of its own, so that rows with nulls in other places differ."""
    return ids.sha256(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in (previous, *parts))))


def verify_chain(log: DataFrame, group: str, order: list[str], own: str, declared_previous: str, declared: str, genesis: Column) -> DataFrame:
    """``log`` with linked (names the hash declared before it) and intact (its own hash is that of its content ``own``).

    The chain goes on from what a row declares even if that is wrong, so one broken row breaks its own checks and its follower's link.
    """
    before = F.lag(F.coalesce(F.col(declared), F.lit("")), 1).over(Window.partitionBy(group).orderBy(*order))
    linked = F.col(declared_previous).eqNullSafe(F.coalesce(before, genesis))
    intact = F.col(declared).eqNullSafe(link_hash(F.col(declared_previous), F.col(own)))
    return log.withColumns({"linked": linked, "intact": intact})


def extend_chain(head: str, contents: Iterable[str]) -> list[tuple[str, str]]:
    """(previous, own) hashes of an incoming batch appended after ``head``: one after the other, as a chain has to be."""
    out = []
    for content in contents:
        own = hashlib.sha256(f"{head}|{content}".encode()).hexdigest()
        out.append((head, own))
        head = own
    return out


def supersession(log: DataFrame, keys: list[str], order: list[str], own: str, supersedes: str) -> DataFrame:
    """``log`` with ``prior`` (the key's decision before) and valid: a later decision names the one it replaces."""
    prior = F.lag(F.col(own)).over(Window.partitionBy(*keys).orderBy(*order))
    return log.withColumn("prior", prior).withColumn("valid", F.col("prior").isNull() | F.coalesce(F.array_contains(F.col(supersedes), F.col("prior")), F.lit(False)))


def coverage(rows: DataFrame, key: str, decided: DataFrame, decided_key: str, disposition: Column) -> DataFrame:
    """``rows``' keys with the disposition of their decision, ``gap`` without one."""
    own = decided.select(F.col(decided_key).alias("decided_"), disposition.alias("disposition_"))
    return rows.select(key).join(own, F.col(key) == F.col("decided_"), "left").select(key, F.coalesce("disposition_", F.lit("gap")).alias("disposition"))


def accept(log: DataFrame, incoming: DataFrame, own: str, content: str) -> tuple[DataFrame, DataFrame]:
    """New rows and collisions of a batch: a known id with the same content is a replay and dropped, with other content a collision."""
    known = log.select(F.col(own).alias("known_"), F.col(content).alias("content_")).distinct()
    fresh = incoming.join(known, F.col(own) == F.col("known_"), "left_anti")
    clash = incoming.join(known, (F.col(own) == F.col("known_")) & ~F.col(content).eqNullSafe(F.col("content_")), "left_semi")
    return fresh, clash


def invalid(log: DataFrame) -> DataFrame:
    """Decisions whose kind or disposition isn't known, or whose target is missing."""
    return log.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) | ~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)) | F.col("target_id").isNull())


def mixes_edits(batch: DataFrame) -> DataFrame:
    """One row: whether a batch edits canonical blocks and decides paragraphs or structure at once."""
    edits, others = F.bool_or(F.col("kind") == "canonical"), F.bool_or(F.col("kind").isin(*REVISED))
    return batch.agg(F.coalesce(edits & others, F.lit(False)).alias("mixed"))
