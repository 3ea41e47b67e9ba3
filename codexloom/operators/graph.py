"""Graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b). Each round every id takes the least label among its
    neighbours', then its label's label; it ends when no label changes."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    label = cut_lineage(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        up = step.select(F.col("id").alias("next"), F.col("next").alias("above"))
        later = cut_lineage(step.join(up, "next", "left").select("id", F.col("component").alias("was"), F.coalesce("above", "next").alias("component")))
        if later.where("was <> component").isEmpty():
            return later.select("id", "component")
        label = later.select("id", "component")


def tree_findings(items: DataFrame) -> DataFrame:
    """Items (toc_id, parent_id, level) whose parent is missing, isn't above them, or lacks although they aren't roots."""
    parent = items.select(F.col("toc_id").alias("parent_id"), F.col("level").alias("parent_level"))
    both = items.join(parent, "parent_id", "left")
    finding = F.when(F.col("parent_id").isNull() & (F.col("level") > 1), "parent_required").when(F.col("parent_id").isNotNull() & F.col("parent_level").isNull(), "parent_missing").when(F.col("parent_level") >= F.col("level"), "parent_not_above")
    return both.select("toc_id", finding.alias("finding")).where("finding is not null")


def follow_derivation(rows: DataFrame, own: str, source: str, depth: int = 2) -> DataFrame:
    """``rows`` with ``origin``: the row at the end of the chain of ``source``, at most ``depth`` steps away."""
    steps = rows.select(F.col(own).alias("step_own"), F.col(source).alias("step_source"))
    out = rows.withColumn("origin", F.coalesce(F.col(source), F.col(own)))
    for _ in range(depth - 1):
        out = out.join(steps, F.col("origin") == F.col("step_own"), "left").withColumn("origin", F.coalesce("step_source", "origin")).drop("step_own", "step_source")
    return out
