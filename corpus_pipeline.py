"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.llm.bpe import encode
from codexloom.llm.mixing import mixed
from codexloom.llm.near_duplicates import near_duplicates
from codexloom.llm.pii import redacted
from codexloom.llm.quality_rules import quality_filter
from codexloom.llm.queries import TOKENIZERS, table
from codexloom.llm.runtime import free_names, new_path, stored

#: Rows without an id get one from here on, above all real ones; and what a text with words has.
UNNAMED = 1 << 62
WORD = r"[^\x20\x09-\x0D]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the smallest id; the least by all columns where rows repeat an id.

    Rows without an id come after those with one, in the order of a hash of their text; without words as well, they stay.
    """
    key, kept_key, repeated, row = free_names(docs, "dedup_key", "dedup_kept", "dedup_repeated", "dedup_row")
    hashed = F.xxhash64("text").bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.when(F.rlike("text", F.lit(WORD)), hashed)))
    kept = near_duplicates(keyed, key).where("kept").groupBy(F.col("doc_id").alias(kept_key)).agg((F.count("*") > 1).alias(repeated))
    kept = stored(kept.withColumn(repeated, F.col(repeated) & F.col(kept_key).isNotNull()), "kept")
    # a sorted join at every size: sent around on small tables only, the kept ids would make the shuffle grow faster than the input
    single = keyed.join(kept.where(~F.col(repeated)).hint("merge"), F.col(key).eqNullSafe(F.col(kept_key)), "left_semi").drop(key)
    if kept.where(repeated).isEmpty():  # as a rule
        return single
    several = keyed.join(kept.where(repeated), F.col(key) == F.col(kept_key), "left_semi")
    least = several.groupBy(key).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(row))
    return single.unionByName(least.select(*(F.col(row)[c].alias(c) for c in docs.columns)))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources meet their target weights."""
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of each document."""
    return encode(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("bpe", bpe)]

#: SQL can't express near-duplicate sketches' confirmation at this size, redaction by a trained field or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's output but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
