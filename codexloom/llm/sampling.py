"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of(id_col: str) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


#: Most labels that a sample has rows of, the most frequent ones; the counts of so many are gathered in the driver.
LABELS = 200


def sample(rows: DataFrame, label: str, key: str, total: int, labels: int = LABELS) -> DataFrame:
    """About ``total`` rows of ``rows``, as many of each label: those with the least hashes of ``key``; all of a rarer label.

    Labels are counted once, and rows are chosen by an expression: no join, and no table that grows with the labels.
    """
    counts = rows.groupBy(F.col(label).alias("sample_label")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "sample_label").limit(labels).collect()
    if not counts:
        return rows.limit(0)
    shares = F.create_map(*(x for r in counts for x in (F.lit(r.sample_label), F.lit(min(1.0, total / len(counts) / r.c)))))
    place = F.xxhash64(F.col(key), F.lit(11)) / F.lit(float(2**64)) + 0.5
    return rows.where(place < F.try_element_at(shares, F.col(label)))
