"""Numbers and digests over the order of a whole table, without putting the table into one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .graph import cut_lineage


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: each row's place, from 1, in the order of the whole table.

    Rows are dealt by ranges of the order and numbered within each; what stands before a range is a running sum over as many rows as
    there are ranges.
    """
    dealt = cut_lineage(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("size_"))
    before = sizes.select("range_", F.coalesce(F.sum("size_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return dealt.join(before, "range_").withColumn(name, own + F.col("before_")).drop("range_", "before_")


def with_next(rows: DataFrame, place: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the value of the row at the next place, by a join."""
    after = rows.select((F.col(place) - 1).alias("place_"), F.col(value).alias(name))
    return rows.join(after, F.col(place) == F.col("place_"), "left").drop("place_")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, line) sorted; the digest is fed line by line, so memory doesn't grow with a group."""
    group, n, sha = None, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], names=["group_", "n", "digest"])

    for batch in batches:
        for g, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if sha is None or g != group:
                if sha is not None:
                    yield row()
                group, n, sha = g, 0, hashlib.sha256()
            sha.update(f"{chr(10) if n else ''}{line}".encode())
            n += 1
    if sha is not None:
        yield row()


def root_digest(rows: DataFrame, group: Column, line: Column) -> DataFrame:
    """group_, n and digest of each group's lines, whatever their order.

    Lines go to 256 parts by their own hash; a part's digest is that of its lines, sorted and joined with newlines, fed line by line, and a group's
    is that of its parts' digests. So a group with all rows is 256 tasks' work and no task holds more than an Arrow batch.
    """
    ship(rows.sparkSession)
    own = rows.select(group.cast("string").alias("group_"), F.coalesce(line, F.lit("None")).alias("line")).withColumn("part", F.substring(F.sha2("line", 256), 1, 2))
    parts = own.select(F.concat(F.col("part"), F.coalesce("group_", F.lit("\x00"))).alias("key"), "line").repartition("key").sortWithinPartitions("key", "line").mapInArrow(_digested, "group_ string, n long, digest string")
    named = parts.select(F.nullif(F.expr("substring(group_, 3)"), F.lit("\x00")).alias("group_"), "n", F.concat(F.substring("group_", 1, 2), F.lit(":"), "digest").alias("part"))
    return named.groupBy("group_").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("part")), "\n"), 256).alias("digest"))


def report(failing: dict[str, DataFrame], most: int = 100) -> DataFrame:
    """check_id, passed, n_observed and observed (the first ``most`` distinct values in order) of each check, from its failing values (column v).

    All checks' values are one table that is aggregated once; the window keeps ``most`` rows a check on the map side already.
    """
    parts = [df.select(F.lit(name).alias("check_id"), F.col("v").cast("string").alias("v")) for name, df in failing.items()]
    by = reduce(DataFrame.unionByName, parts).groupBy("check_id", "v").agg(F.count("*").alias("c"))
    counted = by.groupBy("check_id").agg(F.sum("c").alias("n"))
    place = F.row_number().over(Window.partitionBy("check_id").orderBy("v"))
    first = by.where("v is not null").withColumn("place", place).where(F.col("place") <= most).groupBy("check_id").agg(F.array_sort(F.collect_list("v")).alias("first"))
    names = by.sparkSession.createDataFrame([(name,) for name in failing], "check_id string")
    out = names.join(counted, "check_id", "left").join(first, "check_id", "left")
    return out.select("check_id", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0)).alias("n_observed"), F.coalesce("first", F.array().cast("array<string>")).alias("observed"))
