"""Checks over ledgers: references, gaps, overlaps, coverage, sets, exactly-once use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key isn't in ``parent``; a null key has no parent."""
    return child.join(parent.select(F.col(parent_key).alias("parent_key_")).distinct(), F.col(key) == F.col("parent_key_"), "left_anti")


def missing(expected: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are expected and not given."""
    return expected.select(*keys).distinct().join(given.select(*keys).distinct(), keys, "left_anti")


def contiguous(rows: DataFrame, group: str, index: str, start: int = 0) -> DataFrame:
    """Of each group whether its indexes are start, start + 1, ... without gap or repeat. One aggregate, no sort."""
    by = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(index).alias("n_distinct"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    ok = (F.col("n") == F.col("n_distinct")) & (F.col("lo") == start) & (F.col("hi") == start + F.col("n") - 1)
    return by.select(group, "n", "lo", "hi", F.coalesce(ok, F.lit(False)).alias("contiguous"))


#: Indexes of a bucket, and the levels of buckets: a window but the last sorts at most so many rows, the last one a row for 10**8 indexes.
_BUCKET, _LEVELS = 10_000, 3


def missing_indexes(rows: DataFrame, index: str) -> DataFrame:
    """Indexes from 1 to the largest that no row has: each gap between neighbours, expanded in pieces.

    Neighbours are met within buckets, then the buckets' ends within buckets of buckets, and so on: no window but the last holds more than a bucket's rows, and that a row for 10**8 indexes.
    """
    ends = rows.select(F.col(index).cast("long").alias("lo")).where("lo >= 1").distinct().withColumn("hi", F.col("lo"))
    gaps = None
    for level in range(1, _LEVELS + 1):
        last = level == _LEVELS
        bucket = F.lit(0).cast("long") if last else F.expr(f"lo div {_BUCKET**level}")
        own = ends.withColumn("bucket", bucket)
        before = F.lag("hi").over(Window.partitionBy("bucket").orderBy("lo"))
        own = own.withColumn("before", F.coalesce(before, F.lit(0).cast("long")) if last else before)
        found = own.where("lo > before + 1").select((F.col("before") + 1).alias("a"), (F.col("lo") - 1).alias("b"))
        gaps = found if gaps is None else gaps.unionByName(found)
        ends = own.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("bucket")
    piece = _BUCKET * 100
    pieces = gaps.select("b", F.explode(F.sequence("a", "b", F.lit(piece).cast("long"))).alias("a"))
    return pieces.select(F.explode(F.sequence("a", F.least("b", F.col("a") + (piece - 1)))).alias("missing"))


def partition_check(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Whether the spans of each block cut its text without gap or overlap.

    ``blocks``: block_id, size. ``spans``: block_id, span_start, span_end. A block without spans is uncovered unless it is empty.
    Returns block_id, n_spans, covered, overlapping and status: ok, missing, gap or overlap.
    """
    order = Window.partitionBy("block_id").orderBy("span_start", "span_end")
    lined = spans.withColumn("previous", F.lag("span_end", 1, 0).over(order))
    by = lined.groupBy("block_id").agg(
        F.count("*").alias("n_spans"), F.max("span_end").alias("last"), F.bool_or(F.col("span_start") > F.col("previous")).alias("gap"), F.bool_or(F.col("span_start") < F.col("previous")).alias("lapped"), F.sum(F.col("span_end") - F.col("span_start")).alias("covered")
    )
    both = blocks.select("block_id", "size").join(by, "block_id", "left")
    n, size = F.coalesce("n_spans", F.lit(0)), F.col("size")
    status = F.when((n == 0) & (size > 0), "missing").when(F.coalesce("lapped", F.lit(False)) | (F.coalesce("last", F.lit(0)) > size), "overlap").when(F.coalesce("gap", F.lit(False)) | (F.coalesce("last", F.lit(0)) < size), "gap").otherwise("ok")
    return both.select("block_id", "size", n.alias("n_spans"), F.coalesce("covered", F.lit(0).cast("long")).alias("covered"), status.alias("status"))


def reverse_map(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Whether each row's pieces, put together in their order, are its text again."""
    again = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("again"), F.count("*").alias("n_pieces"))
    both = docs.select(F.col(id_col).alias("doc_id"), F.col("text")).join(again, "doc_id", "left")
    return both.select("doc_id", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"), F.coalesce(F.col("again") == F.col("text"), F.lit(False)).alias("reversible"))


def claims(uses: DataFrame, item: str, order: list[str]) -> DataFrame:
    """Each item belongs to the first use in order: item and the fields of ``order``. A partial aggregate, no window."""
    return uses.groupBy(item).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("uses")).select(item, "first.*", "uses")


def reference_counts(items: DataFrame, item_key: str, uses: DataFrame, use_key: str) -> DataFrame:
    """How often each item is used, 0 for never."""
    counts = uses.groupBy(F.col(use_key).alias("used_")).agg(F.count("*").alias("n"))
    return items.select(item_key).join(counts, F.col(item_key) == F.col("used_"), "left").select(item_key, F.coalesce("n", F.lit(0)).alias("uses"))


def reconcile(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys that differ: missing, extra or duplicate, with both counts."""
    a = expected.groupBy(key).agg(F.count("*").alias("expected"))
    b = given.groupBy(key).agg(F.count("*").alias("given"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("given", F.lit(0)).alias("given"))
    kind = F.when(F.col("given") == 0, "missing").when(F.col("expected") == 0, "extra").when(F.col("given") > F.col("expected"), "duplicate").when(F.col("given") < F.col("expected"), "short")
    return both.withColumn("finding", kind).where("finding is not null")


def same_sets(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def is_permutation(order: Column) -> Column:
    """Whether an array holds a run of consecutive numbers, each once."""
    return (F.size(F.array_distinct(order)) == F.size(order)) & (F.array_max(order) - F.array_min(order) + 1 == F.size(order))


def check(check_id: str, failing: DataFrame, value: Column) -> DataFrame:
    """A report row: check_id, passed, n_observed and the least value observed."""
    return failing.agg(F.count("*").alias("n_observed"), F.min(value.cast("string")).alias("first_observed")).select(F.lit(check_id).alias("check_id"), (F.col("n_observed") == 0).alias("passed"), "n_observed", "first_observed")
