"""Known passages in documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of windows (powers of two), and characters of grams for passages without a word of their own.
WINDOWS = (4, 2, 1)
GRAMS = (3, 2, 1)


def _windows(rows: DataFrame, words: str, size: int) -> DataFrame:
    """``rows`` with ``words`` replaced by the hashes of its windows of ``size`` words, built by doubling."""
    df = rows.withColumn(words, F.transform(words, lambda w: F.xxhash64(w)))
    step = 1
    while step < size:
        df = df.withColumn(words, F.zip_with(words, F.slice(words, step + 1, F.size(words)), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    return df.withColumn(words, F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))))


def _grams(value: Column, size: int) -> Column:
    """Every ``size`` characters on end, in one pass (a substring from each place walks the text from its start)."""
    return F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def contained(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) of passages (item_id, passage) that a document's text (doc_id, text) holds.

    A passage that occurs has, from its second word to its last but one, the document's own words: documents and passages meet by the
    hash of the first window there, as wide as there are words for. A passage without an inner word has its longer word, or all of it if it is blank,
    within one word (or run of blanks) of the document: each distinct word of all documents is searched once, those that share its first characters, and
    documents meet passages by the words found. The text itself is searched for those that meet. Every meeting is a join on a key; which sizes are
    needed is asked of the passages alone. An empty or null passage is in no text.
    """
    split = lambda c: F.split(c, r"\s+")
    inner = passages.where("passage <> ''").select("item_id", "passage", split(F.col("passage")).alias("w")).withColumn("inner", F.size("w") - 2)
    window = F.when(F.col("inner") >= WINDOWS[0], WINDOWS[0]).when(F.col("inner") >= WINDOWS[1], WINDOWS[1]).when(F.col("inner") == 1, 1)
    first, last = F.col("w")[0], F.element_at("w", -1)
    longer = F.when(F.length(first) >= F.length(last), first).otherwise(last)
    blank = F.length(longer) == 0
    inner = inner.withColumns({"window": window, "part": F.when(window.isNull(), F.when(blank, F.col("passage")).otherwise(longer)), "blank": window.isNull() & blank})
    inner = inner.withColumn("gram", F.least(F.lit(GRAMS[0]), F.length("part")))
    needed = inner.select("window", "gram", "blank").distinct().collect()  # a row a size
    met = []
    for size in sorted({r.window for r in needed if r.window}):
        keys = _windows(inner.where(F.col("window") == size).select("item_id", F.slice("w", 2, size).alias("w")), "w", size).select("item_id", F.col("w")[0].alias("key"))
        own = _windows(docs.select("doc_id", split(F.col("text")).alias("w")), "w", size).select("doc_id", F.explode(F.array_distinct("w")).alias("key"))
        met.append(own.join(keys, "key").select("doc_id", "item_id"))
    grams = sorted({r.gram for r in needed if r.gram})
    if grams:
        parts = split(F.col("text"))
        if any(r.blank for r in needed):
            parts = F.concat(parts, F.regexp_extract_all("text", F.lit(r"\s+"), F.lit(0)))
        words = docs.select("doc_id", F.explode(F.array_distinct(parts)).alias("word"))
        found = []
        for size in grams:
            keys = inner.where(F.col("gram") == size).select("item_id", "part", F.substring("part", 1, size).alias("key"))
            own = words.select("word").distinct().select("word", F.explode(F.array_distinct(_grams(F.col("word"), size))).alias("key"))
            found.append(own.join(keys, "key").where(F.contains("word", "part")).select("word", "item_id"))
        met.append(words.join(reduce(DataFrame.unionByName, found), "word").select("doc_id", "item_id"))
    if not met:
        return docs.select("doc_id").join(passages.select("item_id").limit(0), F.lit(False))
    both = reduce(DataFrame.unionByName, met).distinct()
    return both.join(passages, "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id")
