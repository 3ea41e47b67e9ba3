"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the entropy-closest to 1 that meets its source's token constraint and the bound of two copies: the exponential
tilt min(2, exp(lambda * size)). The convex dual has one unknown a source; Newton steps, kept inside a bracket that is halved where a
step gains too little, run for all sources at once as joins and aggregates over counts of (source, size). Rates are then rounded to
whole copies, errors carried from larger to smaller documents within bounded blocks of a source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .runtime import discard, free_names, prepare, stored

WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most copies of a document.
SHARE = 1.5
MOST = 2.0
#: Documents rounded together.
BLOCK = 2000
#: Most Newton steps and halvings; a dual takes about 20, and twice the digits of a double at worst.
STEPS = 160
#: Relative error of a source's words at which its Newton steps end.
NEAR = 1e-9


class NotConverged(RuntimeError):
    """A source whose constraint no tilt meets."""


def sizes(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", row: Column | None = None) -> DataFrame:
    """doc_id, source, size (words of each row's text, 0 for a null) and row (a hash of the text, or of what else tells rows of one id apart)."""
    count = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), count.alias("size"), (F.xxhash64(F.col(f"`{text_col}`")) if row is None else row).cast("long").alias("row"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n, source_size, target: words shared by the weights, which repeat in the order of the sources' code points, null last.

    A target stops at ``most`` times its source's size; the excess goes to the others by weight. Sources are placed by ranges, not in one
    task, and the level at which those that aren't stopped share is found by aggregates: each round stops the sources that the level
    reaches, until it reaches no more.
    """
    by = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")).withColumn("without", F.col("source").isNull())
    by = numbered(by, ["without", "source"], "place")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    by = stored(by.select("source", "n", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap")), "sources")
    level, stopped, reached = 0.0, -1, 0
    while stopped < reached:
        stopped, free = reached, F.col("cap") > F.col("weight") * level
        sums = by.agg(F.sum("source_size").alias("all"), F.sum(F.when(free, F.col("weight"))).alias("free"), F.sum(F.when(~free, F.col("cap"))).alias("caps")).first()
        if not sums.free:  # no words at all
            break
        level = max(level, (sums["all"] * share - (sums.caps or 0.0)) / sums.free)
        reached = by.where(F.col("cap") <= F.col("weight") * level).count()
    return by.select("source", "n", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _rate(tilt: Column, scaled: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.least(tilt * scaled, F.lit(700.0))))


def tilts(sized: DataFrame, aims: DataFrame, most: float = MOST) -> DataFrame:
    """source, tilt (null: all documents ``most`` times), mean size: solutions of the dual. NotConverged if one isn't found."""
    counts = stored(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("c")), "sizes")
    free = F.col("target") < F.col("source_size") * most * (1 - 1e-12)
    start = aims.where(free & (F.col("target") > 0)).select(F.col("source").alias("s"), "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("tilt"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(float("inf")).alias("was"), F.lit(False).alias("done"))
    state = stored(start, "tilts")
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        z = F.col("size") / F.col("mean")
        r = _rate(F.col("tilt"), z, most)
        words = F.col("c") * F.col("size")
        joined = counts.join(state.where("not done"), F.col("source").eqNullSafe(F.col("s")))
        sums = joined.groupBy("s", "target", "mean", "tilt", "lo", "hi", "was").agg(F.sum(words * r).alias("got"), F.sum(F.when(r < most, words * z * r)).alias("slope"))
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))
        narrow = F.col("hi") - F.col("lo") <= F.greatest(F.abs("lo"), F.abs("hi"), F.lit(1e-3)) * 1e-14
        step = F.when(F.abs(gap) <= F.col("was") / 2, F.col("tilt") - gap / F.col("slope"))  # null, too, where all documents are at the bound
        moved = sums.select("s", "target", "mean", "tilt", lo.alias("lo"), hi.alias("hi"), F.abs(gap).alias("was"), step.alias("step"), ((F.abs(gap) <= F.col("target") * NEAR) | narrow).alias("done"))
        inside = F.coalesce((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.lit(False))
        tilt = F.when(F.col("done"), F.col("tilt")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        later = stored(moved.select("s", "target", "mean", tilt.alias("tilt"), "lo", "hi", F.when(inside, F.col("was")).otherwise(F.lit(float("inf"))).alias("was"), "done").unionByName(state.where("done")), "tilts")
        discard(state)
        state = later
    discard(counts)
    if left := state.where("not done").select("s").take(3):
        raise NotConverged(f"no tilt for the sources {[r.s for r in left]} in {STEPS} steps")
    # sums of doubles differ in their last bits from run to run; a rounded tilt doesn't, so reruns agree
    return state.select("s", F.round("tilt", 8).alias("tilt"), "mean")


def _rounded(block: pd.DataFrame) -> pd.DataFrame:
    """Copies of a block's documents: from the largest on, what brings the words taken nearest to what the rates ask for."""
    block = block.sort_values(["size", "order", "doc_id", "row"], ascending=[False, True, True, True], kind="stable")
    size, want = block["size"].to_numpy(), np.cumsum(block["rate"].to_numpy() * block["size"].to_numpy())
    most, taken = int(block["most"].iloc[0]), 0
    out = np.zeros(len(block), np.int64)
    for i, (s, w) in enumerate(zip(size.tolist(), want.tolist(), strict=True)):
        if s:
            out[i] = min(most, max(0, round((w - taken) / s)))
            taken += int(out[i]) * s
    block["copies"] = out
    return block[["doc_id", "row", "size", "source_size", "target", "rate", "copies"]]


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", row: Column | None = None) -> DataFrame:
    """doc_id, row, size, source_size, target, rate and copies of each row of ``docs``; ``row`` as in :func:`sizes`.

    A null source is one source, the last; a null or empty text has no words and no copies. Repeated rows count each. Ties in
    rounding go by a hash of the id, so reruns agree. An empty table gives no rows; other columns aren't read, and texts of any length
    count whole.
    """
    prepare(docs.sparkSession)
    sized = stored(sizes(docs, text_col, source_col, id_col, row), "sized")
    aims = stored(targets(sized, weights, share, most), "targets")
    tilt = tilts(sized, aims, most)
    per = aims.join(tilt, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "n", "source_size", "target", "tilt", "mean")
    per = stored(per, "rates")
    rate = F.when(F.col("tilt").isNotNull(), _rate(F.col("tilt"), F.col("size") / F.col("mean"), most)).when(F.col("target") > 0, F.lit(most)).otherwise(F.lit(0.0))
    order = F.xxhash64("doc_id", "size")
    block = F.pmod(F.xxhash64("doc_id", "size", "row", F.lit(5)), F.ceil(F.col("n") / BLOCK))
    rows = sized.join(per, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "row", "source", "size", "source_size", "target", rate.alias("rate"), order.alias("order"), block.alias("block"), F.lit(most).alias("most"))
    return rows.groupBy("source", "block").applyInPandas(_rounded, "doc_id long, row long, size long, source_size long, target double, rate double, copies long")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (copies times size)."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Rows of one id are told apart by a hash of all their columns, so each is taken as
    often as it should; rows alike in all columns are one row, taken as often as they are together."""
    own, row, own_row, times, rows, first = free_names(docs, "mix_id", "mix_row", "mix_own_row", "mix_copies", "mix_rows", "mix_first")
    named = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(row, F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString())))
    copies = mix(keyed, row=F.col(row)).groupBy(F.col("doc_id").alias(own), F.col("row").alias(own_row)).agg(F.sum("copies").cast("int").alias(times), F.count("*").alias(rows)).where(F.col(times) > 0)
    copies = stored(copies, "copies")
    same = lambda many: F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(row) == F.col(own_row)) & many
    repeat = lambda df: df.withColumn(own, F.explode(F.sequence(F.lit(1), F.col(times))))
    out = repeat(keyed.join(copies.where(F.col(rows) == 1), same(F.lit(True)))).select(named)
    if copies.where(F.col(rows) > 1).isEmpty():  # as a rule
        return out
    several = keyed.join(copies.where(F.col(rows) > 1), same(F.lit(True))).groupBy(own, own_row, times).agg(F.first(F.struct(*named)).alias(first))
    return out.unionByName(repeat(several).select(*(F.col(first)[c].alias(c) for c in docs.columns)))
