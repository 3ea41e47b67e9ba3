"""Reviewed text rebuilt from raw blocks and the decisions in force.

A rebuild starts from the raw blocks every time, never from an earlier rebuild, so a decision that is replaced leaves nothing behind. Decisions are
judged first; those that don't stand are reported and leave their blocks as they are.

Blocks: doc_id, page_id, block_id, ordinal (its place in the document), evidence_id, text. Decisions (the latest of each target): decision_id, action,
block_id (the target), block_ids (members in their reviewed order), text (reviewed), evidence_id (selected), reason, pieces (segment, block_id,
start, end; in reviewed order). Observations: evidence_id, page_id, variant_group_id, text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids

ACTIONS = ("exclude_block", "correct_text", "select_variant", "join_blocks", "join_blocks_across_surfaces", "split_block", "resegment_blocks", "reorder_blocks")
DECISIONS = "decision_id string, action string, block_id string, block_ids array<string>, text string, evidence_id string, reason string, pieces array<struct<segment:int,block_id:string,start:int,end:int>>"
_JOINS, _CUTS = ("join_blocks", "join_blocks_across_surfaces"), ("split_block", "resegment_blocks")
_STATUS = {
    "reviewed_exclusion": ("exclude_block",), "reviewed_correction": ("correct_text",), "reviewed_variant_selection": ("select_variant",), "reviewed_reorder": ("reorder_blocks",), "reviewed_join": _JOINS, "reviewed_split": ("split_block",), "reviewed_resegment": ("resegment_blocks",),
}


def _blank(value: str) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def _judged(blocks: DataFrame, made: DataFrame, observed: DataFrame) -> DataFrame:
    """A row a decision: decision_id, head (its action, text, evidence_id), members (at, block_id, ordinal, segment, start, end: its blocks in their
    order, or the pieces it cuts), variant (the text selected) and findings.

    Every table is read once: members meet their blocks, are looked at along the block and along the document, and are gathered by decision.
    """
    c = F.col
    member = lambda block: F.struct(F.lit(None).cast("int").alias("segment"), block.alias("block_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    own = F.when(c("action").isin(*_JOINS, "reorder_blocks"), F.transform("block_ids", member)).when(c("action").isin(*_CUTS), c("pieces")).otherwise(F.array(member(c("block_id"))))
    rows = made.withColumn("head", F.struct("action", "text", "evidence_id", "reason")).select("decision_id", "action", "head", F.posexplode_outer(own).alias("at", "m"))
    first = F.coalesce(c("at"), F.lit(0)) == 0  # the decision's own fields go with one member
    rows = rows.select("decision_id", "action", F.when(first, c("head")).alias("head"), "at", "m.segment", "m.block_id", c("m.start").alias("start"), c("m.end").alias("end"))
    rows = rows.join(blocks.select("block_id", "doc_id", "page_id", "ordinal", c("evidence_id").alias("own_evidence"), F.length("text").alias("size")), "block_id", "left")
    is_cut, there = c("action").isin(*_CUTS), c("at").isNotNull()
    block, along = Window.partitionBy("block_id"), Window.partitionBy("block_id", "decision_id")
    often = (F.min("decision_id").over(block) != F.max("decision_id").over(block)) | (F.sum(F.when(is_cut, 0).otherwise(1)).over(block) > 1)
    uneven = (c("start") != F.lag("end", 1, 0).over(along.orderBy("start", "end"))) | (F.coalesce(F.max("end").over(along), F.lit(0)) != c("size"))
    rows = rows.withColumns({"often": there & c("block_id").isNotNull() & often, "uneven": is_cut & c("doc_id").isNotNull() & F.coalesce(uneven, F.lit(False))})
    rows = rows.withColumn("gone", F.coalesce((c("action") == "exclude_block") & c("doc_id").isNotNull(), F.lit(False)))
    down = Window.partitionBy("doc_id").orderBy("ordinal")
    ranked = Window.partitionBy("doc_id").orderBy("ordinal", c("gone").desc())
    again = F.coalesce(F.lag("gone").over(ranked) & (F.lag("ordinal").over(ranked) == c("ordinal")), F.lit(False))
    rows = rows.withColumn("gone", (c("gone") & ~again).cast("int"))  # one of each place
    rows = rows.withColumns({"upto": F.sum("gone").over(down), "below": F.coalesce(F.sum("gone").over(down.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    by = rows.groupBy("decision_id").agg(
        F.first("head", ignorenulls=True).alias("head"), F.count("head").alias("copies"), F.sort_array(F.collect_list(F.when(there, F.struct("at", "block_id", "ordinal", "segment", "start", "end", "doc_id")))).alias("members"), F.max("page_id").alias("page_id"), F.max("own_evidence").alias("own_evidence"),
        F.bool_or(there & c("doc_id").isNull()).alias("missing"), F.bool_or("often").alias("often"), F.bool_or("uneven").alias("uneven"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), (F.max("upto") - F.min(F.when(c("doc_id").isNotNull(), c("below")))).alias("passed"),
        (F.min("doc_id") == F.max("doc_id")).alias("one_doc"), (F.min("page_id") == F.max("page_id")).alias("one_page"),
    )
    # a decision that selects nothing has a key of its own, so that they don't all meet in one task
    key = lambda name: F.when(c("head.action") == "select_variant", F.concat(F.lit("="), name)).otherwise(F.concat(F.lit("-"), c("decision_id")))
    seen = observed.withColumn("key_", F.concat(F.lit("="), "evidence_id"))
    by = by.withColumn("key_", key(c("own_evidence"))).join(seen.select("key_", c("variant_group_id").alias("own_group")), "key_", "left")
    by = by.withColumn("key_", key(c("head.evidence_id"))).join(seen.select("key_", c("page_id").alias("page_"), c("variant_group_id").alias("group_"), c("text").alias("variant")), "key_", "left")
    action, some = c("head.action"), F.size("members") > 0
    is_join, is_cut = action.isin(*_JOINS), action.isin(*_CUTS)
    pairs = lambda xs, f: F.exists(F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda x, y: F.coalesce(f(x, y), F.lit(False))), lambda x: x)
    found = F.filter("members", lambda m: m["doc_id"].isNotNull())
    n = F.size(F.array_distinct(F.transform(found, lambda m: m["ordinal"])))
    passed = F.when(action == "join_blocks_across_surfaces", F.coalesce("passed", F.lit(0))).otherwise(0)
    true = lambda x: F.coalesce(x, F.lit(False))
    near = true(c("one_doc")) & (c("hi") - c("lo") + 1 == n + passed) & (true(c("one_page")) | action.isin("join_blocks_across_surfaces", "resegment_blocks"))
    back = lambda x, y: (F.struct(y["ordinal"], y["start"]) < F.struct(x["ordinal"], x["start"])) | true(y["segment"] < x["segment"])
    faults = {
        "action": ~true(action.isin(*ACTIONS)), "member_missing": c("missing"), "member_repeated": c("often") | (is_cut & some & (c("copies") > 1)), "reason": (action == "exclude_block") & _blank("head.reason"), "text": (action == "correct_text") & _blank("head.text"),
        "variant": (action == "select_variant") & ~true((c("page_") == c("page_id")) & (c("group_") == c("own_group"))), "not_neighbours": action.isin(*_JOINS, "reorder_blocks", "resegment_blocks") & some & ~near,
        "order": (is_join & pairs(F.transform("members", lambda m: m["ordinal"]), lambda x, y: y <= x)) | (is_cut & pairs(found, back)), "coverage": c("uneven"),
    }
    return by.select("decision_id", "head", "members", "variant", F.filter(F.array(*(F.when(v, name) for name, v in faults.items())), lambda x: x.isNotNull()).alias("findings"))


def findings(blocks: DataFrame, made: DataFrame, observed: DataFrame) -> DataFrame:
    """decision_id and finding of decisions that don't stand.

    An unknown action; a member that isn't there or that two decisions take; an exclusion without a reason, a correction without a text; a variant of
    another page or group; members of a join or a new order that aren't neighbours on one page (a join across pages may pass over excluded blocks), or
    not in order for a join; pieces that go back in the source, or don't cover every block of theirs exactly.
    """
    return _judged(blocks, made, observed).select("decision_id", F.explode("findings").alias("finding")).distinct()


def rebuild(blocks: DataFrame, made: DataFrame, observed: DataFrame) -> DataFrame:
    """doc_id, place (from 1 in each document), block_id, text, selection_status, canonical_disposition, decision_id and source_spans (block_id, start,
    end) of the reviewed blocks. Decisions that don't stand aren't applied.

    A block is of one decision in force at most, so blocks meet decisions in one join; what is joined or cut is gathered by document and decision.
    """
    c, lit = F.col, F.lit
    stand = _judged(blocks, made, observed).where(F.size("findings") == 0)
    slots = F.array_sort(F.transform("members", lambda m: m["ordinal"]))
    placed = F.zip_with("members", slots, lambda m, slot: F.struct(m["at"].alias("at"), m["block_id"].alias("block_id"), m["segment"].alias("segment"), m["start"].alias("start"), m["end"].alias("end"), slot.alias("slot")))
    applied = stand.select("decision_id", "head", "variant", F.explode(placed).alias("m"))
    applied = applied.select("m.block_id", "decision_id", c("head.action").alias("action"), F.when(c("m.at") == 0, c("head.text")).alias("new_"), "variant", "m.at", "m.segment", c("m.start").alias("start"), c("m.end").alias("end"), "m.slot")
    rows = blocks.select("doc_id", "block_id", "ordinal", "text").join(applied, "block_id", "left")
    is_join, is_cut = F.coalesce(c("action").isin(*_JOINS), lit(False)), F.coalesce(c("action").isin(*_CUTS), lit(False))
    text = F.when(c("action") == "correct_text", c("new_")).when(c("action") == "select_variant", c("variant")).when(is_cut, F.substring(c("text"), c("start") + 1, c("end") - c("start"))).otherwise(c("text"))
    a, b = F.when(is_cut, c("start")).otherwise(0), F.when(is_cut, c("end")).otherwise(F.length("text"))
    piece = F.struct(F.coalesce("at", lit(0)).alias("at"), text.alias("text"), F.struct("block_id", a.cast("int").alias("start"), b.cast("int").alias("end")).alias("span"))
    ordinal = F.when(c("action") == "reorder_blocks", c("slot")).otherwise(c("ordinal"))
    kind = F.when(is_join, "join").when(is_cut, "cut").otherwise("one")
    rows = rows.select("doc_id", kind.alias("kind"), F.when(kind == "one", c("block_id")).otherwise(c("decision_id")).alias("of"), F.when(is_cut, c("segment")).otherwise(0).alias("part"), ordinal.alias("ordinal"), piece.alias("piece"), "decision_id", "action", F.when(is_join, c("new_")).alias("reviewed"))
    # dealt by document once, for the groups and for the places
    by = rows.repartition("doc_id").groupBy("doc_id", "kind", "of", "part", F.when(c("kind") == "one", c("ordinal"))).agg(F.min("ordinal").alias("ordinal"), F.sort_array(F.collect_list("piece")).alias("m"), F.max("decision_id").alias("decision_id"), F.max("action").alias("action"), F.max("reviewed").alias("reviewed"))
    by = by.withColumn("m", F.explode(F.when(c("kind") == "one", F.transform("m", lambda x: F.array(x))).otherwise(F.array("m"))))  # blocks that share an id stay
    texts, spans = F.transform("m", lambda x: x["text"]), F.transform("m", lambda x: x["span"])
    names = F.array_join(F.transform("m", lambda x: x["span"]["block_id"]), "|")
    where = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["span"]["block_id"], x["span"]["start"], x["span"]["end"])), ",")
    prefix = F.when(c("action") == "split_block", "blk_split_").otherwise("blk_resegment_")
    block = F.when(c("kind") == "join", F.concat(lit("blk_join_"), ids.short_sha(names))).when(c("kind") == "cut", F.concat(prefix, ids.short_sha(F.concat_ws("|", "part", where)))).otherwise(c("of"))
    joined = F.when(_blank("reviewed"), F.array_join(texts, " ")).otherwise(c("reviewed"))
    whole = F.when(c("kind") == "join", joined).when(c("kind") == "cut", F.array_join(texts, "")).otherwise(c("m")[0]["text"])
    status = reduce(lambda w, x: w.when(c("action").isin(*x[1]), x[0]), _STATUS.items(), F.when(c("action").isNull(), "machine_selected")).otherwise("machine_selected")
    gone = F.when(c("action") == "exclude_block", "excluded").otherwise("included")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "part"))
    return by.select("doc_id", block.alias("block_id"), whole.alias("text"), status.alias("selection_status"), gone.alias("canonical_disposition"), "decision_id", spans.alias("source_spans"), place.alias("place"))


def applies(revision: str, expected: str | None) -> bool:
    """Whether a batch made for a revision may be appended to the one that is there: an unstated one always, another one never."""
    return expected is None or expected == revision


def rehydrated(log: DataFrame, source_sha: str, run_id: str, revision: str) -> DataFrame:
    """The latest decision of each target that stands after a run became the active one: those made for it, paragraphs and structure also for
    its canonical revision. Decisions of other runs come back when theirs does."""
    from . import decisions

    return decisions.latest(decisions.of_head(log, source_sha, run_id, revision), ["kind", "target_id"], ["seq"])
