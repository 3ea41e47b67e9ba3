"""Near-duplicate documents by MinHash.

One hash of each shingle fills the bins of a one-permutation sketch; empty bins take the value of the first filled
bin in a random order of their own (optimal densification). Five bins make a band, and documents with an equal band
meet in a bucket. A bucket proposes a star, its member with the smallest id to the others, never all of its pairs.
Proposed pairs are confirmed on their full shingle sets, and confirmed links give components. Where members of a bucket are then
still in different components, a link that its hub doesn't share could be left: for those documents alone an exact prefix
filter proposes every pair of different components that could link, so that the star loses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytegrid import mix, shingle_sets
from .runtime import prepare, discard, stored

SHINGLE = 5
BINS = 256
ROWS = 5
BANDS = BINS // ROWS
#: Documents link if PERCENT of their union is shared.
PERCENT = 75
#: A key is heavy with more rows than both a least number (LEAST_HEAVY; PAIRS for a hub's pairs) and a HEAVY-th of all: at most HEAVY keys are,
#: whatever the table. Buckets are looked at in one of LOOK documents.
HEAVY, LEAST_HEAVY, PAIRS, LOOK = 1000, 2000, 200, 64


def _orders() -> np.ndarray:
    """For each bin, the rank of every bin in the random order in which it looks for a filled one."""
    key = mix(np.arange(BINS * BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)).reshape(BINS, BINS)
    return np.argsort(np.argsort(key, axis=1), axis=1).astype(np.uint16)


_ORDERS = _orders()
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_ROW_STEP = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def sketch(sets: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of one sorted, non-empty set of hashes."""
    bins = (sets >> np.uint64(56)).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    out = np.zeros(BINS, np.uint64)
    out[filled] = sets[first]  # sorted, so the first of a bin is its least
    if len(filled) < BINS:
        empty = np.ones(BINS, bool)
        empty[filled] = False
        at = np.flatnonzero(empty)
        out[at] = out[filled[np.argmin(_ORDERS[at][:, filled], axis=1)]]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, the band's number mixed in; rows are sketches."""
    parts = sketches[:, : BANDS * ROWS].reshape(len(sketches), BANDS, ROWS)
    return mix((parts * _ROW_STEP).sum(axis=2, dtype=np.uint64) + _BAND_SALT)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column(1), SHINGLE)
        full = [i for i, s in enumerate(sets) if len(s)]
        digests: list[bytes | None] = [None] * len(sets)
        bands: list[np.ndarray | None] = [None] * len(sets)
        if full:
            keys = band_keys(np.stack([sketch(sets[i]) for i in full])).view(np.int64)
            for k, i in enumerate(full):
                digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                bands[i] = keys[k]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["id", "n", "digest", "bands"],
        )


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, b, text) in order, a's own texts (b null) first: the pairs whose sets link."""
    now, hubs = None, []
    for batch in batches:
        sets, found = shingle_sets(batch.column(3), SHINGLE), []
        for a, part, b, own in zip(*(batch.column(k).to_pylist() for k in range(3)), sets, strict=True):
            if (a, part) != now:
                now, hubs = (a, part), []
            if b is None:
                hubs.append(own)
                continue
            for hub in hubs:
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if len(own) and 100 * both >= PERCENT * (len(hub) + len(own) - both):
                    found.append((a, b))
                    break
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (distinct shingles), digest of the shingle set and band keys of each document; the last two null without words."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_signed, "id long, n long, digest binary, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for every id in an edge.

    Each round every component hooks onto its smallest neighbour, the chains of hooks are shortened until they are flat, and
    the edges left between different components are the next round's. All steps are joins and aggregates.
    """
    ids = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    label = stored(ids.withColumn("component", F.col("id")), "labels")
    left = edges.select("a", "b")
    while True:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy("a").agg(F.min("b").alias("b")).where("b < a"), "hooks")
        if hooks.isEmpty():
            discard(hooks)
            return label
        while True:  # a -> b -> c becomes a -> c
            ahead = hooks.select(F.col("a").alias("b"), F.col("b").alias("c"))
            flat = stored(hooks.join(ahead, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "hooks")
            moved = not flat.where("moved").isEmpty()
            discard(hooks)
            hooks = flat.select("a", "b")
            hooks._stored_at = flat._stored_at
            if not moved:
                break
        root = hooks.select(F.col("a").alias("component"), F.col("b").alias("root"))
        later = stored(label.join(root, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
        to_a = hooks.select(F.col("a"), F.col("b").alias("ra"))
        to_b = hooks.select(F.col("a").alias("b"), F.col("b").alias("rb"))
        nearer = stored(left.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct(), "edges")
        discard(label)
        discard(hooks)
        if hasattr(left, "_stored_at"):
            discard(left)
        label, left = later, nearer


def _heavy(counts: DataFrame, key: str, total: int, least: int = LEAST_HEAVY) -> DataFrame:
    """Keys (``key``, rows) with more than a HEAVY-th of ``total`` rows: fewer than HEAVY of them, whatever the table."""
    return counts.where(F.col("rows") > max(least, total // HEAVY)).select(key, "rows")


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, id, n, hub, hub_n) of the members of buckets with two members or more; the hub is the member with the least id.

    Buckets that look large in a fixed part of the documents have their hub found by a partial aggregate and sent to their members;
    all others meet in one shuffle. Both ways give the same rows, so the look decides only where the work is done.
    """
    keyed = reps.select(F.explode("bands").alias("key"), "id", "n")
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(LOOK)) == 0
    looked = stored(reps.where(part).select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > LEAST_HEAVY // LOOK), "looked")
    large = _heavy(looked.withColumn("rows", F.col("rows") * LOOK), "key", reps.count()).select("key")  # a document is in BANDS buckets: fewer than BANDS * HEAVY
    large = stored(large, "large")
    discard(looked)
    own = Window.partitionBy("key")
    met = keyed.join(F.broadcast(large), "key", "left_anti").withColumn("hub", F.min(F.struct("id", "n")).over(own)).withColumn("last", F.max("id").over(own))
    met = met.where(F.col("hub.id") < F.col("last")).select("key", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    hot = keyed.join(F.broadcast(large), "key")
    hubs = hot.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.max("id").alias("last")).where(F.col("hub.id") < F.col("last"))
    hot = hot.join(F.broadcast(hubs.select("key", "hub")), "key").select("key", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    return stored(met.unionByName(hot), "buckets")


def _first_stars(buckets: DataFrame) -> DataFrame:
    """Distinct pairs of a hub and a member whose set sizes allow a link."""
    fits = (F.col("n") * 100 >= F.col("hub_n") * PERCENT) & (F.col("hub_n") * 100 >= F.col("n") * PERCENT)
    return buckets.where((F.col("id") != F.col("hub")) & fits).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def _open(buckets: DataFrame, label: DataFrame | None) -> DataFrame:
    """(id, component) of the members of buckets that have members in different components."""
    rows = buckets.select("key", "id").withColumn("component", F.col("id"))
    if label is not None:
        rows = rows.drop("component").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return rows.join(mixed, "key", "left_semi").select("id", "component").distinct()


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), SHINGLE)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "grams"])


def _prefix_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of members in different components that could link, without exception.

    With each set ordered from its rarest shingle, two sets that share PERCENT of their union share one of the first
    n - ceil(PERCENT n / 100) + 1 of either, and the places of the first shared one leave enough after them. Passages that many
    documents share stand at the end of that order. Joins here and of texts are always sorted ones: a side that is small enough to be sent
    around on a small table isn't on a large one, and the plan is the same at every size.
    """
    sets = stored(members.hint("merge").join(texts, "id").select("id", "text").mapInArrow(_shingled, "id long, grams array<long>"), "sets")
    sizes = sets.select("id", F.size("grams").alias("n")).join(members, "id")
    rows = sets.select("id", F.explode("grams").alias("gram"))
    common = rows.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("id")
    place = F.row_number().over(own.orderBy("df", "gram")) + F.col("n") - F.count("*").over(own)
    first = rows.join(common.hint("merge"), "gram").join(sizes.hint("merge"), "id").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)
    first = stored(first.select("gram", "id", "component", "n", "place"), "prefixes")
    discard(sets)
    other = first.select("gram", F.col("id").alias("b"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("place").alias("at"))
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) + 1  # at most so many can be shared from the first shared one on
    fits = (F.col("id") < F.col("b")) & (F.col("component") != F.col("c")) & (left * (100 + PERCENT) >= (F.col("n") + F.col("m")) * PERCENT)
    pairs = stored(first.join(other.hint("merge"), "gram").where(fits).select(F.col("id").alias("a"), "b").distinct(), "pairs")
    discard(first)
    return pairs


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets link. A text goes once to each document ``a`` that it is compared with, and meets a's own text there;
    a document in very many pairs as ``a`` has copies, and its pairs are dealt to them."""
    counts = stored(pairs.groupBy("a").agg(F.count("*").alias("rows")), "hubs")
    heavy = F.broadcast(_heavy(counts, "a", pairs.count(), PAIRS))
    parts = F.coalesce(F.ceil(F.col("rows") / PAIRS), F.lit(1)).cast("int")
    dealt = pairs.join(heavy, "a", "left").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), "b")
    hubs = counts.select("a").join(heavy, "a", "left").select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    need = dealt.unionByName(hubs.select(F.col("a").alias("id"), "a", "part", F.lit(None).cast("long").alias("b")))
    sides = texts.join(need.hint("merge"), "id").select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    links = stored(sides.mapInArrow(_confirmed, "a long, b long"), "links")
    discard(counts)
    return links


def _star(label: DataFrame) -> DataFrame:
    return label.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))


def _sets(signed: DataFrame) -> DataFrame:
    """digest, id (the least with that shingle set), n, bands and rows of each distinct set: an aggregate that combines on the map side."""
    named = signed.where("digest is not null and id is not null")
    return stored(named.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows")), "sets")


def link(docs: DataFrame, reps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) of the distinct shingle sets' representatives that link with another."""
    buckets = _buckets(reps)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = stored(texts.join(buckets.select("id").distinct().hint("merge"), "id"), "texts")
    label = None
    for propose in (lambda: stored(_first_stars(buckets), "pairs"), lambda: _prefix_pairs(_open(buckets, label), texts)):
        pairs = propose()
        good = _confirm(pairs, texts)
        discard(pairs)
        if not good.isEmpty():
            old = label
            label = components(good if old is None else good.unionByName(_star(old)))
            if old is not None:
                discard(old)
        discard(good)
    discard(buckets)
    discard(texts)
    return label if label is not None else docs.sparkSession.createDataFrame([], "id long, component long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept (doc_id = component_id), a row for each of ``docs``.

    Nulls: a null text is empty; a row whose id is null links with nothing, has a null component and is kept. Empty texts and
    texts without words have no shingles and are their own component. Repeated rows: rows of one id count as one document, linked
    with whatever any of them links with. Ties: the smallest id. An empty table gives no rows; other columns of ``docs`` aren't
    read, and texts of any length count whole. The result is a table in the shared folder; those made on the way are deleted before it is returned.
    """
    prepare(docs.sparkSession)
    signed = stored(signatures(docs, id_col, text_col), "signatures")
    sets = _sets(signed)
    label = link(docs, sets, id_col, text_col)
    # copies of one set and rows of one id hang together as well; the few sets with very many rows are sent to them, so no task has all copies of one
    reps, rows = sets.where("rows > 1").select("digest", F.col("id").alias("rep"), "rows"), signed.select("id", "digest").where("id is not null")
    heavy = stored(_heavy(reps, "digest", signed.count()), "heavy").select("digest")
    of_heavy = rows.join(F.broadcast(reps.join(F.broadcast(heavy), "digest")), "digest")
    of_others = rows.join(F.broadcast(heavy), "digest", "left_anti").join(reps.join(F.broadcast(heavy), "digest", "left_anti"), "digest")
    copies = of_others.unionByName(of_heavy).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    copies = stored(copies, "copies")
    many = copies.join(label.select(F.col("id").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    own = label.select(F.col("id").alias("b"), "component").union(many.select("b", "component")).union(many.select("a", "component")).groupBy("b").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    own = stored(own, "components")
    if own.where("lo < hi").isEmpty():  # as a rule: no id is in two groups
        named = own.select(F.col("b").alias("id"), F.col("lo").alias("component"))
    else:
        named = components(stored(_star(label).union(copies), "links"))
    component = F.coalesce("component", "id")
    out = signed.select("id", "n").join(named, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    out = stored(out, "classes")
    for made in (signed, sets, copies, own):
        discard(made)
    return out
