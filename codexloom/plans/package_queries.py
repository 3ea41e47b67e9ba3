"""Queries over a package made of the tables: its checks, objects, placement, digests and heads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import acceptance, ledger, objects, ocr, packages, publishing, rendering, runs, structure
from .common import BLOCKS_SQL, EVIDENCE_SQL, LINES_SQL, PARAGRAPHS_SQL, padded_sql, query, table, values

CHECKED = ("evidence_surface_foreign_keys", "asset_surface_foreign_keys", "spine_surface_accounting", "page_extraction", "canonical_reverse_mapping", "manual_page_review", "paragraph_source_span_anchor_integrity", "canonical_block_disposition_coverage", "canonical_block_single_disposition", "no_mock_evidence", "semantic_reviewer_provenance", "asset_occurrence_accounting")


@query(
    f"""WITH e AS (SELECT *, CASE WHEN doc_id % 31 = 7 THEN 'mock_ocr' ELSE 'text_native' END AS engine FROM ({EVIDENCE_SQL})),
s AS (SELECT 'document_' || {padded_sql('doc_id', 8)} AS page_id, doc_id + 1 AS ordinal, CASE WHEN n_chars < 200 THEN 'unresolved' ELSE 'extracted' END AS status, doc_id FROM documents WHERE doc_id % 41 <> 5),
c AS (SELECT block_id, page_id, evidence_id, doc_id, ordinal, CASE WHEN doc_id % 37 = 3 AND ordinal = 1 THEN text || '!' ELSE text END AS text, text AS raw FROM ({BLOCKS_SQL})),
p AS (SELECT block_id, ordinal, doc_id, CASE WHEN ordinal % 50 = 4 THEN length(text) + 3 WHEN ordinal % 50 = 5 THEN greatest(0, length(text) - 1) ELSE length(text) END AS e, length(text) AS n FROM c),
l AS (SELECT 'document_' || {padded_sql('doc_id', 8)} AS page_id, quality FROM labels),
f AS (SELECT 'evidence_surface_foreign_keys' AS check_id, evidence_id AS v FROM e WHERE page_id NOT IN (SELECT page_id FROM s)
UNION ALL SELECT 'asset_surface_foreign_keys', url FROM pages WHERE 'document_' || {padded_sql('page_id', 8)} NOT IN (SELECT page_id FROM s)
UNION ALL SELECT 'spine_surface_accounting', i::VARCHAR FROM generate_series(1, (SELECT max(ordinal) FROM s)) AS g(i) WHERE i NOT IN (SELECT ordinal FROM s)
UNION ALL SELECT 'page_extraction', page_id FROM s WHERE status = 'unresolved'
UNION ALL SELECT 'canonical_reverse_mapping', block_id FROM c WHERE text <> raw
UNION ALL SELECT 'manual_page_review', page_id FROM s WHERE page_id NOT IN (SELECT page_id FROM l)
UNION ALL SELECT 'paragraph_source_span_anchor_integrity', block_id FROM p WHERE e > n
UNION ALL SELECT 'canonical_block_disposition_coverage', block_id FROM p WHERE e < n
UNION ALL SELECT 'canonical_block_single_disposition', block_id FROM p WHERE e > n
UNION ALL SELECT 'no_mock_evidence', evidence_id FROM e WHERE engine = 'mock_ocr'
UNION ALL SELECT 'semantic_reviewer_provenance', page_id FROM l WHERE quality = 0
UNION ALL SELECT 'asset_occurrence_accounting', url FROM pages)
SELECT check_id, count(*) = 0 AS passed, count(*) AS n_observed FROM f GROUP BY check_id"""
)
def q58_package_checks(spark, sf_dir):
    docs, labels, pages = (table(spark, sf_dir, n) for n in ("documents", "labels", "pages"))
    page = ledger.page_name(F.col("doc_id"))
    surfaces = docs.where("doc_id % 41 <> 5").select(page.alias("page_id"), (F.col("doc_id") + 1).alias("ordinal"), F.when(F.col("n_chars") < 200, "unresolved").otherwise("extracted").alias("status"))
    seen = ledger.evidence(ledger.lines(docs))
    blocks = ledger.canonical(seen).withColumn("canonical_disposition", F.lit(None).cast("string"))
    blocks = blocks.withColumn("text", F.when((F.col("doc_id") % 37 == 3) & (F.col("ordinal") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    size = F.length("text")
    end = F.when(F.col("ordinal") % 50 == 4, size + 3).when(F.col("ordinal") % 50 == 5, F.greatest(F.lit(0), size - 1)).otherwise(size)
    spans = blocks.select(F.col("block_id").alias("paragraph_id"), "block_id", F.lit(0).alias("span_start"), end.alias("span_end"))
    log = labels.select(F.col("doc_id").alias("seq"), F.lit("page").alias("kind"), page.alias("target_id"), F.lit("accepted").alias("disposition"), F.when(F.col("quality") != 0, "someone").alias("reviewer"))
    t = {
        "surfaces": surfaces, "evidence": seen.withColumn("engine", F.when(F.col("doc_id") % 31 == 7, "mock_ocr").otherwise(F.col("engine"))), "canonical": blocks, "spans": spans, "decisions": log,
        "assets": pages.select(F.col("url").alias("occurrence_id"), ledger.page_name(F.col("page_id")).alias("page_id")),
    }
    return acceptance.evaluate(t, "citation", CHECKED).select("check_id", "passed", "n_observed")


@query(
    """WITH b AS (SELECT l_orderkey AS page_id, l_partkey % 3 AS figure, l_linenumber AS rank, l_quantity AS x, l_discount * 100 AS y, 'o' || l_orderkey || '_' || l_linenumber AS occ FROM lineitem)
SELECT page_id, figure, string_agg(occ, '|' ORDER BY rank) AS occurrences, min(x) AS x0, min(y) AS y0, max(x + 10) AS x1, max(y + 5) AS y1 FROM b GROUP BY page_id, figure"""
)
def q59_figure_groups(spark, sf_dir):
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    occ = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    assets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") % 3).cast("string").alias("figure"), F.col("l_linenumber").alias("rank"), occ.alias("occurrence_id"), F.array(x, y, x + 10, y + 5).alias("box"))
    none = spark.createDataFrame([], "page_id long, figure string, text string, evidence_id string, ordinal int, block_kind string")
    keyed = assets.select("page_id", "figure", "rank", "occurrence_id", "box")
    by = objects.figures(keyed, none)
    names = keyed.select(objects.object_id("figure", "page_id", "figure").alias("object_id"), "figure").distinct()
    b = F.col("box")
    return by.join(names, "object_id").select("page_id", F.col("figure").cast("long").alias("figure"), F.array_join("asset_occurrence_ids", "|").alias("occurrences"), b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1"))


@query(
    """WITH i AS (SELECT l_orderkey AS page_id, l_linenumber AS rank FROM lineitem WHERE l_partkey % 3 = 0), a AS (SELECT l_orderkey AS page_id, l_linenumber AS rank FROM lineitem WHERE l_partkey % 3 = 1)
SELECT page_id, rank AS image, coalesce((SELECT max(a.rank) FROM a WHERE a.page_id = i.page_id AND a.rank <= i.rank), (SELECT min(a.rank) FROM a WHERE a.page_id = i.page_id AND a.rank > i.rank)) AS anchor FROM i"""
)
def q60_image_placement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("rank"), "l_partkey")
    placed = objects.placed_after(rows.where("l_partkey % 3 = 0"), rows.where("l_partkey % 3 = 1"))
    return placed.select("page_id", F.col("image_id").cast("int").alias("image"), F.col("anchor_id").cast("int").alias("anchor"))


@query(
    """WITH r AS (SELECT l_orderkey AS page_id, l_linenumber AS ord, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey END AS rank FROM lineitem),
h AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS slot, row_number() OVER (PARTITION BY page_id ORDER BY rank, ord) AS place FROM r WHERE rank IS NOT NULL)
SELECT page_id, ord, ord AS new_order FROM r WHERE rank IS NULL UNION ALL SELECT m.page_id, m.ord, s.ord FROM h m JOIN h s ON m.page_id = s.page_id AND m.place = s.slot"""
)
def q61_asset_slots(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("order"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_suppkey")).alias("asset_rank"))
    return objects.within_slots(rows).select("page_id", F.col("order").alias("ord"), "new_order")


ODD_NAMES = [(-1, 'tab\there "quoted" back\\slash', "A\nB"), (-2, "bell\x07 form\x0c end\r\n", "é 中"), (-3, "", "\x11")]


@query(f"""SELECT c_custkey, sha256('{{"c_custkey": ' || c_custkey || ', "c_mktsegment": ' || to_json(c_mktsegment)::VARCHAR || ', "c_name": ' || to_json(c_name)::VARCHAR || '}}') AS row_hash FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT * FROM {values(ODD_NAMES, "k, n, s")})""")
def q62_canonical_json(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").unionByName(spark.createDataFrame(ODD_NAMES, "c_custkey long, c_name string, c_mktsegment string"))
    return rows.select("c_custkey", runs.canonical_hash(rows, ["c_name", "c_custkey", "c_mktsegment"]).alias("row_hash"))


@query(
    f"""WITH n AS (SELECT doc_id, count(*) AS assigned FROM ({LINES_SQL}) WHERE ordinal % 4 <> 0 GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS total, sum(length(text))::BIGINT AS chars FROM ({LINES_SQL}) GROUP BY doc_id)
SELECT source, count(*) AS documents, sum(total)::BIGINT AS blocks, sum(coalesce(assigned, 0))::BIGINT AS assigned, sum(chars)::BIGINT AS chars FROM a LEFT JOIN n USING (doc_id) JOIN documents USING (doc_id) GROUP BY source"""
)
def q63_chapter_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = ledger.lines(docs).groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("ordinal") % 4 != 0).alias("assigned"), F.sum(F.length("text")).alias("chars"))
    return own.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.sum("total").alias("blocks"), F.sum("assigned").alias("assigned"), F.sum("chars").alias("chars"))


@query(
    """SELECT page_id, alnum, image_coverage, NOT (alnum >= CASE WHEN image_coverage >= 0.5 THEN 8 ELSE 20 END) AS needs_ocr, image_coverage >= 0.12 AS mixed_visual, l >= 2 AND r >= 2 AS multi_column
FROM (SELECT l_orderkey AS page_id, sum(l_quantity)::BIGINT AS alnum, round(least(1.0, sum(l_discount)), 4)::DOUBLE AS image_coverage, count_if(l_quantity < 25) AS l, count_if(l_quantity >= 30) AS r FROM lineitem GROUP BY l_orderkey)"""
)
def q64_page_routes(spark, sf_dir):
    q = F.col("l_quantity")
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.sum(q).cast("long").alias("alnum"), F.round(F.least(F.lit(1.0), F.sum("l_discount")), 4).alias("image_coverage"), F.count_if(q < 25).alias("left_blocks"), F.count_if(q >= 30).alias("right_blocks"), F.lit(0.0).alias("lost_ratio"))
    return ocr.page_route(pages).select("page_id", "alnum", "image_coverage", "needs_ocr", "mixed_visual", "multi_column")


@query(
    f"""SELECT doc_id, '---' || chr(10) || 'source: ' || doc_id || chr(10) || '---' || chr(10) || chr(10) || '# Corpus' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY ordinal) || chr(10) AS markdown FROM ({PARAGRAPHS_SQL}) GROUP BY doc_id"""
)
def q65_markdown_export(spark, sf_dir):
    rows = ledger.paragraphs(ledger.canonical(ledger.evidence(ledger.lines(table(spark, sf_dir, "documents")))))
    return publishing.markdown(rows, "Corpus")


@query(
    f"""WITH r AS (SELECT doc_id, ordinal, text, block_id FROM ({BLOCKS_SQL})), m AS (SELECT *, CASE WHEN ordinal BETWEEN 3 AND 5 THEN doc_id END AS obj FROM r)
SELECT doc_id, ordinal AS "order", text, NULL::BIGINT AS object_id FROM m WHERE obj IS NULL UNION ALL SELECT doc_id, min(ordinal), string_agg(text, ' / ' ORDER BY ordinal), obj FROM m WHERE obj IS NOT NULL GROUP BY doc_id, obj"""
)
def q66_collapsed_members(spark, sf_dir):
    blocks = ledger.canonical(ledger.evidence(ledger.lines(table(spark, sf_dir, "documents"))))
    rows = blocks.select("block_id", F.col("ordinal").alias("order"), "text", "doc_id")
    members = blocks.where("ordinal between 3 and 5").select(F.col("doc_id").cast("string").alias("object_id"), "block_id")
    made = rows.where("order between 3 and 5").groupBy(F.col("doc_id").cast("string").alias("object_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), " / ").alias("markdown"))
    # blocks are unique by document, place and text; the object's row stands at its first member
    out = rendering.collapse_members(rows.drop("doc_id"), members, made).join(rows.select("block_id", "doc_id"), "block_id")
    return out.select("doc_id", "order", "text", F.col("object_id").cast("long").alias("object_id"))


@query(
    """SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) > 1 AS shared, CASE WHEN p_size >= 30 THEN 'book' ELSE 'paper' END AS document_kind FROM part"""
)
def q67_document_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    shared = rows.groupBy("p_name").agg((F.count("*") > 1).alias("shared"))
    return rows.join(shared, "p_name").select("p_partkey", "p_name", "shared", packages.document_kind(F.lit("auto"), F.lit("pdf"), F.col("p_size")).alias("document_kind"))


@query(
    """WITH i AS (SELECT c_custkey, [r_name, n_name, c_mktsegment][1:1 + c_custkey % 3] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT path FROM i WHERE c_custkey % 50 = 2)
SELECT c_custkey, array_to_string(path, '/') AS path FROM i WHERE EXISTS (SELECT 1 FROM s WHERE s.path[1:len(i.path)] = i.path)"""
)
def q68_published_items(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = rows.select("c_custkey", F.slice(F.array("r_name", "n_name", "c_mktsegment"), F.lit(1), (F.col("c_custkey") % 3 + 1).cast("int")).alias("structure_path"))
    return structure.published_items(items, items.where("c_custkey % 50 = 2")).select("c_custkey", F.array_join("structure_path", "/").alias("path"))


@query("SELECT user_id, count(*) AS events, bool_and(step IS NULL OR step >= 0) AS in_order, max(gap)::BIGINT AS longest_gap_s FROM (SELECT user_id, event_id - lag(event_id) OVER w AS step, floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER w))::BIGINT AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id")
def q69_log_order(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("step"), (seconds - F.lag(seconds).over(w)).alias("gap"))
    return rows.groupBy("user_id").agg(F.count("*").alias("events"), F.bool_and(F.col("step").isNull() | (F.col("step") >= 0)).alias("in_order"), F.max("gap").alias("longest_gap_s"))
