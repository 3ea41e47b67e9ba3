"""Queries over relational tables: references, logs, coverage, publication order, accounts, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import decisions, integrity, ocr, packages, publishing, rendering, spatial, structure
from . import gates
from .common import padded_sql, query, table, values


@query(
    """SELECT 'customer' AS relation, count(*) AS orphans, min(o_orderkey) AS first_key FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 5 <> 0)
UNION ALL SELECT 'orders', count(*), min(l_orderkey) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 7 <> 0)
UNION ALL SELECT 'documents', count(*), min(doc_id) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 3 <> 0)"""
)
def q10_fk_orphans(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    found = [("customer", t("orders"), "o_custkey", t("customer").where("c_custkey % 5 <> 0"), "c_custkey", "o_orderkey"), ("orders", t("lineitem"), "l_orderkey", t("orders").where("o_orderkey % 7 <> 0"), "o_orderkey", "l_orderkey"), ("documents", t("labels"), "doc_id", t("documents").where("doc_id % 3 <> 0"), "doc_id", "doc_id")]
    parts = [integrity.orphans(c, k, p, pk).agg(F.count("*").alias("orphans"), F.min(own).alias("first_key")).select(F.lit(name).alias("relation"), "orphans", "first_key") for name, c, k, p, pk, own in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT conv_id, count(*) AS n, min(turn) AS lo, max(turn) AS hi, count(*) = count(DISTINCT turn) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS contiguous FROM conversations WHERE NOT (conv_id % 10 = 3 AND turn = 1) GROUP BY conv_id")
def q12_surface_accounting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("not (conv_id % 10 = 3 and turn = 1)")
    return integrity.contiguous(rows, "conv_id", "turn")


@query(gates.REPORT_SQL)
def q19_gate_report(spark, sf_dir):
    return gates.report(spark, sf_dir).select("check_id", "passed", "n_observed", "first_observed")


@query(
    f"""WITH c AS (SELECT * FROM ({gates.REPORT_SQL}))
SELECT target, count_if(NOT passed AND (blocks OR target = 'citation'))::BIGINT AS failed, CASE WHEN count_if(NOT passed AND (blocks OR target = 'citation')) > 0 THEN 'FAIL_REVIEW' WHEN target = 'hint' THEN 'HINT_READY' WHEN target = 'review' THEN 'REVIEW_READY' ELSE 'PASS_STRICT' END AS status
FROM c JOIN {values([(k, b) for k, b in gates.BLOCKS.items()], "check_id, blocks")} USING (check_id), {values([("hint",), ("review",), ("citation",)], "target").replace(" AS v(", " AS w(")} GROUP BY target"""
)
def q20_hint_vs_citation(spark, sf_dir):
    checks = gates.report(spark, sf_dir)
    return publishing.verdicts(checks, ("hint", "review", "citation"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def q21_latest_decision(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return decisions.latest(log, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def q22_active_set(spark, sf_dir):
    live = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return decisions.active(log, ["user_id", "event_type"], ["ts", "event_id"], live, "user_id").select("user_id", "event_type", "event_id")


_CHAIN_SQL = """WITH e AS (SELECT user_id, event_id, ts, event_type AS content, coalesce(lag(event_id) OVER w, -1) AS p, lag(event_type) OVER w AS pc, lag(event_id, 2) OVER w AS pp FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT *, sha256('link|' || user_id || '|' || p) AS prev_hash, CASE WHEN event_id % 97 = 0 THEN 'broken' ELSE sha256(sha256('link|' || user_id || '|' || p) || '|' || content) END AS own_hash FROM e)"""


@query(
    _CHAIN_SQL
    + """ SELECT user_id, event_id, prev_hash = coalesce(lag(own_hash) OVER w, sha256('link|' || user_id || '|-1')) AS linked, own_hash = sha256(prev_hash || '|' || content) AS intact FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def q23_hash_chain(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    prev = ids.sha256(F.concat_ws("|", F.lit("link"), "user_id", F.coalesce(F.lag("event_id").over(w), F.lit(-1))))
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("content"), prev.alias("prev_hash"))
    own = F.when(F.col("event_id") % 97 == 0, "broken").otherwise(ids.sha256(F.concat_ws("|", "prev_hash", "content")))
    genesis = ids.sha256(F.concat_ws("|", F.lit("link"), "user_id", F.lit(-1)))
    return decisions.verify_chain(log.withColumn("own_hash", own), "user_id", ["ts", "event_id"], "content", "prev_hash", "own_hash", genesis).select("user_id", "event_id", "linked", "intact")


@query("SELECT disposition, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'gap' WHEN quality = 1 AND toxic = 0 THEN 'used' ELSE 'excluded' END AS disposition FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY disposition")
def q24_coverage(spark, sf_dir):
    disposition = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "used").otherwise("excluded")
    rows = decisions.coverage(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id", disposition)
    return rows.groupBy("disposition").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""SELECT event_id, prior, prior IS NULL OR event_id % 13 <> 0 AS valid FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prior FROM events)""")
def q25_supersession(spark, sf_dir):
    from pyspark.sql import Window

    prior = F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    log = table(spark, sf_dir, "events").withColumn("supersedes", F.when(F.col("event_id") % 13 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array(prior)))
    return decisions.supersession(log, ["user_id", "event_type"], ["ts", "event_id"], "event_id", "supersedes").select("event_id", "prior", "valid")


@query("SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' WHEN length(text) < 30 THEN 'text' ELSE 'order' END AS finding FROM conversations WHERE role NOT IN ('user', 'assistant') OR length(text) < 30 OR (turn = 0 AND role = 'assistant')")
def q26_paragraph_integrity(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    finding = F.when(~F.col("role").isin("user", "assistant"), "role").when(F.length("text") < 30, "text").when((F.col("turn") == 0) & (F.col("role") == "assistant"), "order")
    return rows.select("conv_id", "turn", finding.alias("finding")).where("finding is not null")


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) GROUP BY lang")
def q30_used_selection(spark, sf_dir):
    decided = table(spark, sf_dir, "labels").withColumn("disposition", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "used").otherwise("excluded"))
    rows = publishing.selected(table(spark, sf_dir, "documents"), decided, "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT l_partkey, l_orderkey AS first_order, uses FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_partkey) AS uses FROM lineitem) WHERE k = 1")
def q31_exactly_once(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return integrity.claims(uses, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", F.col("l_orderkey").alias("first_order"), "uses")


@query(
    """WITH c AS (SELECT c_custkey, [r_name, n_name, c_mktsegment] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT c_custkey, path[1:d] AS prefix FROM c, generate_series(1, 3) AS g(d))
SELECT regexp_replace(prefix[-1], '\\s+\\[[A-Za-z0-9_.-]+\\]$', '') AS heading, least(3, len(prefix) + 1)::INT AS level, array_to_string(prefix, '/') AS path, min(c_custkey) AS c_custkey FROM p GROUP BY prefix"""
)
def q32_heading_emission(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return structure.heading_emission(rows.select("c_custkey", F.array("r_name", "n_name", "c_mktsegment").alias("path")), "path", ["c_custkey"])


@query("SELECT uses, count(*) AS parts FROM (SELECT p_partkey, count(l_partkey) AS uses FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 40 GROUP BY p_partkey) GROUP BY uses")
def q33_reference_counts(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_partkey")
    return integrity.reference_counts(table(spark, sf_dir, "part"), "p_partkey", uses, "l_partkey").groupBy("uses").agg(F.count("*").alias("parts"))


@query(
    """WITH s AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS k FROM (SELECT DISTINCT c_mktsegment FROM customer)),
n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation),
c AS (SELECT n_regionkey, n_name, r, k, count(c_custkey) AS v FROM n CROSS JOIN s LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.c_mktsegment GROUP BY ALL),
h AS (SELECT string_agg(c_mktsegment, ' | ' ORDER BY k) AS names, string_agg('---', ' | ') AS rules FROM s),
l AS (SELECT n_regionkey, r, '| ' || n_name || ' | ' || string_agg(CASE WHEN v = 0 THEN '' ELSE v::VARCHAR END, ' | ' ORDER BY k) || ' |' AS line FROM c GROUP BY n_regionkey, r, n_name)
SELECT n_regionkey AS object_id, '**' || r_name || '**' || chr(10) || chr(10) || '| nation | ' || names || ' |' || chr(10) || '| --- | ' || rules || ' |' || chr(10) || string_agg(line, chr(10) ORDER BY r) AS markdown
FROM l JOIN region ON r_regionkey = n_regionkey, h GROUP BY n_regionkey, r_name, names, rules"""
)
def q34_table_markdown(spark, sf_dir):
    from pyspark.sql import Window

    t = lambda n: table(spark, sf_dir, n)
    segments = t("customer").select("c_mktsegment").distinct().withColumn("column", F.row_number().over(Window.orderBy("c_mktsegment")))
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("row", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")))
    counts = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("string").alias("text"))
    cell = lambda df, row, column, value, tag: df.select(F.col("n_regionkey").alias("object_id"), row.cast("int").alias("row"), column.cast("int").alias("column"), F.lit(tag).alias("tag"), value.alias("text"), F.lit(None).cast("string").alias("container"), F.lit(0).alias("ordinal"), F.col("r_name").alias("caption"))
    regions = nations.select("n_regionkey", "r_name").distinct()
    cells = cell(counts.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(segments, "c_mktsegment"), F.col("row"), F.col("column"), F.col("text"), "td")
    cells = cells.unionByName(cell(nations, F.col("row"), F.lit(0), F.col("n_name"), "td")).unionByName(cell(regions, F.lit(0), F.lit(0), F.lit("nation"), "th"))
    names = segments.agg(F.collect_list(F.struct("column", "c_mktsegment")).alias("names")).withColumn("one", F.lit(1))
    heads = regions.withColumn("one", F.lit(1)).join(names, "one").select("n_regionkey", "r_name", F.inline("names"))
    cells = cells.unionByName(cell(heads, F.lit(0), F.col("column"), F.col("c_mktsegment"), "th"))
    return rendering.table_markdown(cells)


ODD_LINKS = [(-1, "mailto:a@b.c"), (-2, "HTTP://x.y/a(b)c))"), (-3, "https://x.y/(a)"), (-4, "#top"), (-5, "a/b?c=d#e"), (-6, " https://x.y) ")]


@query(
    rf"""WITH h AS (SELECT page_id, url AS href FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages UNION ALL SELECT p, h FROM {values(ODD_LINKS, "p, h")}),
t AS (SELECT page_id, trim(href) AS href FROM h), r AS (SELECT page_id, substr(href, 1, (length(href) - greatest(0, least((length(href) - length(replace(href, ')', ''))) - (length(href) - length(replace(href, '(', ''))), length(href) - length(regexp_replace(href, '\)+$', '')))))::BIGINT) AS href FROM t)
SELECT regexp_matches(href, '(?i)^(https?|mailto):') AS external, contains(href, '?') AS has_query, contains(href, '#') AS has_fragment, count(*) AS n, min(href) AS first_href, max(length(href))::BIGINT AS longest FROM r GROUP BY ALL"""
)
def q35_link_kinds(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hrefs = pages.select("page_id", F.col("url").alias("href")).unionByName(pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")))
    hrefs = hrefs.unionByName(spark.createDataFrame(ODD_LINKS, "page_id long, href string")).select("page_id", text.repair_href(F.col("href")).alias("href"))
    by = hrefs.groupBy(text.is_external(F.col("href")).alias("external"), F.contains("href", F.lit("?")).alias("has_query"), F.contains("href", F.lit("#")).alias("has_fragment"))
    return by.agg(F.count("*").alias("n"), F.min("href").alias("first_href"), F.max(F.length("href")).cast("long").alias("longest"))


#: Units whose numbers are longer than names are filled up to; the second of each pair repeats if names cut them.
LONG_UNITS = [(1234567, 1), (12345678, 0), (5, 123456), (5, 12345)]


@query(
    f"""WITH u AS (SELECT 'c' || {padded_sql("conv_id", 6)} || '_u' || {padded_sql("turn + 1", 4)} AS unit_id, conv_id, turn FROM (SELECT conv_id, turn FROM conversations UNION ALL SELECT c, t FROM {values(LONG_UNITS, "c, t")})),
g AS (SELECT unit_id FROM u WHERE NOT (conv_id % 17 = 4 AND turn = 1) UNION ALL SELECT unit_id FROM u WHERE conv_id % 23 = 5 AND turn = 0 UNION ALL SELECT unit_id || 'x' FROM u WHERE conv_id % 29 = 6 AND turn = 0),
a AS (SELECT unit_id, count(*) AS e FROM u GROUP BY 1), b AS (SELECT unit_id, count(*) AS g FROM g GROUP BY 1)
SELECT unit_id, coalesce(e, 0) AS expected, coalesce(g, 0) AS given, CASE WHEN g IS NULL THEN 'missing' WHEN e IS NULL THEN 'extra' ELSE 'duplicate' END AS finding FROM a FULL JOIN b USING (unit_id) WHERE e IS DISTINCT FROM g"""
)
def q43_unit_reconcile(spark, sf_dir):
    unit = F.concat(F.lit("c"), ids.padded(F.col("conv_id"), 6), F.lit("_u"), ids.padded(F.col("turn") + 1, 4))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").unionByName(spark.createDataFrame(LONG_UNITS, "conv_id long, turn int"))
    units = turns.select(unit.alias("unit_id"), "conv_id", "turn")
    given = units.where("not (conv_id % 17 = 4 and turn = 1)").unionByName(units.where("conv_id % 23 = 5 and turn = 0")).unionByName(units.where("conv_id % 29 = 6 and turn = 0").withColumn("unit_id", F.concat("unit_id", F.lit("x"))))
    return integrity.reconcile(units.select("unit_id"), given.select("unit_id"), "unit_id")


@query("SELECT count(*) AS selected, count_if(n_chars <= 5000)::BIGINT AS completed, count_if(n_chars > 5000)::BIGINT AS failed, 0::BIGINT AS cancelled, CASE WHEN count_if(n_chars > 5000) = 0 THEN 'complete' WHEN count_if(n_chars <= 5000) = 0 THEN 'failed' ELSE 'partial' END AS status FROM documents")
def q45_batch_accounting(spark, sf_dir):
    rows = packages.guarded(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars") <= 5000, F.lit("too long"))
    return packages.batch_summary(rows)


@query("SELECT i AS missing FROM generate_series(1, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 9 <> 4 AND o_orderkey % 100 > 2)) AS g(i) WHERE i NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 4 AND o_orderkey % 100 > 2)")
def q47_coverage_gap(spark, sf_dir):
    return integrity.missing_indexes(table(spark, sf_dir, "orders").where("o_orderkey % 9 <> 4 and o_orderkey % 100 > 2"), "o_orderkey")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE turn = 0")
def q48_first_per_chunk(spark, sf_dir):
    return packages.first_per_chunk(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query(
    """WITH i AS (SELECT l_orderkey AS page_id, l_linenumber AS id, l_quantity * 10 AS bottom FROM lineitem WHERE l_linenumber % 2 = 1), c AS (SELECT l_orderkey AS page_id, l_linenumber AS id, l_quantity * 10 + l_discount * 100 AS top FROM lineitem WHERE l_linenumber % 2 = 0),
p AS (SELECT i.page_id, i.id AS image_id, c.id AS caption_id, abs(top - bottom) AS distance FROM i JOIN c USING (page_id) WHERE top >= bottom - 12 AND abs(top - bottom) <= 180)
SELECT page_id, image_id, caption_id, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY page_id, image_id ORDER BY distance, caption_id) AS k FROM p) WHERE k = 1"""
)
def q50_caption_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    images = rows.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("id"), (F.col("l_quantity") * 10).alias("bottom"))
    captions = rows.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("id"), (F.col("l_quantity") * 10 + F.col("l_discount") * 100).alias("top"))
    return spatial.nearest_following(images, captions).withColumn("distance", F.round("distance", 4))


@query(
    """WITH RECURSIVE b AS (SELECT l_orderkey // 8 AS page_id, l_orderkey * 10 + l_linenumber AS id, l_quantity * 12 AS x, l_partkey % 400 AS y, 20 + l_discount * 200 AS w FROM lineitem),
e AS (SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.page_id = q.page_id AND p.id <> q.id AND least(p.x + p.w, q.x + q.w) > greatest(p.x, q.x) AND least(p.y + 15, q.y + 15) > greatest(p.y, q.y)),
r(a, b) AS (SELECT id, id FROM b UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT page_id, id, component FROM b JOIN (SELECT a AS id, min(b) AS component FROM r GROUP BY a) USING (id)"""
)
def q51_components(spark, sf_dir):
    """Overlapping boxes of all of lineitem, 8 orders a page, so that pages grow with the table."""
    x, y, w = F.col("l_quantity") * 12, (F.col("l_partkey") % 400).cast("double"), 20 + F.col("l_discount") * 200
    boxes = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("page_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(x, y, x + w, y + 15).alias("box"))
    return spatial.overlap_groups(boxes)


@query("SELECT l_orderkey, round(sum(l_discount * l_quantity) FILTER (l_discount > 0.02) / sum(l_quantity) FILTER (l_discount > 0.02), 8) AS confidence, count(*) AS words FROM lineitem GROUP BY l_orderkey")
def q52_line_confidence(spark, sf_dir):
    sure = F.when(F.col("l_discount") > 0.02, F.col("l_discount")).otherwise(-1.0)
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(ocr.weighted_confidence(sure, F.col("l_quantity")), 8).alias("confidence"), F.count("*").alias("words"))
    return by


CELLS = [(1, 0, 0, "th", "A|B", None, 1, "Cap"), (1, 0, 1, "th", "x", None, 2, "Cap"), (1, 1, 1, "td", "one ", "one two", 3, "Cap"), (1, 1, 1, "td", "two", "one two", 4, "Cap"), (1, 1, 1, "td", "three", "three", 5, "Cap"), (2, 0, 0, "td", "a\nb", None, 1, None), (2, 2, 1, "td", "z", None, 2, None)]


@query("SELECT * FROM (VALUES (1, '**Cap**' || chr(10) || chr(10) || '| A\\|B | x |' || chr(10) || '| --- | --- |' || chr(10) || '|  | one two three |'), (2, '| Column 1 | Column 2 |' || chr(10) || '| --- | --- |' || chr(10) || '| a<br>b |  |' || chr(10) || '|  |  |' || chr(10) || '|  | z |')) AS v(object_id, markdown)")
def q53_cell_fragments(spark, sf_dir):
    return rendering.table_markdown(spark.createDataFrame(CELLS, "object_id int, row int, column int, tag string, text string, container string, ordinal int, caption string"))


WORDS = [(5, 1, 1, 1, 1, 1, 10.0, 20.0, 30.0, 10.0, 90.0, "Fig.", 0), (5, 1, 1, 1, 1, 2, 45.0, 20.0, 20.0, 10.0, 80.0, "43", 1), (5, 1, 1, 1, 2, 1, 10.0, 40.0, 50.0, 9.0, 70.0, "Caption", 2), (4, 1, 1, 1, 2, 0, 0.0, 0.0, 5.0, 5.0, -1.0, "skip", 3), (5, 1, 1, 1, 2, 2, 70.0, 40.0, 20.0, 9.0, -1.0, "unsure", 4)]


@query("SELECT * FROM (VALUES ('Fig. 43', '10.0,20.0,65.0,30.0', round((90 * 4 + 80 * 2) / (100.0 * 6), 6)::DOUBLE, 0), ('Caption unsure', '10.0,40.0,90.0,49.0', 0.7::DOUBLE, 2)) AS v(text, box, confidence, first_ordinal)")
def q54_recognised_lines(spark, sf_dir):
    words = spark.createDataFrame(WORDS, "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string, ordinal int")
    return ocr.lines_from_words(words).select("text", F.array_join(F.transform("box", lambda x: x.cast("string")), ",").alias("box"), F.round("confidence", 6).alias("confidence"), "first_ordinal")


ITEMS = [(1, None, 1, "1 One"), (2, 1, 2, "1.1 Sub"), (3, 2, 3, "1.1.1 Deep"), (4, 9, 2, "2.1 Lost"), (5, None, 2, "Bare"), (6, 3, 3, "3.2.1 Wrong"), (7, 1, 2, "2.1 Other")]


@query("SELECT * FROM (VALUES (4, 'parent_missing'), (4, 'numbered'), (5, 'parent_required'), (6, 'parent_not_above'), (6, 'numbered'), (7, 'numbered')) AS v(toc_id, finding)")
def q55_toc_tree(spark, sf_dir):
    from ..operators import graph

    items = spark.createDataFrame(ITEMS, "toc_id int, parent_id int, level int, title string")
    return graph.tree_findings(items).unionByName(structure.numbered_findings(items).select("toc_id", F.lit("numbered").alias("finding")))


@query(
    """WITH e AS (SELECT conv_id, turn, (conv_id * 3 + turn * 5) % 4 AS depth FROM conversations)
SELECT conv_id, turn, depth, (SELECT max(p.turn) FROM e p WHERE p.conv_id = e.conv_id AND p.turn < e.turn AND p.depth = e.depth - 1 AND NOT EXISTS (SELECT 1 FROM e c WHERE c.conv_id = e.conv_id AND c.turn > p.turn AND c.turn < e.turn AND c.depth < e.depth - 1)) AS parent FROM e"""
)
def q56_parents_by_depth(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("conv_id") * 3 + F.col("turn") * 5) % 4).alias("depth"))
    return structure.parents_by_depth(rows, "conv_id", "turn", "depth", "turn")


@query("SELECT o_custkey, o_orderkey, n_name AS path FROM (SELECT o_custkey, o_orderkey, o_orderkey % 40 AS at FROM orders) o ASOF LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0) n ON o.at >= n.n_nationkey")
def q57_path_at(spark, sf_dir):
    """All orders as points, a page a customer, each with all paths; every third nation begins a path, so that points fall between them."""
    orders = table(spark, sf_dir, "orders")
    points = orders.select(F.col("o_custkey").alias("page_id"), F.array((F.col("o_orderkey") % 40).cast("int")).alias("dom_path"), F.col("o_orderkey").alias("id"))
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("all_"))  # one row, of a fixed table
    paths = orders.select(F.col("o_custkey").alias("page_id")).distinct().join(nations, F.lit(True)).select("page_id", F.inline("all_"))
    paths = paths.select("page_id", F.array(F.col("n_nationkey").cast("int")).alias("dom_path"), F.col("n_name").alias("path"))
    return structure.path_at(paths, points).select(F.col("page_id").alias("o_custkey"), F.col("id").cast("long").alias("o_orderkey"), "path")
