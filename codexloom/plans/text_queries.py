"""Queries over texts: ledgers, kinds, profiles, headings, secrets, Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import integrity, ledger, ordering, passages, rendering, structure
from ..sources import html
from .common import BLOCKS_SQL, EVIDENCE_SQL, LINES_SQL, LONG_IDS_SQL, PARAGRAPHS_SQL, query, table, values, with_long_ids


@query(f"SELECT doc_id, ordinal, evidence_id, sha256(text) AS text_sha256, length(text)::BIGINT AS n_chars FROM ({EVIDENCE_SQL.replace('FROM documents', 'FROM ' + LONG_IDS_SQL)})")
def q01_line_ledger(spark, sf_dir):
    rows = ledger.evidence(ledger.lines(with_long_ids(spark, table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "ordinal", "evidence_id", "text_sha256", F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, block_id, paragraph_id, ordinal AS \"order\", length(text)::BIGINT AS span_end FROM ({PARAGRAPHS_SQL.replace('FROM documents', 'FROM ' + LONG_IDS_SQL)})")
def q02_paragraph_ledger(spark, sf_dir):
    rows = ledger.paragraphs(ledger.canonical(ledger.evidence(ledger.lines(with_long_ids(spark, table(spark, sf_dir, "documents"))))))
    return rows.select("doc_id", "block_id", "paragraph_id", "order", "span_end")


KIND_SQL = r"""CASE WHEN tag = 'h1' OR regexp_matches(lower(t), '^(chapter|part|book|section)($|[^\p{L}\p{N}_])') OR regexp_matches(t, '^第[一二三四五六七八九十百0-9]+[章节部篇卷]') THEN 'heading_candidate'
  WHEN regexp_matches(t, '(?i)^(fig(ure)?|table|图|表)\s*[0-9一二三四五六七八九十.-]+') THEN 'caption_candidate' ELSE 'text_candidate' END"""

ODD_LINES = [(-1, 1, "Chapter 1 The start"), (-1, 2, "Part II"), (-1, 3, "Parté is one word"), (-1, 4, "Figure 3. A box"), (-1, 5, "第三章 开始"), (-1, 6, "图 2 说明"), (-1, 7, "# of shots"), (-1, 8, "---"), (-1, 9, ""), (-1, 10, "Sections are long"), (-1, 11, "Index")]


@query(
    f"""WITH rows AS (SELECT ordinal, text AS t, NULL AS tag FROM ({LINES_SQL}) UNION ALL SELECT n, t, NULL FROM {values(ODD_LINES, "d, n, t")}
  UNION ALL SELECT 0, trim(unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1))), 'h1' FROM pages)
SELECT kind, count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT t, {KIND_SQL.replace("lower(t)", "lower(trim(t))")} AS kind FROM rows) GROUP BY kind"""
)
def q03_block_kinds(spark, sf_dir):
    own = ledger.lines(table(spark, sf_dir, "documents")).select("text", F.lit(None).cast("string").alias("tag"))
    odd = spark.createDataFrame(ODD_LINES, "doc_id long, ordinal long, text string").select("text", F.lit(None).cast("string").alias("tag"))
    heads = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), 1)).alias("text")).select(F.trim("text").alias("text"), F.lit("h1").alias("tag"))
    rows = own.unionByName(odd).unionByName(heads)
    return rows.groupBy(text.block_kind(F.col("text"), F.col("tag")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT doc_id, ordinal, header_key, n AS occurrences FROM (SELECT doc_id, ordinal, lower(trim(text)) AS header_key, count(*) OVER (PARTITION BY lower(trim(text))) AS n FROM ({LINES_SQL})) WHERE n >= 3")
def q04_running_headers(spark, sf_dir):
    rows = ledger.lines(table(spark, sf_dir, "documents"))
    return ledger.running_headers(rows, F.col("text")).select("doc_id", "ordinal", "header_key", "occurrences")


_SECTION_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(title), '{w}')" for w in words) + f" THEN '{name}'" for name, words in text.SECTION_WORDS.items()) + r""" WHEN regexp_matches(lower(title), '^(part|book)\s+[ivxlcdm0-9]+($|[^\p{L}\p{N}_])') OR regexp_matches(title, '^第[一二三四五六七八九十百0-9]+[部篇卷]') THEN 'part_divider' ELSE 'body_chapter' END"""
ODD_TITLES = [(-1, "Part II The road"), (-2, "Title Page"), (-3, "第二部 归来"), (-4, "Subject Index"), (-5, "Footnotes"), (-6, "1. Introduction"), (-7, "Works Cited"), (-8, "part ii the road")]


@query(
    rf"""WITH t AS (SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS title FROM pages UNION ALL SELECT p, t FROM {values(ODD_TITLES, "p, t")}),
f AS (SELECT page_id, title, row_number() OVER (PARTITION BY lower(title) ORDER BY page_id) AS k FROM t WHERE title <> ''),
o AS (SELECT *, row_number() OVER (ORDER BY page_id) AS ord FROM f WHERE k = 1)
SELECT 'toc_' || CASE WHEN ord < 1000 THEN lpad(ord::VARCHAR, 3, '0') ELSE ord::VARCHAR END AS toc_id, ord AS "order", title, regexp_replace(title, '^[0-9]+\.\s*', '') AS normalized_title, {_SECTION_SQL} AS section_type, lead(title) OVER (ORDER BY page_id) AS expected_end_before, least(0.75, 0.95)::DOUBLE AS confidence FROM o"""
)
def q05_section_types(spark, sf_dir):
    heads = table(spark, sf_dir, "pages").select(F.col("page_id").alias("place"), F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("title"))
    odd = spark.createDataFrame(ODD_TITLES, "place long, title string")
    return structure.toc_proposal(heads.unionByName(odd).withColumn("score", F.lit(0.75)))


@query(
    r"""SELECT lang, count(*) AS n, round(avg(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / greatest(1, length(text))), 6) AS alnum_ratio,
  round(avg(length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) / greatest(1, length(regexp_replace(text, '\s', '', 'g')))), 6) AS cjk_ratio, count_if(regexp_matches(text, '\p{Latin}'))::BIGINT AS latin FROM documents GROUP BY lang"""
)
def q06_text_profile(spark, sf_dir):
    t = F.col("text")
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(text.alnum_count(t) / F.greatest(F.lit(1), F.length(t))), 6).alias("alnum_ratio"), F.round(F.avg(text.cjk_ratio(t)), 6).alias("cjk_ratio"), F.count_if(F.array_contains(text.scripts(t), "Latin")).alias("latin"))


#: Whether a line t may stand in a table of contents.
_TOC_SQL = rf"""length(t) BETWEEN 1 AND 90 AND (({KIND_SQL}) = 'heading_candidate'
  OR regexp_matches(t, '(?i)^(chapter|part|book|section|introduction|conclusion|notes|bibliography|index)($|[^\p{{L}}\p{{N}}_])') OR regexp_matches(t, '^([0-9]+\.|[IVXLCDM]+\.|第[一二三四五六七八九十百0-9]+[章节部篇])'))"""


@query(
    rf"""WITH r AS (SELECT doc_id, ordinal, text AS t FROM ({LINES_SQL}) UNION ALL SELECT d, n, t FROM {values(ODD_LINES, "d, n, t")}),
k AS (SELECT doc_id, ordinal, t, NULL AS tag FROM r), c AS (SELECT *, {KIND_SQL} AS kind FROM k)
SELECT doc_id, ordinal, t AS text FROM c WHERE length(t) BETWEEN 1 AND 90 AND (kind = 'heading_candidate'
  OR regexp_matches(t, '(?i)^(chapter|part|book|section|introduction|conclusion|notes|bibliography|index)($|[^\p{{L}}\p{{N}}_])') OR regexp_matches(t, '^([0-9]+\.|[IVXLCDM]+\.|第[一二三四五六七八九十百0-9]+[章节部篇])'))
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.quality = 0)"""
)
def q07_toc_harvest(spark, sf_dir):
    rows = ledger.lines(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", "text").unionByName(spark.createDataFrame(ODD_LINES, "doc_id long, ordinal long, text string"))
    seen = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    found = rows.where(text.is_toc_candidate(F.col("text"), text.block_kind(F.col("text"))))
    return found.join(seen, "doc_id", "left_anti").select("doc_id", "ordinal", "text")


@query(None)
def q08_page_blocks(spark, sf_dir):
    blocks = html.page_blocks(table(spark, sf_dir, "pages"), "page_id", "html")
    return blocks.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::BIGINT AS n_links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' ') AS links FROM pages""")
def q09_page_regex_blocks(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("title"), F.size(links).cast("long").alias("n_links"), F.array_join(F.array_sort(F.array_distinct(links)), " ").alias("links"))


@query(r"""SELECT lang, usable, count(*) AS n FROM (SELECT lang, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 20 AND (length(text) - length(replace(text, chr(65533), ''))) / greatest(1, length(text)) < 0.01 AS usable FROM documents) GROUP BY lang, usable""")
def q13_page_status(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", text.is_usable(F.col("text")).alias("usable")).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS text_sha256, count(*) AS members, min(doc_id) AS selected_id FROM documents GROUP BY sha256(text)")
def q15_variant_groups(spark, sf_dir):
    return ledger.variants(table(spark, sf_dir, "documents"))


@query(r"""SELECT doc_id, round(length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / greatest(1, length(text)), 6) AS symbol_ratio, contains(text, chr(65533)) OR length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / greatest(1, length(text)) > 0.25 AS garbled FROM documents""")
def q16_garble(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.symbol_ratio(t), 6).alias("symbol_ratio"), text.is_garbled(t, 0.25).alias("garbled"))


ODD_SECRETS = [(-1, "key sk-abcdefghijklmnop1234 end"), (-2, "API_KEY: abcdefghijklmnop1234"), (-3, "openai_api_key ="), (-4, "sk-short"), (-5, "Deepseek_API_Key=x")]


@query(
    rf"""SELECT doc_id FROM (SELECT doc_id, text FROM documents UNION ALL SELECT d, t FROM {values(ODD_SECRETS, "d, t")})
WHERE regexp_matches(text, '(?i)sk-[A-Za-z0-9_-]{{16,}}') OR regexp_matches(text, '(?i)api[_-]?key\s*[:=]\s*[A-Za-z0-9_-]{{16,}}') OR regexp_matches(text, '(?i)DEEPSEEK_API_KEY\s*=') OR regexp_matches(text, '(?i)OPENAI_API_KEY\s*=')"""
)
def q17_secrets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(ODD_SECRETS, "doc_id long, text string"))
    return rows.where(text.is_secret(F.col("text"))).select("doc_id")


@query("SELECT lang, sum(n)::BIGINT AS n, sum(n_bytes)::BIGINT AS n_bytes, sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part)) AS root FROM (SELECT lang, substr(sha256(line), 1, 2) AS part, count(*) AS n, sum(strlen(text)) AS n_bytes, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT lang, text, doc_id || ':' || sha256(text) AS line FROM documents) GROUP BY lang, part) GROUP BY lang")
def q18_artifact_root(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    line = F.concat_ws(":", F.col("doc_id").cast("string"), ids.sha256(F.col("text")))
    sizes = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    roots = ordering.root_digest(docs, F.col("lang"), line)
    return roots.join(sizes, F.col("group_").eqNullSafe(F.col("lang"))).select("lang", "n", "n_bytes", F.col("digest").alias("root"))


ODD_MARKDOWN = [(-1, 1, "# of Shots"), (-1, 2, "#### = padding"), (-1, 3, "   ---"), (-1, 4, "====="), (-1, 5, "***"), (-1, 6, "#hash"), (-1, 7, "-- -"), (-1, 8, "    # code"), (-1, 9, "____  "), (-1, 10, "####### seven")]


@query(
    rf"""SELECT doc_id, ordinal, regexp_replace(regexp_replace(text, '^( {{0,3}})(#{{1,6}})(\s|$)', '\1\\\2\3'), '^( {{0,3}})((={{3,}}|-{{3,}}|\*{{3,}}|_{{3,}})[ \t]*)$', '\1\\\2') AS escaped
FROM (SELECT doc_id, ordinal, text FROM ({LINES_SQL}) UNION ALL SELECT d, n, t FROM {values(ODD_MARKDOWN, "d, n, t")})"""
)
def q36_md_escape(spark, sf_dir):
    rows = ledger.lines(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", "text").unionByName(spark.createDataFrame(ODD_MARKDOWN, "doc_id long, ordinal long, text string"))
    return rows.select("doc_id", "ordinal", text.escape_markdown(F.col("text")).alias("escaped"))


MARKDOWN = [(-1, i, t) for i, t in enumerate(["---", "title: x", "# not a heading", "---", "# Book", "", "## One", "text", "### Empty", "", "## Two ##", "```", "# code", "```", "more", "#### Deep", "  ", "## Last"], 1)] + [(-2, i, t) for i, t in enumerate(["# A", "---", "## B", "## C", "x"], 1)]
_MD_SQL = rf"""WITH r AS (SELECT doc_id, ordinal AS line, text FROM ({LINES_SQL}) UNION ALL SELECT d, n, t FROM {values(MARKDOWN, "d, n, t")}),
a AS (SELECT *, max(CASE WHEN line = 1 AND trim(text) = '---' THEN 1 ELSE 0 END) OVER w AS opened, coalesce(sum(CASE WHEN line > 1 AND trim(text) = '---' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shut FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
b AS (SELECT *, opened = 1 AND shut = 0 AS front FROM a), c AS (SELECT *, regexp_matches(text, '^\s*```') AND NOT front AS fence FROM b),
d AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS inside FROM c),
h AS (SELECT doc_id, line, length(regexp_extract(text, '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 1)) AS level, trim(regexp_extract(text, '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 2)) AS title FROM d WHERE NOT front AND NOT fence AND NOT inside AND regexp_matches(text, '^(#{{1,6}})\s+(.+?)\s*#*\s*$')),
n AS (SELECT *, lead(level) OVER w AS nl, lead(line) OVER w AS nx FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line))
SELECT doc_id, line, level::INT AS level, title, level > 1 AND coalesce(nl, 0) <= level AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = n.doc_id AND r.line > n.line AND (n.nx IS NULL OR r.line < n.nx) AND trim(r.text) <> '') AS empty_leaf FROM n"""


@query(_MD_SQL)
def q37_md_headings(spark, sf_dir):
    rows = ledger.lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("ordinal").alias("line"), "text").unionByName(spark.createDataFrame(MARKDOWN, "doc_id long, line long, text string"))
    return rendering.markdown_outline(rows)


@query(
    f"""SELECT doc_id, ordinal, array_to_string(list_filter([lag(text, 2) OVER w, lag(text, 1) OVER w], lambda x: x IS NOT NULL), ' ¶ ') AS before, array_to_string(list_filter([lead(text, 1) OVER w, lead(text, 2) OVER w], lambda x: x IS NOT NULL), ' ¶ ') AS after,
  coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0)::BIGINT AS next_chars FROM ({LINES_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)"""
)
def q41_window_context(spark, sf_dir):
    rows = ledger.lines(table(spark, sf_dir, "documents"))
    return structure.context(rows, "doc_id", "ordinal", "text").select("doc_id", "ordinal", "before", "after", "next_chars")


WRAPPED = [(-1, 1, "this line ends in"), (-1, 2, "the middle of it."), (-1, 3, "Full stop."), (-1, 4, "lower after stop"), (-1, 5, "Upper"), (-1, 6, "élan follows"), (-1, 7, ""), (-1, 8, "after a blank")]


@query(rf"""WITH r AS (SELECT doc_id, ordinal, text FROM ({LINES_SQL}) UNION ALL SELECT d, n, t FROM {values(WRAPPED, "d, n, t")}), l AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY ordinal) AS left_text FROM r)
SELECT doc_id, ordinal, left_text || ' ' || text AS proposed_text FROM l WHERE length(left_text) > 0 AND NOT regexp_matches(left_text, '[.?!。！？:：]$') AND regexp_matches(text, '^\p{{Ll}}')""")
def q44_linewrap(spark, sf_dir):
    rows = ledger.lines(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", "text").unionByName(spark.createDataFrame(WRAPPED, "doc_id long, ordinal long, text string"))
    return structure.linewrap_candidates(rows, "doc_id", "ordinal").select("doc_id", "ordinal", "proposed_text")


@query(r"""SELECT page_id, substr(coalesce(nullif(trim(regexp_replace(lower(trim(title)), '[^a-z0-9\x{4E00}-\x{9FFF}]+', '-', 'g'), '-'), ''), 'book'), 1, 64) || '_' || substr(sha256(title), 1, 12) AS package FROM (SELECT page_id, regexp_replace(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '[./]', '', 'g') AS title FROM pages)""")
def q46_package_names(spark, sf_dir):
    from ..operators import packages

    title = F.regexp_replace(F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)), "[./]", "")
    return table(spark, sf_dir, "pages").select("page_id", packages.package_name(title).alias("package"))


#: Passages of fewer words than a window has, and of none at all.
SHORT = [(-1, "one two three four five"), (-2, " is of the "), (-3, "for that"), (-4, "%%%"), (-5, "zq")]


@query(
    "SELECT d.doc_id, b.item_id FROM (SELECT doc_id, text FROM documents) d JOIN (SELECT item_id, text FROM benchmark UNION ALL SELECT * FROM " + values(SHORT, "i, t") + ") b ON contains(d.text, b.text)"
)
def q49_contains_evidence(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return passages.contained(docs, items.unionByName(spark.createDataFrame(SHORT, "item_id long, passage string")))


@query(f"SELECT doc_id, count(*)::BIGINT AS n_pieces, string_agg(text, chr(10) ORDER BY ordinal) = any_value(whole) AS reversible FROM (SELECT l.*, d.text AS whole FROM ({LINES_SQL}) l JOIN documents d USING (doc_id)) GROUP BY doc_id")
def q11_reverse_map(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return integrity.reverse_map(docs, ledger.lines(docs))


@query(
    f"""WITH p AS (SELECT doc_id, ordinal, length(text) + 1 AS w FROM ({LINES_SQL})), s AS (SELECT doc_id, ordinal, sum(w) OVER (PARTITION BY doc_id ORDER BY ordinal) AS e, w FROM p),
x AS (SELECT doc_id, e - w AS a, e AS b FROM s WHERE NOT (doc_id % 2 = 1 AND ordinal % 7 = 0)), l AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a, b) AS prev FROM x),
g AS (SELECT doc_id, count(*) AS n, max(b) AS last, bool_or(a > prev) AS gap, sum(b - a) AS covered FROM l GROUP BY doc_id)
SELECT d.doc_id AS block_id, n::BIGINT AS n_spans, covered::BIGINT AS covered, CASE WHEN gap OR last < length(d.text) + 1 THEN 'gap' ELSE 'ok' END AS status FROM documents d JOIN g USING (doc_id)"""
)
def q14_span_partition(spark, sf_dir):
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents")
    rows = ledger.lines(docs)
    end = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("ordinal"))
    spans = rows.select(F.col("doc_id").alias("block_id"), "ordinal", (end - F.length("text") - 1).alias("span_start"), end.alias("span_end")).where("not (block_id % 2 = 1 and ordinal % 7 = 0)")
    blocks = docs.select(F.col("doc_id").alias("block_id"), (F.length("text") + 1).alias("size"))
    return integrity.partition_check(blocks, spans).select("block_id", "n_spans", "covered", "status")


_CUT = "CASE WHEN strpos(text, ' ') > 1 THEN strpos(text, ' ') - 1 ELSE 0 END"


@query(
    f"""SELECT doc_id, ordinal, part, span_start::INT AS span_start, span_end::INT AS span_end, substr(text, span_start + 1, span_end - span_start) AS text, CASE WHEN cut > 0 THEN 'blk_split_' || substr(sha256(concat_ws('|', block_id, part::VARCHAR, span_start::VARCHAR, span_end::VARCHAR)), 1, 16) ELSE block_id END AS block_id
FROM (SELECT doc_id, ordinal, text, block_id, cut, unnest(CASE WHEN cut > 0 THEN [0, 1] ELSE [0] END)::INT AS part, unnest(CASE WHEN cut > 0 THEN [0, cut] ELSE [0] END) AS span_start, unnest(CASE WHEN cut > 0 THEN [cut, length(text)] ELSE [length(text)] END) AS span_end FROM (SELECT *, {_CUT} AS cut FROM ({BLOCKS_SQL})))"""
)
def q27_split_block(spark, sf_dir):
    from ..operators import edits

    blocks = ledger.canonical(ledger.evidence(ledger.lines(table(spark, sf_dir, "documents"))))
    at = F.instr("text", " ")
    return edits.split_at(blocks, F.when(at > 1, at - 1).otherwise(0)).select("doc_id", "ordinal", "part", "span_start", "span_end", "text", "block_id")


@query(
    f"""SELECT doc_id, 'blk_join_' || substr(sha256(string_agg(block_id, '|' ORDER BY ordinal)), 1, 16) AS block_id, min(ordinal) AS ordinal, count(*) AS members, max(ordinal) - min(ordinal) + 1 = count(*) AS valid, string_agg(text, ' ' ORDER BY ordinal) AS text
FROM ({BLOCKS_SQL}) GROUP BY doc_id, (ordinal - 1) // 3"""
)
def q28_join_blocks(spark, sf_dir):
    from ..operators import edits

    blocks = ledger.canonical(ledger.evidence(ledger.lines(table(spark, sf_dir, "documents"))))
    return edits.join_groups(blocks, F.floor((F.col("ordinal") - 1) / 3))


@query(f"SELECT doc_id, block_id, ordinal, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal % 2, ordinal) AS new_ordinal FROM ({BLOCKS_SQL})")
def q29_reorder(spark, sf_dir):
    from ..operators import edits

    blocks = ledger.canonical(ledger.evidence(ledger.lines(table(spark, sf_dir, "documents"))))
    return edits.reorder(blocks, [F.col("ordinal") % 2, F.col("ordinal")]).select("doc_id", "block_id", "ordinal", "new_ordinal")


@query(
    f"""WITH c AS (SELECT 'chunk_' || substr(sha256(paragraph_id || sha256(text)), 1, 16) AS chunk_id, ordinal, text, CASE WHEN ordinal % 11 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha FROM ({PARAGRAPHS_SQL})),
k AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS n FROM c)
SELECT chunk_id, CASE WHEN text = '' THEN 'text_missing' WHEN sha <> sha256(text) THEN 'digest_mismatch' ELSE 'id_repeated' END AS finding FROM k WHERE text = '' OR sha <> sha256(text) OR n > 1"""
)
def q38_chunk_invariants(spark, sf_dir):
    from ..operators import publishing

    rows = publishing.chunks(ledger.paragraphs(ledger.canonical(ledger.evidence(ledger.lines(table(spark, sf_dir, "documents"))))), "r_1", "raw")
    spoiled = F.when(F.col("order") % 11 == 0, ids.sha256(F.concat("text", F.lit("!")))).otherwise(F.col("text_sha256"))
    return publishing.chunk_findings(rows.withColumn("text_sha256", spoiled))


@query(
    f"""SELECT doc_id, count(*) AS n, min(chunk_id) AS first_chunk, sha256(concat_ws('|', 'pkg', 'r_1', 'raw', sha256(string_agg(chunk_id, chr(10) ORDER BY chunk_id)))) AS invalidation_key
FROM (SELECT doc_id, 'chunk_' || substr(sha256(paragraph_id || sha256(text)), 1, 16) AS chunk_id FROM ({PARAGRAPHS_SQL})) GROUP BY doc_id"""
)
def q39_chunk_ids(spark, sf_dir):
    from ..operators import publishing

    rows = publishing.chunks(ledger.paragraphs(ledger.canonical(ledger.evidence(ledger.lines(table(spark, sf_dir, "documents"))))), "r_1", "raw")
    by = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk"), ids.set_digest(F.col("chunk_id")).alias("root"))
    return by.select("doc_id", "n", "first_chunk", publishing.invalidation_key([F.lit("pkg"), F.lit("r_1"), F.lit("raw"), F.col("root")]).alias("invalidation_key"))


@query(
    f"""WITH b AS (SELECT doc_id, ordinal, lower(trim(text)) AS low, ({KIND_SQL}) = 'heading_candidate' AS heading, coalesce(sum(length(trim(text))) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS following FROM (SELECT *, text AS t, NULL AS tag FROM ({LINES_SQL}))),
c AS (SELECT doc_id, 'toc_' || ordinal AS toc_id, lower(CASE WHEN ordinal % 2 = 0 THEN trim(text) ELSE array_to_string(string_split(trim(text), ' ')[1:3], ' ') END) AS cue FROM (SELECT *, text AS t, NULL AS tag FROM ({LINES_SQL})) WHERE ordinal = 1 OR ({_TOC_SQL})),
s AS (SELECT b.doc_id, toc_id, ordinal, max(round(CASE WHEN low = cue THEN 0.90 ELSE 0.70 END + CASE WHEN heading THEN 0.03 ELSE 0 END + CASE WHEN following >= 120 THEN 0.03 ELSE 0 END, 2))::DOUBLE AS score FROM b JOIN c ON b.doc_id = c.doc_id AND cue <> '' AND (low = cue OR contains(low, cue) OR contains(cue, low)) GROUP BY ALL)
SELECT doc_id, toc_id, ordinal, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, toc_id ORDER BY score DESC, ordinal) AS rank FROM s) WHERE rank <= 5"""
)
def q40_boundaries(spark, sf_dir):
    """Cues are the first line and every line of the whole document that may be a heading; odd ones by their first three words."""
    rows = ledger.lines(table(spark, sf_dir, "documents"))
    t = F.trim("text")
    cue = F.when(F.col("ordinal") % 2 == 0, t).otherwise(F.array_join(F.slice(F.split(t, " "), 1, 3), " "))
    titles = (F.col("ordinal") == 1) | text.is_toc_candidate(F.col("text"), text.block_kind(F.col("text")))
    cues = rows.where(titles).select("doc_id", F.concat(F.lit("toc_"), F.col("ordinal").cast("string")).alias("toc_id"), cue.alias("cue"))
    blocks = rows.select("doc_id", "ordinal", "text", text.block_kind(F.col("text")).alias("block_kind"))
    return structure.boundary_scores(cues, blocks).select("doc_id", "toc_id", "ordinal", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH n AS (SELECT doc_id, count(*) AS size FROM ({LINES_SQL}) GROUP BY doc_id), i AS (SELECT doc_id, k AS item, CASE WHEN k % 3 = 2 THEN NULL ELSE (k * 7 + doc_id) % (size + 1) END AS s, size FROM n, generate_series(1, 4) AS g(k)),
w AS (SELECT *, coalesce(s, CASE WHEN item = 1 THEN 0 ELSE size END) AS a, CASE WHEN item = 4 THEN size ELSE coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY item), size) END AS e FROM i),
r AS (SELECT doc_id, item, a, greatest(a, e) AS b, e < a AS capped FROM w)
SELECT r.doc_id, item, a::BIGINT AS start_index, b::BIGINT AS end_index, capped, count(l.ordinal) AS n_lines FROM r LEFT JOIN ({LINES_SQL}) l ON l.doc_id = r.doc_id AND l.ordinal - 1 >= a AND l.ordinal - 1 < b GROUP BY ALL"""
)
def q42_chapter_ranges(spark, sf_dir):
    rows = ledger.lines(table(spark, sf_dir, "documents"))
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("size"))
    items = sizes.select("doc_id", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("item"))
    items = items.withColumn("start", F.when(F.col("item") % 3 != 2, (F.col("item") * 7 + F.col("doc_id")) % (F.col("size") + 1)))
    ranges = structure.chapter_ranges(items, "doc_id", "item", "start", "size").select("doc_id", "item", "start_index", "end_index", "capped")
    place = rows.select("doc_id", (F.col("ordinal") - 1).alias("at"))
    inside = ranges.join(place, "doc_id").where("at >= start_index and at < end_index").groupBy("doc_id", "item").agg(F.count("*").alias("n"))
    return ranges.join(inside, ["doc_id", "item"], "left").select("doc_id", "item", "start_index", "end_index", "capped", F.coalesce("n", F.lit(0)).alias("n_lines"))
