"""The subpackage's registered queries, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_digests
from .chat import format_turns, read_back
from .language_id import language_report
from .media import media_report
from .mixing import mix_report
from .near_duplicates import near_duplicates
from .pii import find_pii
from .quality_rules import quality_report
from .toxicity import toxicity_report
from .warc import derivative_report

#: Where the public tokenizers' vocabulary files are; never part of the repository.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivative_report(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_turns(rows))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_mix_to_targets, op3_language_id, op4_pii, op5_bpe, op6_warc_derivatives, op7_quality_rules, op8_chat_format, op9_media_columns, op10_toxicity)
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLD)} AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON a = doc_id
""",
    "op7_quality_rules": f"""
WITH w AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS win FROM w WHERE len(ws) >= 8),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, range(8) AS o(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
b AS (SELECT w.doc_id, stratum, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_runs, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbols, n_capitals / greatest(word_chars, 1) AS capitals, n_dup_lines / greatest(n_lines, 1) AS dup_lines, n_runs / greatest(n_words, 1) AS runs FROM b),
h AS (SELECT s.*, q.good FROM s JOIN (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) q USING (doc_id) WHERE NOT base_failed),
v AS (SELECT stratum, good, unnest(['symbols', 'capitals', 'dup_lines', 'runs']) AS signal, unnest([symbols, capitals, dup_lines, runs]) AS x FROM h),
c AS (SELECT stratum, signal, cutoff, count_if(good)::BIGINT AS n, count_if(good AND x > cutoff)::BIGINT AS k, count_if(NOT good AND x > cutoff)::BIGINT AS caught FROM v, (SELECT unnest([0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS cutoff) GROUP BY ALL),
a AS (SELECT * FROM c WHERE k < n * 0.005::DOUBLE AND list_sum(list_transform(range(0, k + 1), lambda j: exp((CASE WHEN j = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) END) + j * ln(0.005::DOUBLE) + (n - j) * ln(0.995::DOUBLE)))) <= 0.05::DOUBLE / (SELECT count(*) FROM c)),
m AS (SELECT *, max(caught) OVER (PARTITION BY stratum, signal) AS most FROM a),
o AS (SELECT stratum, signal, cutoff, row_number() OVER (PARTITION BY stratum, signal ORDER BY k, cutoff DESC) AS best FROM m WHERE most > 0 AND caught >= most * 0.98::DOUBLE),
f AS (SELECT doc_id, bool_or(CASE signal WHEN 'symbols' THEN symbols WHEN 'capitals' THEN capitals WHEN 'dup_lines' THEN dup_lines ELSE runs END > cutoff) AS breach FROM s JOIN o ON o.stratum = s.stratum AND best = 1 GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(breach, false) AS kept FROM s LEFT JOIN f USING (doc_id)
""",
    "op8_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN contains(x, '\') OR contains(x, '</turn>' || chr(10)) THEN regexp_replace(x, '(\\|###|: |</turn>)', '\\\1', 'g') ELSE x END AS shown FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn) AS turns, coalesce(string_agg(x, '' ORDER BY turn) FILTER (r = 'assistant'), '') AS loss, sum(4 + length(r) + 2 + length(shown) + 8)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
""",
}
