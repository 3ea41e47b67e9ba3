"""What the registered queries share: tables, literal rows, and the same rows as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A registered query and its DuckDB SQL; None where SQL can't express it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None):
    """Register the function under its name."""

    def add(run):
        REGISTRY[run.__name__] = Query(run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return repr(value)


def values(rows: list[tuple], names: str) -> str:
    """A FROM item of literal rows; texts keep their newlines."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({names})"


def padded_sql(number: str, digits: int) -> str:
    """A number with zeros before it up to so many digits; a longer one stays whole."""
    return f"lpad(({number})::VARCHAR, greatest({digits}, length(({number})::VARCHAR))::INT, '0')"


#: Documents with ids longer than the digits that names are filled up to: names mustn't cut them.
LONG_IDS = [(123456780, "first\nsecond"), (123456781, "first\nsecond"), (12345678901234, "Chapter 9\nthe end")]


def with_long_ids(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(LONG_IDS, "doc_id long, text string"))


LONG_IDS_SQL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT d, t FROM {values(LONG_IDS, 'd, t')})"


#: Lines of a document's text with their places from 1.
LINES_SQL = f"SELECT doc_id, sha256(text) AS source_sha, 'document_' || {padded_sql('doc_id', 8)} AS page_id, unnest(generate_series(1, len(ls))) AS ordinal, unnest(ls) AS text FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)"
EVIDENCE_SQL = f"SELECT *, 'ev_' || substr(sha256(concat_ws('|', source_sha, page_id, 'text_native', ordinal::VARCHAR, text, '[]')), 1, 16) AS evidence_id FROM ({LINES_SQL})"
BLOCKS_SQL = f"SELECT *, 'blk_' || substr(sha256(page_id || '|' || evidence_id), 1, 16) AS block_id FROM ({EVIDENCE_SQL})"
PARAGRAPHS_SQL = f"""SELECT *, 'para_' || substr(sha256('[{{"block_id": "' || block_id || '", "end_offset": ' || length(text) || ', "evidence_id": "' || evidence_id || '", "start_offset": 0}}]'), 1, 16) AS paragraph_id FROM ({BLOCKS_SQL})"""
#: White space as one blank.
COLLAPSE_SQL = r"trim(regexp_replace({}, '[\s\x{{00a0}}\x0b]+', ' ', 'g'))"
