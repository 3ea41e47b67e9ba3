"""Ledgers as JSON lines, decision files, side files of recognised text, bundles and corpora on Spark's paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..functions import text
from ..operators.ordering import root_digest
from ..session import ship

#: Formats by the lower-case suffix of a path.
FORMATS = {
    ".pdf": "pdf", ".epub": "epub", ".docx": "docx", ".txt": "text", ".text": "text", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".xhtml": "html",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".tif": "image", ".tiff": "image", ".webp": "image", ".mobi": "mobi", ".azw3": "mobi", ".json": "bundle_manifest",
}

OCR_SCHEMA = "page_id string, page_anchor string, page int, text string, bbox array<double>, confidence double, engine string, engine_version string, source_image_sha256 string"


def source_format(path: Column) -> Column:
    """The format of a path by its suffix; null for none that is known."""
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.try_element_at(known, text.suffix(path))


def read_ledger(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines ledger, blank lines skipped; a missing one has none."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_ledger(df: DataFrame, path: str, append: bool = False) -> None:
    """A ledger as JSON lines; Spark's committer renames complete files only."""
    df.write.mode("append" if append else "overwrite").json(path)


def read_decisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Decisions of a JSON file, a list or an object with ``decisions``, or of JSON lines."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
        listed = F.when(F.startswith("v", F.lit("[")), F.from_json("v", f"array<struct<{schema_fields(schema)}>>")).otherwise(F.from_json("v", f"struct<decisions:array<struct<{schema_fields(schema)}>>>")["decisions"])
        return whole.select(F.explode(listed).alias("d")).select("d.*")
    return read_ledger(spark, path, schema)


def schema_fields(schema: str) -> str:
    """``a int, b string`` as ``a:int,b:string``."""
    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def read_recognised(spark: SparkSession, path: str) -> DataFrame:
    """Rows of recognised text with a place and a finite box of four numbers; page from 1; the only engine named goes for all."""
    rows = spark.read.schema(OCR_SCHEMA).json(path)
    box = F.forall("bbox", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    located = F.coalesce("page_id", "page_anchor", F.col("page").cast("string")).isNotNull()
    rows = rows.where(located & (F.size("bbox") == 4) & box & (F.col("page").isNull() | (F.col("page") >= 1)))
    only = rows.agg(F.when(F.count_distinct("engine") == 1, F.max("engine"))).first()[0]
    return rows.withColumn("engine", F.coalesce("engine", F.lit(only).cast("string")))


def of_page(rows: DataFrame, page_id: str, anchor: str | None, number: int | None) -> DataFrame:
    """Rows that name a page no differently than given: what a row leaves out doesn't count."""
    same = lambda name, value: F.col(name).isNull() | F.col(name).eqNullSafe(F.lit(value))
    return rows.where(same("page_id", page_id) & same("page_anchor", anchor) & same("page", number))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a recogniser's tab-separated table, numbered in the file's order."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where("at > 0 and line <> ''")
    cell = F.split("line", "\t")
    names = ["level", "page_num", "block_num", "par_num", "line_num", "word_num"]
    sizes = ["left", "top", "width", "height", "conf"]
    cols = [F.expr(f"try_cast(cells[{i}] as int)").alias(n) for i, n in enumerate(names)] + [F.expr(f"try_cast(cells[{i}] as double)").alias(n) for i, n in enumerate(sizes, 6)]
    return lines.select("file", (F.col("at") - 1).alias("ordinal"), cell.alias("cells")).where(F.size("cells") >= 12).select("file", "ordinal", *cols, F.col("cells")[11].alias("text")).where("level is not null and conf is not null")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Members of a bundle manifest (source_id, locator, expected_sha256, order), in order, then by locator."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "sources array<struct<source_id:string,locator:string,expected_sha256:string,role:string,`order`:int>>")
    members = whole.select(F.posexplode(parsed["sources"]).alias("at", "m")).select(F.coalesce("m.order", "at").alias("order"), "m.source_id", "m.locator", "m.expected_sha256", "m.role")
    return members.where("locator is not null").orderBy("order", "locator")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """path, format, bytes and content of every file under a folder whose format is known."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.withColumn("format", source_format(F.col("path"))).where("format is not null").select("path", "format", F.col("length").alias("bytes"), "content")


def tree_digest(files: DataFrame) -> DataFrame:
    """n, bytes and a digest of a folder's files (path, content) that doesn't depend on their order."""
    line = F.concat(F.col("path"), F.lit(":"), F.sha2("content", 256))
    size = files.groupBy(F.lit("all").alias("group_")).agg(F.sum(F.octet_length("content")).alias("bytes"))
    return root_digest(files, F.lit("all"), line).join(size, "group_").select("n", "bytes", "digest")


def attested(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Members (path, expected_sha256) that are missing or whose bytes have another digest."""
    own = files.select("path", F.sha2("content", 256).alias("found"))
    return expected.join(own, "path", "left").where("expected_sha256 is not null and not (found <=> expected_sha256)").select("path", F.when(F.col("found").isNull(), "missing").otherwise("mismatch").alias("finding"))


def _unescaped(values: pd.Series) -> pd.Series:
    import html

    return values.map(lambda v: None if v is None else html.unescape(v))


def unescaped(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the entities of a column's texts as their characters. Only texts that have an ampersand leave the JVM."""
    ship(df.sparkSession)
    has = F.coalesce(F.contains(name, F.lit("&")), F.lit(False))
    return df.where(~has).unionByName(df.where(has).withColumn(name, pandas_udf(_unescaped, "string")(name)).select(df.columns))


def text_pieces(docs: DataFrame, key: str, value: str) -> DataFrame:
    """Pieces of texts between blank lines: key, ordinal (from 1, of all pieces), tag (h1, h2 or p) and text, entities as characters."""
    pieces = docs.select(key, F.posexplode(F.split(value, r"\n\s*\n")).alias("at", "piece")).withColumn("piece", text.strip(F.col("piece"))).where("piece <> ''")
    tag = F.when(F.startswith("piece", F.lit("# ")), "h1").when(F.startswith("piece", F.lit("## ")), "h2").otherwise("p")
    clean = text.strip(F.regexp_replace("piece", "^[# ]+", ""))
    rows = pieces.select(key, (F.col("at") + 1).alias("ordinal"), tag.alias("tag"), clean.alias("text")).where("text <> ''")
    return unescaped(rows, "text")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of text and Markdown files: file, page_id, ordinal, tag (h1, h2 or p) and text; pieces between blank lines."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text_pieces(whole, "file", "value").select("file", F.lit("document_0001").alias("page_id"), "ordinal", "tag", "text")
