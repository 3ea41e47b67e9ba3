"""Runs: digests of what was read and written, identities, manifests, bundles of members, the active head."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import ids, text
from ..session import ship

PIPELINE = "codexloom-1"


def fingerprint(policy: dict) -> str:
    """A digest of a policy: keys sorted, tags sorted and once each, the pipeline's version included."""
    own = {**policy, "pipeline": PIPELINE, "access_tags": sorted(set(policy.get("access_tags", [])))}
    return hashlib.sha256(json.dumps(own, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def run_id(source_sha: str, policy: dict) -> str:
    return f"r_{source_sha[:12]}_{fingerprint(policy)[:12]}"


def policy_findings(policy: dict) -> list[str]:
    """What is wrong with a policy; nothing for a good one."""
    out = []
    if policy.get("target", "hint") not in ("hint", "review", "citation"):
        out.append("target")
    if not 72 <= policy.get("dpi", 200) <= 600:
        out.append("dpi")
    if policy.get("privacy", "local_only") not in ("local_only", "workspace", "tenant"):
        out.append("privacy")
    if policy.get("privacy") == "tenant" and not policy.get("tenant_id"):
        out.append("tenant_id")
    if policy.get("privacy") == "workspace" and not policy.get("workspace_id"):
        out.append("workspace_id")
    out += [k for k in ("max_pages", "max_pixels", "max_bytes") if policy.get(k, 1) <= 0]
    out += ["access_tags"] if any(not t or len(t) > 64 for t in policy.get("access_tags", [])) else []
    return out


def materialize(tables: dict[str, DataFrame], folder: str, run: str) -> DataFrame:
    """Write each table to ``folder/run/name``, unless the run is there already, and return the manifest: name, rows, digest.

    A digest doesn't depend on the order of the rows and takes one pass of partial aggregates.
    """
    spark = next(iter(tables.values())).sparkSession
    manifest = f"{folder}/{run}/manifest"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{manifest}/_SUCCESS")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.parquet(manifest)
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{run}/{name}")
        rows.append(digest_of(spark.read.parquet(f"{folder}/{run}/{name}"), name))
    reduce(DataFrame.unionByName, rows).write.mode("overwrite").parquet(manifest)  # last: it marks the run as whole
    return spark.read.parquet(manifest)


def digest_of(df: DataFrame, name: str) -> DataFrame:
    """name, rows and digest of a table: of its rows as JSON, nulls included, whatever their order."""
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    return df.agg(F.count("*").alias("rows"), ids.rows_digest(line).alias("digest")).select(F.lit(name).alias("name"), "rows", "digest")


def reconcile(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """name and finding of tables that are missing, unexpected or changed."""
    both = declared.select("name", F.col("digest").alias("want")).join(observed.select("name", F.col("digest").alias("got")), "name", "full_outer")
    finding = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("got") != F.col("want"), "changed")
    return both.select("name", finding.alias("finding")).where("finding is not null")


def bundle(members: list[tuple[str, DataFrame]], id_columns: tuple[str, ...] = ("page_id", "evidence_id")) -> DataFrame:
    """Rows of several members as one table: ids get the member's name before them, ``member`` and ``member_order`` tell them apart."""
    parts = []
    for order, (name, df) in enumerate(members, 1):
        for c in id_columns:
            if c in df.columns:
                df = df.withColumn(c, F.concat_ws("__", F.lit(name), F.col(c).cast("string")))
        parts.append(df.withColumns({"member": F.lit(name), "member_order": F.lit(order)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def nested_digest(members: DataFrame, depth: int = 2) -> DataFrame:
    """bundle and digest: the digest of each bundle's own sha and its members' in order, members of bundles first.

    ``members``: bundle, member, order, sha. Bundles within bundles are followed ``depth`` levels down.
    """
    digests = members.where("member is null").select(F.col("bundle").alias("of"), F.col("sha").alias("own"))
    rows = members.where("member is not null")
    known = rows.select(F.col("member").alias("m"), "sha").distinct()
    for _ in range(depth):
        line = rows.select("bundle", "order", "member").join(known, F.col("member") == F.col("m"))
        by = line.groupBy("bundle").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "sha"))), lambda x: x["sha"]), "|").alias("below"))
        made = digests.join(by, F.col("of") == F.col("bundle")).select(F.col("of").alias("m"), ids.sha256(F.concat_ws("|", "own", "below")).alias("sha"))
        known = known.join(made.select("m"), "m", "left_anti").unionByName(made)
    return known.join(digests, F.col("m") == F.col("of")).select(F.col("m").alias("bundle"), F.col("sha").alias("digest"))


def head(manifest: DataFrame, source_sha: str, run: str) -> DataFrame:
    """A package's manifest (source_revisions, runs, active_run_id) after a run: the revision and the run added once, runs sorted."""
    known = F.array_contains("source_revisions", source_sha)
    return manifest.withColumns({
        "source_revisions": F.when(known, F.col("source_revisions")).otherwise(F.concat("source_revisions", F.array(F.lit(source_sha)))),
        "runs": F.array_sort(F.array_union("runs", F.array(F.lit(run)))), "active_run_id": F.lit(run),
    })


def on_disk(surfaces: DataFrame, run: str) -> DataFrame:
    """Surfaces with relative image paths put under their run, and a kind by their format."""
    own = ~F.startswith("page_image_path", F.lit("/")) & ~F.startswith("page_image_path", F.lit("runs/"))
    path = F.when(own, F.concat(F.lit(f"runs/{run}/"), F.col("page_image_path"))).otherwise(F.col("page_image_path"))
    kind = F.when(F.col("format") == "epub", "spine_item").when(F.col("format").isin("docx",), "story").when(F.col("format").isin("text", "markdown", "html"), "document").otherwise("page")
    return surfaces.withColumns({"page_image_path": path, "surface_kind": kind})


def _nfc(values: pd.Series) -> pd.Series:
    import unicodedata

    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def normalized_variants(observed: DataFrame) -> DataFrame:
    """Observations and, for those that composition or line ends change, a derived one in the same variant group that is selected.

    Spark has no normalisation built in, so texts beyond Latin-1 go through one Arrow function.
    """
    ship(observed.sparkSession)
    nfc = pandas_udf(_nfc, "string")
    ends = F.regexp_replace("text", "\r\n|\r", "\n")
    rows = observed.withColumn("tidy", ends)
    plain = rows.where(~text.matches(F.col("tidy"), r"[^\x{0000}-\x{00FF}]") | F.col("tidy").isNull())
    other = rows.where(text.matches(F.col("tidy"), r"[^\x{0000}-\x{00FF}]")).withColumn("tidy", nfc("tidy"))
    both = plain.unionByName(other)
    source = both.withColumn("normalization_status", F.lit("source_preserved")).withColumn("selected", ~F.coalesce(F.col("tidy") != F.col("text"), F.lit(False)))
    made = both.where("tidy <> text").withColumns({"evidence_id": ids.stable_id("ev", F.lit("nfc"), F.col("evidence_id")), "derived_from": F.col("evidence_id"), "text": F.col("tidy"), "normalization_status": F.lit("nfc"), "selected": F.lit(True)})
    out = source.withColumn("derived_from", F.lit(None).cast("string")).unionByName(made)
    return out.withColumn("variant_group_id", F.concat(F.lit("var_"), F.coalesce("derived_from", "evidence_id"))).drop("tidy")


def status(manifest: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A row a package: its active run, trust and verdict of the strictest target that passed."""
    best = F.max(F.when(F.col("failed") == 0, F.struct(F.when(F.col("target") == "citation", 3).when(F.col("target") == "review", 2).otherwise(1).alias("k"), "target", "status")))
    top = verdicts.groupBy("package_id").agg(best.alias("best"))
    trust = F.when(F.col("best.target") == "citation", "citation_grade").when(F.col("best.target") == "review", "needs_review").otherwise("hint_only")
    return manifest.join(top, "package_id", "left").select("package_id", "active_run_id", trust.alias("trust_status"), F.coalesce("best.status", F.lit("FAIL_REVIEW")).alias("status"))


def canonical_hash(df: DataFrame, names: list[str]) -> Column:
    """The hash of a row's fields as JSON with sorted keys and blanks after separators; nulls stay."""
    return ids.sha256(ids.row_json(dict(df.dtypes), names))
