"""Gates of many packages at once: identity, lifecycle, scope, bindings, artifacts, EPUB accounts, decisions, structure.

Every table has ``package_id`` and a check gives the failing values (package_id, v), so one report covers any number of packages and
no package is a task of its own. The checks of a single package's ledgers are in :mod:`acceptance`.

packages: package_version, lifecycle, source_format, source_sha256, active_run_id, pipeline_version, privacy, tenant_id, workspace_id,
rights_basis, retention_policy, access_tags, n_navigation, structure_required. runs: run_id, schema_version, source_sha256, pipeline_version,
target and the six columns of scope. bindings: name, declared, observed, decision_id. artifacts: path, required, declared, observed.
binaries: owner, owner_kind, path, declared, observed, link. surfaces: page_id, route, surface_role, canonical_inclusion, navigation_sha256,
navigation_status, fallback. evidence: evidence_id, variant_group_id, mathml_sha256, pre_text_sha256, heading, container_types. canonical:
block_id, evidence_id, selection_status, source_evidence_ids. assets: occurrence_id, callout_role, kept. objects: object_id, object_kind,
source_id, asset_occurrence_ids, caption_text, caption_object_id. paragraphs: paragraph_id, page_id, source_id, source_role, text,
source_evidence_ids. boundaries: boundary_id, paragraph_ids. toc: boundary_id, title. decisions (the latest of each target): decision_id, kind,
target_id, disposition, reading, reason and what their kind asks for (:data:`DECIDED`). log: seq, content, previous_hash, own_hash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from . import decisions

Tables = dict[str, DataFrame]
ALL, REVIEWED, STRICT = ("hint", "review", "citation"), ("review", "citation"), ("citation",)

# ---- fixed values: names that packages use ----
SCOPE = ("privacy", "tenant_id", "workspace_id", "rights_basis", "retention_policy", "access_tags")
CONTAINERS = ("tip", "note", "warning", "caution", "important", "sidebar", "example", "figure", "table", "equation", "footnote", "footnotes", "featuretitle")
ROLES = ("definition", "mechanism", "method", "metric", "case", "boundary", "caveat", "reference_only", "excluded")
LEAP_STATES = ("candidate", "verified", "rejected")
USES = ("used", "excluded", "reference_only")
# ---- end of fixed values ----

_LEAP = "struct<premises:array<string>,premise_ids:array<string>,conclusion_ids:array<string>,inference:string,uncertainty:string,assumptions:array<string>,counterevidence:array<string>,novelty:string,boundary:string,status:string>"
#: What decisions have beside their identity, target, disposition, reading and reason.
DECIDED = f"source_id string, sourcepage_path string, summary string, role string, claims array<string>, methods array<string>, metrics array<string>, boundaries array<string>, leaps array<{_LEAP}>, used_in_card boolean, needs_primary boolean, covered_surface_ids array<string>, representation_status string, source_verified boolean, relations_reviewed boolean"


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def _not(good: Column) -> Column:
    """The rows for which ``good`` isn't true, unknown included."""
    return ~F.coalesce(good, F.lit(False))


def _of(table: str, value: str, failing: Column) -> Callable[[Tables], DataFrame]:
    return lambda t: t[table].where(failing).select("package_id", F.col(value).cast("string").alias("v"))


def _bound(*names: str, asked: bool = False) -> Callable[[Tables], DataFrame]:
    """Projections whose digest isn't the one declared; ``asked``: and those that aren't there."""

    def failing(t: Tables) -> DataFrame:
        own = t["bindings"].where(F.col("name").isin(*names))
        differs = _not(F.col("declared") == F.col("observed"))
        wrong = own.where(differs if asked else F.col("observed").isNotNull() & differs)
        out = wrong.select("package_id", F.col("name").alias("v"))
        if not asked:
            return out
        want = t["packages"].select("package_id", F.explode(F.array(*map(F.lit, names))).alias("v"))
        return out.unionByName(want.join(own.select("package_id", F.col("name").alias("v")), ["package_id", "v"], "left_anti"))

    return failing


def _structure(t: Tables) -> DataFrame:
    return t["decisions"].where("kind = 'structure' and target_id = 'canonical'")


def _bound_to_structure(name: str) -> Callable[[Tables], DataFrame]:
    """A projection of a reviewed structure has to be there, with the declared digest and the decision that it came from."""

    def failing(t: Tables) -> DataFrame:
        own = t["bindings"].where(F.col("name") == name).select("package_id", "declared", "observed", F.col("decision_id").alias("from_"))
        both = _structure(t).select("package_id", "decision_id").join(own, "package_id", "left")
        return both.where(_not((F.col("declared") == F.col("observed")) & (F.col("from_") == F.col("decision_id")))).select("package_id", F.lit(name).alias("v"))

    return failing


def _chain(t: Tables) -> DataFrame:
    rows = t["log"].withColumn("genesis_", ids.sha256(F.concat(F.lit("review-genesis|"), "package_id")))
    checked = decisions.verify_chain(rows, "package_id", ["seq"], "content", "previous_hash", "own_hash", F.col("genesis_"))
    return checked.where("not linked or not intact").select("package_id", F.col("seq").cast("string").alias("v"))


def _escapes(path: Column) -> Column:
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")


def _artifacts(t: Tables) -> DataFrame:
    """What is wrong with the active run: its manifest missing or of another package, artifacts gone, changed or outside."""
    run = t["runs"].select("package_id", F.col("run_id").alias("run_"), F.col("source_sha256").alias("sha_"), F.col("pipeline_version").alias("pipeline_"), "schema_version")
    both = t["packages"].join(run, (t["packages"]["package_id"] == run["package_id"]) & (F.col("active_run_id") == F.col("run_")), "left").drop(run["package_id"])
    named = F.rlike("active_run_id", F.lit(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")) & ~F.contains("active_run_id", F.lit(".."))
    wrong = F.array_compact(F.array(
        F.when(_not(named), "run_id"), F.when(F.col("run_").isNull(), "run_manifest"), F.when(F.col("run_").isNotNull() & _not(F.col("sha_") == F.col("source_sha256")), "source_sha256"),
        F.when(F.col("run_").isNotNull() & _not(F.col("schema_version") == 2), "schema_version"), F.when(F.col("run_").isNotNull() & _not(F.col("pipeline_") == F.col("pipeline_version")), "pipeline_version"),
    ))
    own = t["artifacts"].where(_escapes(F.col("path")) | F.when(F.col("required") | F.col("declared").isNotNull(), _not(F.col("declared") == F.col("observed"))).otherwise(F.lit(False)))
    return both.select("package_id", F.explode(wrong).alias("v")).unionByName(own.select("package_id", F.col("path").alias("v")))


def _scope(t: Tables) -> DataFrame:
    run = t["runs"].select(F.col("package_id").alias("of_"), F.col("run_id").alias("run_"), *(F.col(c).alias(f"run_{c}") for c in SCOPE))
    both = t["packages"].join(run, (F.col("package_id") == F.col("of_")) & (F.col("active_run_id") == F.col("run_")), "left")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"run_{c}")) for c in SCOPE), F.col("run_").isNotNull())
    return both.where(~same).select("package_id", F.coalesce("run_", F.lit("none")).alias("v"))


def _external(t: Tables) -> DataFrame:
    return t["binaries"].where(F.startswith("path", F.lit("/")))


def _binaries(t: Tables) -> DataFrame:
    own = t["binaries"].where(~F.startswith("path", F.lit("/")))
    wrong = _escapes(F.col("path")) | F.coalesce("link", F.lit(False)) | F.col("observed").isNull() | (F.col("declared").isNotNull() & (F.col("declared") != F.col("observed")))
    return own.where(wrong).select("package_id", F.concat_ws(":", "owner", "path").alias("v"))


def _variants(t: Tables) -> DataFrame:
    """Reviewed selections whose raw observations aren't all of the selected one's variant group."""
    group = t["evidence"].select("package_id", "evidence_id", F.col("variant_group_id").alias("group_"))
    own = t["canonical"].where("selection_status = 'reviewed_variant_selection'").select("package_id", "block_id", "evidence_id", "source_evidence_ids")
    mine = own.join(group, ["package_id", "evidence_id"], "left").select("package_id", "block_id", F.col("group_").alias("mine"))
    raw = own.select("package_id", "block_id", F.explode("source_evidence_ids").alias("evidence_id")).join(group, ["package_id", "evidence_id"], "left")
    raw = raw.groupBy("package_id", "block_id").agg(F.min("group_").alias("lo"), F.max("group_").alias("hi"), F.bool_or(F.col("group_").isNull()).alias("lost"))
    both = mine.join(raw, ["package_id", "block_id"], "left")
    return both.where(_not(~F.col("lost") & (F.col("lo") == F.col("mine")) & (F.col("hi") == F.col("mine")))).select("package_id", F.col("block_id").alias("v"))


def _epub(failing: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    return lambda t: failing(t).join(t["packages"].where("source_format = 'epub'").select("package_id"), "package_id", "left_semi")


def _navigation(t: Tables) -> DataFrame:
    own = t["surfaces"].where("route = 'epub_navigation_metadata'")
    status = F.col("navigation_status")
    good = (F.col("surface_role") == "auxiliary_navigation") & (F.col("canonical_inclusion") == "excluded") & ~_blank(F.col("navigation_sha256")) & ~_blank(status)
    good = good & ((status != "nonsemantic_navigation_document_fallback_required") | F.coalesce(F.col("fallback") == "epub2_ncx", F.lit(False)))
    counts = t["packages"].join(own.groupBy("package_id").agg(F.count("*").alias("n")), "package_id", "left").where(F.coalesce("n", F.lit(0)) != F.coalesce("n_navigation", F.lit(0)))
    return own.where(_not(good)).select("package_id", F.col("page_id").alias("v")).unionByName(counts.select("package_id", F.concat(F.lit("count:"), F.coalesce("n", F.lit(0)).cast("string")).alias("v")))


def _unaccounted(table: str, value: str, where: Column, kind: str, found: Column) -> Callable[[Tables], DataFrame]:
    """Values that no object of a kind accounts for."""

    def failing(t: Tables) -> DataFrame:
        want = t[table].where(where).select("package_id", F.col(value).alias("v")).distinct()
        have = t["objects"].where(F.col("object_kind") == kind).select("package_id", found.alias("v"))
        return want.join(have, ["package_id", "v"], "left_anti")

    return failing


def _headings(t: Tables) -> DataFrame:
    """paragraph_id and contained of the paragraphs that stand on a heading of the source; contained: in a box that isn't the text's own order."""
    seen = t["evidence"].where("heading").select("package_id", "evidence_id", F.arrays_overlap(F.transform("container_types", lambda x: F.lower(x)), F.array(*map(F.lit, CONTAINERS))).alias("contained"))
    rows = t["paragraphs"].select("package_id", "paragraph_id", F.explode("source_evidence_ids").alias("evidence_id")).join(seen, ["package_id", "evidence_id"])
    return rows.groupBy("package_id", "paragraph_id").agg(F.bool_or(F.coalesce("contained", F.lit(False))).alias("contained"))


def _unmaterialised(t: Tables) -> DataFrame:
    """Headings of the source that don't open a boundary under one of its titles."""
    want = _headings(t).where("not contained").select("package_id", F.col("paragraph_id").alias("v"))
    first = t["boundaries"].select("package_id", "boundary_id", F.try_element_at("paragraph_ids", F.lit(1)).alias("v"))
    keyed = t["paragraphs"].select("package_id", F.col("paragraph_id").alias("v"), text.heading_key(F.col("text")).alias("key"))
    titles = t["toc"].select("package_id", "boundary_id", text.heading_key(F.col("title")).alias("key"))
    made = first.join(keyed, ["package_id", "v"]).join(titles, ["package_id", "boundary_id", "key"], "left_semi")
    return want.join(made, ["package_id", "v"], "left_anti")


def _contained_once(t: Tables) -> DataFrame:
    want = _headings(t).where("contained").select("package_id", F.col("paragraph_id").alias("v"))
    uses = t["boundaries"].select("package_id", F.explode("paragraph_ids").alias("v")).groupBy("package_id", "v").agg(F.count("*").alias("n"))
    return want.join(uses, ["package_id", "v"], "left").where(_not(F.col("n") == 1)).select("package_id", "v")


def _decided(t: Tables, kind: str) -> DataFrame:
    return t["decisions"].where(F.col("kind") == kind).drop("kind")


def _leaps(t: Tables) -> DataFrame:
    """Paragraphs with a reasoning leap that lacks a part, or builds on paragraphs that aren't used."""
    own = _decided(t, "paragraph").select("package_id", F.col("target_id").alias("v"), "disposition", F.posexplode("leaps").alias("at", "leap"))
    leap = F.col("leap")
    whole = (F.size(leap["premises"]) > 0) & (F.size(leap["premise_ids"]) > 0) & ~_blank(leap["inference"]) & ~_blank(leap["uncertainty"]) & leap["assumptions"].isNotNull() & leap["counterevidence"].isNotNull() & ~_blank(leap["novelty"]) & ~_blank(leap["boundary"])
    bad = own.where(_not(whole & leap["status"].isin(*LEAP_STATES) & (F.col("disposition") == "used")))
    built = own.select("package_id", "v", F.explode(F.concat(F.coalesce(leap["premise_ids"], F.array().cast("array<string>")), F.coalesce(leap["conclusion_ids"], F.array().cast("array<string>")))).alias("on_"))
    used = _decided(t, "paragraph").where("disposition = 'used'").select("package_id", F.col("target_id").alias("on_"))
    used = used.join(t["paragraphs"].select("package_id", F.col("paragraph_id").alias("on_")), ["package_id", "on_"], "left_semi")
    return bad.select("package_id", "v").unionByName(built.join(used, ["package_id", "on_"], "left_anti").select("package_id", "v"))


def _paragraph_decisions(t: Tables) -> DataFrame:
    both = t["paragraphs"].select("package_id", F.col("paragraph_id").alias("target_id"), "page_id", F.col("source_id").alias("source_"), "source_role").join(_decided(t, "paragraph"), ["package_id", "target_id"])
    c = F.col
    whole = c("disposition").isin(*USES) & ~_blank(c("reading")) & ~_blank(c("reason")) & ~_blank(c("sourcepage_path")) & ~_blank(c("summary")) & (c("source_id") == c("source_")) & F.contains("sourcepage_path", "page_id") & c("role").isin(*ROLES)
    lists = reduce(lambda a, b: a & b, (c(n).isNotNull() for n in ("claims", "methods", "metrics", "boundaries", "leaps", "used_in_card", "needs_primary")))
    anchored = ~((c("disposition") == "used") & c("needs_primary") & (F.coalesce("source_role", F.lit("primary")) != "primary"))
    bad = both.where(_not(whole & lists & anchored)).select("package_id", F.col("target_id").alias("v"))
    return bad.unionByName(_leaps(t)).distinct()


def _objects(t: Tables) -> DataFrame:
    """Objects without a decision that fits their kind; a figure's assets must be kept and decided as well."""
    own = t["objects"].select("package_id", F.col("object_id").alias("target_id"), "object_kind", "asset_occurrence_ids")
    both = own.join(_decided(t, "object"), ["package_id", "target_id"], "left")
    c, true = F.col, lambda n: F.coalesce(n, F.lit(False))
    shown = (c("representation_status") == "verified") & (~c("object_kind").isin("table", "equation", "code") | true("source_verified")) & (~c("object_kind").isin("caption", "figure", "callout") | true("relations_reviewed"))
    good = c("disposition").isin(*USES) & ~_blank(c("reading")) & F.when(c("disposition") == "used", shown).otherwise(~_blank(c("reason")))
    kept = t["assets"].where("kept").select("package_id", F.col("occurrence_id").alias("a")).join(_decided(t, "asset").where("disposition in ('used', 'reference_only')").select("package_id", F.col("target_id").alias("a")), ["package_id", "a"], "left_semi")
    figures = both.where("object_kind = 'figure' and disposition = 'used'").select("package_id", F.col("target_id").alias("v"), F.explode("asset_occurrence_ids").alias("a"))
    return both.where(_not(good)).select("package_id", F.col("target_id").alias("v")).unionByName(figures.join(kept, ["package_id", "a"], "left_anti").select("package_id", "v")).distinct()


def _structure_review(t: Tables) -> DataFrame:
    """Packages whose structure must be reviewed and isn't, or not over all of their surfaces."""
    surfaces = t["surfaces"].groupBy("package_id").agg(F.collect_set("page_id").alias("pages_"))
    own = _structure(t).select("package_id", F.col("decision_id").alias("v"), "disposition", "reading", "reason", "covered_surface_ids")
    both = t["packages"].where("structure_required").select("package_id").join(surfaces, "package_id", "left").join(own, "package_id", "left")
    covers = F.array_sort(F.array_distinct("covered_surface_ids")) == F.array_sort("pages_")
    return both.where(_not((F.col("disposition") == "reviewed") & ~_blank(F.col("reading")) & ~_blank(F.col("reason")) & covers)).select("package_id", F.coalesce("v", F.lit("none")).alias("v"))


def _tier(t: Tables) -> DataFrame:
    runs = t["runs"].select(F.col("package_id").alias("of_"), F.col("run_id").alias("run_"), "target")
    both = t["packages"].select("package_id", "active_run_id").join(runs, (F.col("package_id") == F.col("of_")) & (F.col("active_run_id") == F.col("run_")), "left")
    return both.where(_not(F.col("target").isin("review", "citation"))).select("package_id", F.coalesce("target", F.lit("none")).alias("v"))


def _checks() -> list[tuple[str, Callable[[Tables], DataFrame], tuple[str, ...]]]:
    c = F.col
    return [
        ("schema_version", _of("packages", "package_version", _not(c("package_version") == 2)), ALL),
        ("source_identity", _of("packages", "source_sha256", _not(F.rlike("source_sha256", F.lit("^[0-9a-f]{64}$")))), ALL),
        ("lifecycle_active", _of("packages", "lifecycle", F.coalesce("lifecycle", F.lit("active")) != "active"), ALL),
        ("rights_basis", _of("packages", "package_id", _blank(c("rights_basis"))), ALL),
        ("tenant_scope", _of("packages", "package_id", (c("privacy") == "tenant") & _blank(c("tenant_id"))), ALL),
        ("workspace_scope", _of("packages", "package_id", (c("privacy") == "workspace") & _blank(c("workspace_id"))), ALL),
        ("canonical_variant_relation", _variants, ALL),
        ("review_ledger_binding", _bound("review_ledger", asked=True), ALL),
        ("assets_binding", _bound("assets"), ALL),
        ("objects_binding", _bound("objects"), ALL),
        ("active_binding", _bound("active"), ALL),
        ("review_decision_chain", _chain, ALL),
        ("canonical_revision_binding", _bound("canonical", asked=True), ALL),
        ("paragraph_projection_binding", _bound("paragraphs"), ALL),
        ("toc_projection_binding", _bound_to_structure("toc"), ALL),
        ("boundary_projection_binding", _bound_to_structure("boundaries"), ALL),
        ("immutable_artifact_integrity", _artifacts, ALL),
        ("scope_bound_to_run", _scope, ALL),
        ("binary_evidence_integrity", _binaries, ALL),
        ("epub_navigation_logical_surface_accounting", _epub(_navigation), REVIEWED),
        ("epub_callout_object_accounting", _epub(_unaccounted("assets", "occurrence_id", c("callout_role") == "code_callout", "callout", F.explode("asset_occurrence_ids"))), REVIEWED),
        ("epub_mathml_object_accounting", _epub(_unaccounted("evidence", "mathml_sha256", c("mathml_sha256").isNotNull(), "equation", c("source_id"))), REVIEWED),
        ("epub_preformatted_code_object_accounting", _epub(_unaccounted("evidence", "pre_text_sha256", c("pre_text_sha256").isNotNull(), "code", c("source_id"))), REVIEWED),
        ("epub_figure_caption_linkage", _epub(_of("objects", "object_id", (c("object_kind") == "figure") & ~_blank(c("caption_text")) & c("caption_object_id").isNull())), REVIEWED),
        ("epub_dom_heading_materialization", _epub(_unmaterialised), REVIEWED),
        ("epub_noncanonical_container_heading_accounting", _epub(_contained_once), REVIEWED),
        ("citation_evidence_tier", _tier, STRICT),
        ("citation_page_evidence_preserved", lambda t: _external(t).where("owner_kind = 'page'").select("package_id", c("owner").alias("v")), STRICT),
        ("paragraph_decision_integrity", _paragraph_decisions, STRICT),
        ("complex_object_accounting", _objects, STRICT),
        ("structure_semantic_review", _structure_review, STRICT),
    ]


def evaluate(tables: Tables, target: str = "citation", most: int = 100) -> DataFrame:
    """package_id, check_id, passed, n_observed and observed (the first ``most`` values, sorted) of the checks that a target asks for, a row
    for each package and check."""
    asked = [(name, failing) for name, failing, targets in _checks() if target in targets]
    parts = [failing(tables).select("package_id", F.lit(name).alias("check_id"), "v") for name, failing in asked]
    by = reduce(DataFrame.unionByName, parts).groupBy("package_id", "check_id", "v").agg(F.count("*").alias("c"))
    counted = by.groupBy("package_id", "check_id").agg(F.sum("c").alias("n"))
    place = F.row_number().over(Window.partitionBy("package_id", "check_id").orderBy("v"))
    first = by.withColumn("place", place).where(F.col("place") <= most).groupBy("package_id", "check_id").agg(F.array_sort(F.collect_list("v")).alias("first"))
    rows = tables["packages"].select("package_id", F.explode(F.array(*(F.lit(name) for name, _ in asked))).alias("check_id"))
    out = rows.join(counted, ["package_id", "check_id"], "left").join(first, ["package_id", "check_id"], "left")
    return out.select("package_id", "check_id", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0)).alias("n_observed"), F.coalesce("first", F.array().cast("array<string>")).alias("observed"))


def verdicts(report: DataFrame, target: str) -> DataFrame:
    """package_id, failed and status of a report: a citation with failures needs review, a lower target with failures fails."""
    failed = F.count_if(~F.col("passed"))
    good, bad = {"hint": ("HINT_READY", "FAIL"), "review": ("REVIEW_READY", "FAIL"), "citation": ("PASS_STRICT", "FAIL_REVIEW")}[target]
    return report.groupBy("package_id").agg(failed.alias("failed")).select("package_id", "failed", F.when(F.col("failed") == 0, good).otherwise(bad).alias("status"))


def warnings(tables: Tables) -> DataFrame:
    """package_id, code and value of what doesn't fail a package: references to files outside of it."""
    return _external(tables).select("package_id", F.lit("external_binary_references").alias("code"), F.concat_ws(":", "owner", "path").alias("v"))
