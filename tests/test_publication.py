"""What publications and reviews need beside the registered queries."""

import pytest

from codexloom.operators import publication, rebuild
from codexloom.sources import dom


def test_export_paths():
    assert publication.export_paths("/a/b.md")["chunks"] == "/a/b.chunks.jsonl" and publication.export_paths("/a/b.MD")["document"] == "/a/b.MD"
    assert publication.export_paths("/a.b/c/")["document"] == "/a.b/c/document.md" and publication.export_paths("out")["embedding"] == "out/embedding_manifest.json"


def test_reviewers():
    good = {"verified": True, "reviewer_type": "human", "reviewer_id": "r", "review_session_id": "s", "tenant_id": "t"}
    assert publication.reviewer_findings(good, {"tenant_id": "t"}) == []
    assert publication.reviewer_findings({"reviewer_type": "machine"}, {"workspace_id": "w"}) == ["verified", "reviewer_type", "reviewer_id", "review_session_id", "workspace_id"]


def test_first_files_and_revisions(spark):
    files = spark.createDataFrame([("c.txt", False), ("a.PDF", False), ("b.xyz", False), ("d.md", True)], "path string, link boolean")
    rows = publication.first_files(files, (".txt", ".pdf", ".md"), 2).collect()
    assert [r.path for r in rows] == ["a.PDF", "c.txt"]
    assert [(r.path, r.finding) for r in publication.first_files(files, (".txt",), None).collect()] == [("c.txt", None), ("d.md", "link")]
    assert rebuild.applies("r1", None) and rebuild.applies("r1", "r1") and not rebuild.applies("r2", "r1")
    log = spark.createDataFrame([(1, "page", "p", "S", "r_1", "c1"), (2, "page", "p", "S", "r_2", "c2"), (3, "paragraph", "q", "S", "r_1", "c0"), (4, "paragraph", "q", "S", "r_1", "c1"), (5, "page", "z", "T", "r_1", "c1")], "seq int, kind string, target_id string, source_sha256 string, active_run_id string, canonical_revision string")
    assert {r.seq for r in rebuild.rehydrated(log, "S", "r_1", "c1").collect()} == {1, 4}


def test_rebuild_reads_its_tables_once_or_twice(spark):
    """Decisions are judged in one pass over blocks and two over observations, and applied in one more over blocks; rows are right with a join that passes over an exclusion and one that lacks a member."""
    rows = [("d", "p1" if k < 4 else "p2", f"b{k}", k, f"e{k}", f"t{k}") for k in range(1, 10)]
    made = [("x", "exclude_block", "b2", None, None, None, "noise", None), ("j", "join_blocks_across_surfaces", "b1", ["b1", "b3", "b4"], None, None, None, None), ("m", "join_blocks_across_surfaces", "b5", ["b5", "b6", None], "t", None, None, None), ("o", "reorder_blocks", "b8", ["b9", "b8"], None, None, None, None), ("v", "select_variant", "b7", None, None, "w7", None, None)]
    blocks = spark.createDataFrame(rows, "doc_id string, page_id string, block_id string, ordinal int, evidence_id string, text string")
    decisions = spark.createDataFrame(made, rebuild.DECISIONS)
    observed = spark.createDataFrame([(e, p, f"g{e}", t) for _, p, _, _, e, t in rows] + [("w7", "p2", "ge7", "T7")], "evidence_id string, page_id string, variant_group_id string, text string")
    assert sorted(tuple(r) for r in rebuild.findings(blocks, decisions, observed).collect()) == [("m", "member_missing")]
    out = rebuild.rebuild(blocks, decisions, observed)
    assert [(r.place, r.text, r.decision_id) for r in out.orderBy("place").collect()] == [(1, "t1 t3 t4", "j"), (2, "t2", "x"), (3, "t5", None), (4, "t6", None), (5, "T7", "v"), (6, "t9", "o"), (7, "t8", "o")]
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 5


def test_object_rows(spark):
    objects = spark.createDataFrame([("k", "o", ["b", "a", "x"]), ("k", "e", [])], "package_id string, object_id string, asset_occurrence_ids array<string>")
    exported = spark.createDataFrame([("k", "a", "as/a"), ("k", "b", "as/b")], "package_id string, occurrence_id string, export_path string")
    assert {r.object_id: (r.object_uri, r.asset_export_paths) for r in publication.object_rows(objects, exported).collect()} == {"o": ("package://k/object/o", ["as/b", "as/a"]), "e": ("package://k/object/e", [])}


def test_broken_pages_and_encodings(spark):
    rows = [("latin", "<?xml version='1.0' encoding='iso-8859-1'?><p>café".encode("latin-1")), ("bad", b"<?xml version='1.0' encoding='x-none'?><p>x"), ("none", None)]
    got = {r.page_id: r for r in dom.dom_ledger(spark.createDataFrame([(a, None if b is None else bytearray(b)) for a, b in rows], "page_id string, content binary")).collect()}
    assert got["latin"].text == "café" and got["bad"].error and "none" not in got
    sheets = spark.createDataFrame([("a", "<p class=x>no</p><p>yes</p>", [".x { visibility: hidden }"])], "page_id string, content string, css array<string>")
    assert [r.text for r in dom.dom_ledger(sheets, sheets_col="css").collect()] == ["yes"]


@pytest.mark.parametrize(("page", "texts"), [("<div hidden><p>a</div>b", ["b"]), ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]), ("</p></td>x<", ["x<"]), ("<p>a<table><td>b<p>c</table>d", ["a", "b", "c", "d"]), ("", [])])
def test_trees_of_broken_pages(page, texts):
    assert [r["text"] for r in dom.nodes_of(page)] == texts
