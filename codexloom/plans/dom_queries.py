"""Pages and their nodes: literal pages with exact rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import dom, html
from .common import query, values

PAGES = [
    ("p1", "<html><head><title>t</title><style>.x, #y {display:none} span.b{display: block}</style></head><body><h1 id=c1>A &amp; b</h1><p>one <b>two</b><br>three<p class=x>no<p hidden>no<div id=y>no</div><p>a<span class=b>q</span></p></body></html>"),
    ("p2", "<body><table><caption>Cap</caption><tr><th>h<td rowspan=2><p>c1<p>c2</td></tr></table><pre class='language-py'>a <img src='callouts/1.png' alt=1>\n b</pre></body>"),
    ("p3", "<body><figure><img src=z.png><figcaption>Fig. <i>1</i></figcaption></figure><p>f <math><mfrac><mi>a</mi><mi>b</mi></mfrac></math></p><nav epub:type='x toc'><ol><li><a href='a.html'>One</a><li><a href='b.html'>Two</a></ol></nav>"),
    ("p4", "<script>x</script><p></p>"),
    ("p5", None),
]
_NODES = [
    ("p1", 1, "text", "0.1.0.0", "A & b", "A & b", "h1", None), ("p1", 2, "text", "0.1.1.0", "one", "one two\nthree", "p", None), ("p1", 3, "text", "0.1.1.1.0", "two", "one two\nthree", "b", None), ("p1", 4, "text", "0.1.1.3", "three", "one two\nthree", "p", None),
    ("p1", 5, "text", "0.1.5.0", "a", "a\nq", "p", None), ("p1", 6, "text", "0.1.5.1.0", "q", "a\nq", "span", None),
    ("p2", 1, "text", "0.0.0.0", "Cap", "Cap", "caption", None), ("p2", 2, "text", "0.0.1.0.0", "h", "h", "th", "0/0/1"), ("p2", 3, "text", "0.0.1.1.0.0", "c1", "c1", "p", "0/1/2"), ("p2", 4, "text", "0.0.1.1.1.0", "c2", "c2", "p", "0/1/2"),
    ("p2", 5, "text", "0.1.0", "a", "a \n b", "pre", "py"), ("p2", 6, "callout", "0.1.1", "[[Callout 1]]", "a \n b", "img", "py"), ("p2", 7, "text", "0.1.2", "b", "a \n b", "pre", "py"),
    ("p3", 1, "text", "0.0.1.0", "Fig.", "Fig. 1", "figcaption", "Fig. 1"), ("p3", 2, "text", "0.0.1.1.0", "1", "Fig. 1", "i", "Fig. 1"), ("p3", 3, "text", "0.1.0", "f", "f ab", "p", None), ("p3", 4, "math", "0.1.1", "a/b", "f ab", "math", None),
    ("p3", 5, "text", "0.2.0.0.0.0", "One", "One", "a", "toc:a.html"), ("p3", 6, "text", "0.2.0.1.0.0", "Two", "Two", "a", "toc:b.html"),
]


def _ledger(spark):
    return dom.dom_ledger(spark.createDataFrame(PAGES, "page_id string, content string"))


@query(f"SELECT * FROM {values(_NODES, 'page_id, ordinal, kind, path, text, container, tag, role')}")
def q74_dom_ledger(spark, sf_dir):
    rows = _ledger(spark)
    cell = F.concat_ws("/", "row_index", "cell_index", "rowspan")
    role = F.coalesce(F.concat(F.col("nav_type"), F.lit(":"), F.col("link_href")), "figure_caption", "code_language", F.when(F.col("row_index").isNotNull(), cell))
    return rows.select("page_id", "ordinal", "kind", F.array_join(F.transform("dom_path", lambda x: x.cast("string")), ".").alias("path"), "text", F.col("container_text").alias("container"), "tag", role.alias("role"))


_FOUND = [("p1", "heading", "1", "A & b"), ("p3", "figure", "0.0", "Fig. 1"), ("p3", "toc", "a.html", "One"), ("p3", "toc", "b.html", "Two")]


@query(f"SELECT * FROM {values(_FOUND, 'page_id, what, place, text')}")
def q75_dom_views(spark, sf_dir):
    rows = _ledger(spark)
    heads = dom.headings(rows).select("page_id", F.lit("heading").alias("what"), F.col("level").cast("string").alias("place"), "text")
    figures = dom.figure_captions(rows).select("page_id", F.lit("figure").alias("what"), F.array_join(F.transform("figure_path", lambda x: x.cast("string")), ".").alias("place"), F.col("caption").alias("text"))
    nav = dom.navigation(rows).select("page_id", F.col("nav_type").alias("what"), F.col("href").alias("place"), F.col("title").alias("text"))
    return heads.unionByName(figures).unionByName(nav)


_BLOCKS = [(1, 1, "h1", "A & b"), (1, 2, "p", "one"), (1, 3, "p", "two"), (1, 4, "li", "i"), (1, 5, "li", "j"), (2, 1, "p", "before"), (2, 2, "table", "c d after"), (2, 3, "p", "c"), (2, 4, "p", "d")]
BLOCK_PAGES = [(1, "<h1>A &amp; b</h1><p>one<p>two<script>x</script><ul><li>i<li>j</ul><p style='display: none'>no<p hidden>no"), (2, "<p>before<table><tr><td><p>c</td><td><p>d</td><td>after</td></tr></table>"), (3, ""), (4, None)]


@query(f"SELECT * FROM {values(_BLOCKS, 'page_id, ordinal, tag, text')}")
def q76_literal_blocks(spark, sf_dir):
    """The blocks that q08 counts, of literal pages."""
    return html.page_blocks(spark.createDataFrame(BLOCK_PAGES, "page_id long, html string"), "page_id", "html").select("page_id", "ordinal", "tag", "text")
