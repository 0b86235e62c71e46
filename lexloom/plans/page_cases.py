"""Further queries: addresses and namespaces, books, inherited colours, tags and placeholders in pages, statuses, template bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import styles, text, titles
from ..operators import layout, relational, templates, tree, wikitext
from ..streaming import jobs
from .lifecycle import node_table
from .queries import query, t

N = "s_suppkey"


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Talk' WHEN 1 THEN 'Template' WHEN 2 THEN 'Category' ELSE '' END AS ns, s_suppkey % 2 = 0 AS same FROM supplier""")
def namespace_names(spark, sf):
    number = F.element_at(F.array(F.lit(1), F.lit(10), F.lit(14), F.lit(9999)), (F.col(N) % 4 + 1).cast("int"))
    return t(spark, sf, "supplier").select(N, F.coalesce(titles.namespace_name(number), F.lit("")).alias("ns"), (titles.talk_ns(F.lit(2)) == F.when(F.col(N) % 2 == 0, F.lit(3)).otherwise(F.lit(2))).alias("same"))


@query("""SELECT row_number() OVER (ORDER BY n) AS place, CAST(n AS VARCHAR) AS value FROM (SELECT c_custkey AS n FROM customer) UNION ALL SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY n_name), n_name FROM nation""")
def mixed_order(spark, sf):
    """Numbers in their order, then texts in theirs."""
    rows = t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("value")).unionByName(t(spark, sf, "nation").select(F.col("n_name").alias("value")))
    return relational.type_sorted(rows, "value").coalesce(1).select((F.monotonically_increasing_id() + 1).alias("place"), "value")


@query("""SELECT DISTINCT c_name AS title FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'Index/' || k FROM (SELECT unnest(range(3, 8)) AS k)""")
def main_pages_and_ranges(spark, sf):
    pages = t(spark, sf, "customer").select(F.col("c_name").alias("title"), (F.col("c_custkey") % 2).cast("int").alias("ns"))
    return relational.articles(pages).unionByName(relational.page_range("Index", 3, 7, spark))


@query("""SELECT o_orderkey, 'T' || o_custkey AS target FROM orders WHERE o_custkey % 3 = 0""")
def links_in_book(spark, sf):
    links = t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("T"), F.col("o_custkey")).alias("target"))
    articles = t(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("T"), F.col("c_custkey")).alias("title"))
    return relational.in_book(links, articles, "http://w/").select("o_orderkey", "target")


@query("""SELECT 'http://h/' || s_nationkey AS path, count(*) AS n FROM supplier GROUP BY 1""")
def titles_by_path(spark, sf):
    rows = t(spark, sf, "supplier").select(F.concat(F.lit("File:"), F.col(N)).alias("title"), F.concat(F.lit("http://h/"), F.col("s_nationkey"), F.lit("/"), F.col(N)).alias("descriptionurl"))
    return relational.by_path(rows).select("path", F.size("titles").cast("long").alias("n"))


@query("""SELECT page_id, 'http://h/w/api.php' AS near FROM pages""")
def api_places(spark, sf):
    places = text.api_candidates(F.concat(F.lit("http://h/w/index.php?title="), F.col("page_id")))
    return t(spark, sf, "pages").select("page_id", F.filter(places, lambda x: x == "http://h/w/api.php")[0].alias("near"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(1 AS BIGINT) AS red, CAST(s_suppkey % 3 + 1 AS BIGINT) AS blue FROM supplier""")
def inherited_colours(spark, sf):
    """A blue box with one to three words of its own, and a red one in it."""
    k = (F.col(N) % 3 + 1).cast("int")
    page = F.concat(F.lit('<div bgcolor="blue">'), F.repeat(F.lit("<b>w</b>"), k), F.lit('<span bgcolor="red"><i>r</i></span></div>'))
    nodes = wikitext.parse_pages(t(spark, sf, "supplier").select(F.col(N).alias("doc_id"), page.alias("text")), columns=["node_id", "parent", "post", "class", "attrs"])
    colour = styles.colour("value")
    found = tree.inherited(nodes, "bgcolor").join(nodes.where(F.col("class").isin("Strong", "Emphasized")).select("doc_id", "node_id"), ["doc_id", "node_id"])
    return found.groupBy("doc_id").agg(F.count_if(colour["r"] == 1).alias("red"), F.count_if(colour["b"] == 1).alias("blue"))


_TAGS = ("Reference", "Gallery", "ImageLink", "Math", "Source", "BreakingReturn", "TagNode", "Span")


@query(" UNION ALL ".join(f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, '{c}' AS class, CAST({n} AS BIGINT) AS n FROM supplier" for c, n in (
    ("Reference", "s_suppkey % 3 + 1"), ("Gallery", "1"), ("ImageLink", "s_suppkey % 3 + 1"), ("Math", "s_suppkey % 3 + 1"), ("Source", "1"), ("BreakingReturn", "s_suppkey % 3 + 1"), ("Span", "1"))))
def tag_nodes(spark, sf):
    """Opaque and plain tags, each as often as the row says."""
    k = (F.col(N) % 3 + 1).cast("int")
    page = F.concat(F.repeat(F.lit("a<ref>n</ref> <math>x</math><br/>"), k), F.lit("\n<gallery>\n"), F.repeat(F.lit("File:a.png|c\n"), k), F.lit("</gallery>\n<source lang=\"c\">x [[y]]</source> <span>s</span> <unknown>t</unknown>"))
    nodes = wikitext.parse_pages(t(spark, sf, "supplier").select(F.col(N).alias("doc_id"), page.alias("text")), columns=["class"])
    return nodes.where(F.col("class").isin(*_TAGS)).groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(p_size % 3 + 1 AS BIGINT) AS items, CAST(1 AS BIGINT) AS sections FROM part""")
def whole_lifecycle(spark, sf):
    """Templates, parsing and cleaning of whole pages."""
    raw = F.concat(F.lit("== S ==\n"), F.repeat(F.lit("{{item|x}}\n"), (F.col("p_size") % 3 + 1).cast("int")), F.lit("\n== Empty ==\n"))
    pages = t(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), raw.alias("rawtext"))
    nodes = node_table(pages, spark.createDataFrame([("Template:Item", "* {{{1}}}")], "name string, body string"))
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("class") == "Item").alias("items"), F.count_if(F.col("class") == "Section").alias("sections"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS page_id, 'x' || p_name || 'x' AS text FROM part""")
def template_bundles(spark, sf):
    """The same expansion with bundles found by joins, as for template tables of any size; the inner template's name is itself made by a template."""
    raw = F.concat(F.lit("{{outer|"), F.col("p_name"), F.lit("}}"))
    pages = t(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), raw.alias("rawtext"))
    rows = [("Template:Outer", "x{{ {{name}}|{{{1}}}}}x"), ("Template:Name", "inner"), ("Template:Inner", "{{{1}}}")]
    return templates.expand_pages(pages, spark.createDataFrame(rows, "name string, body string"), broadcast_bytes=0).select("page_id", "text")


@query("""SELECT 'c' || event_id AS collection, CASE event_id % 3 WHEN 0 THEN 'finished' WHEN 1 THEN 'failed' ELSE 'progress' END AS status FROM events""")
def render_statuses(spark, sf):
    k = F.col("event_id") % 3
    rows = t(spark, sf, "events").select(F.concat(F.lit("c"), F.col("event_id")).alias("collection"), F.lit("rl").alias("writer"), F.lit("success").alias("zip_state"), F.when(k == 0, F.lit("success")).when(k == 1, F.lit("error")).otherwise(F.lit("running")).alias("render_state"), F.when(k == 1, F.lit("x")).alias("render_error"))
    return jobs.render_status(rows).select("collection", "status")


@query("""SELECT CAST(c_custkey AS BIGINT) AS ord, CAST(c_custkey // 4 AS BIGINT) AS "row", CAST(c_custkey % 4 AS BIGINT) AS col FROM customer""")
def gallery_places(spark, sf):
    return layout.gallery_rows(t(spark, sf, "customer").select(F.col("c_custkey").alias("ord"))).select("ord", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query("""SELECT 'r' || c_custkey AS from_title, 'r' || (c_custkey - c_custkey % 10 + 8) AS to_title FROM customer WHERE c_custkey % 10 < 8 UNION ALL SELECT 'loop' || v.k, 'loop0' FROM (VALUES (0), (1), (2)) v(k)""")
def redirect_ends(spark, sf):
    """Chains of eight redirects each, and a cycle of three."""
    chain = t(spark, sf, "customer").where("c_custkey % 10 < 8").select(F.concat(F.lit("r"), F.col("c_custkey")).alias("from_title"), F.concat(F.lit("r"), F.col("c_custkey") + 1).alias("to_title"))
    loop = spark.createDataFrame([("loop0", "loop1"), ("loop1", "loop2"), ("loop2", "loop0")], "from_title string, to_title string")
    return relational.redirect_chains(chain.unionByName(loop))
