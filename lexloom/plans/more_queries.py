"""Further registered queries: collections, links, layout, cleaned trees, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, styles, text, titles
from ..operators import clean, layout, relational, templates, tree, wikitext
from ..sources import stores
from ..streaming import jobs
from .queries import query, t


@query("""SELECT n_nationkey AS doc_id, CAST(v.line_no AS INTEGER) AS line_no, v.type AS type, CASE v.line_no WHEN 0 THEN n_name WHEN 1 THEN 'Part' WHEN 2 THEN n_name ELSE 'Old' END AS title, CASE v.line_no WHEN 2 THEN 'shown' WHEN 3 THEN 'then' END AS displaytitle, CASE v.line_no WHEN 3 THEN CAST(n_regionkey AS VARCHAR) END AS revision, CAST(v.line_no > 0 AS BIGINT) AS chapter_no
FROM nation, (VALUES (0, 'title'), (1, 'chapter'), (2, 'article'), (3, 'oldarticle')) v(line_no, type)""")
def collection_pages(spark, sf):
    book = F.concat(F.lit("=="), F.col("n_name"), F.lit("==\n;Part\n:[["), F.col("n_name"), F.lit("|shown]]\n:[{{fullurl:Old|oldid="), F.col("n_regionkey"), F.lit("}} then]"))
    return stores.parse_collection_pages(t(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), book.alias("text")))


@query("""SELECT r_name AS book, CAST(v.item_no AS INTEGER) AS item_no, v.type AS type, CASE v.item_no WHEN 1 THEN 'One' WHEN 2 THEN r_name ELSE 'Last' END AS title, CAST(1 AS BIGINT) AS chapter_no FROM region, (VALUES (1, 'chapter'), (2, 'article'), (3, 'article')) v(item_no, type)""")
def collection_items(spark, sf):
    item = lambda kind, title, inner: F.struct(F.lit(kind).alias("type"), title.alias("title"), F.lit(None).cast("string").alias("displaytitle"), F.lit(None).cast("string").alias("revision"), inner.alias("items"))
    none = F.array().cast("array<struct<type:string,title:string,displaytitle:string,revision:string>>")
    inner = F.array(F.struct(F.lit("Article").alias("type"), F.col("r_name").alias("title"), F.lit(None).cast("string").alias("displaytitle"), F.lit(None).cast("string").alias("revision")))
    books = t(spark, sf, "region").select(F.col("r_name").alias("title"), F.array(item("Chapter", F.lit("One"), inner), item("article", F.lit("Last"), none)).alias("items"))
    return relational.metabook_items(books).select("book", F.col("item_no").cast("int").alias("item_no"), "type", "title", "chapter_no")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'http://fr/' || replace(c_name, ' ', '_') END AS url FROM customer""")
def interwiki_links(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit(" FR: ")).otherwise(F.lit("xx:")), F.col("c_name")).alias("title"))
    return titles.interwiki(rows, spark.createDataFrame([("fr", "http://fr/$1")], "prefix string, url string")).select("c_custkey", F.col("iw_url").alias("url"))


@query("SELECT n_nationkey, CAST(n_nationkey | 1 AS INTEGER) AS talk, CAST(n_nationkey & -2 AS INTEGER) AS subject FROM nation")
def talk_namespaces(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", titles.talk_ns("n_nationkey").cast("int").alias("talk"), titles.subject_ns("n_nationkey").cast("int").alias("subject"))


@query("""SELECT n_name AS title FROM nation WHERE n_nationkey % 3 <> 0 AND NOT (n_nationkey % 3 = 1 AND EXISTS (SELECT 1 FROM nation m WHERE m.n_nationkey % 3 = 0 AND m.n_nationkey = nation.n_nationkey - 1))""")
def missing_titles(spark, sf):
    """Titles that were seen neither themselves (a third is) nor under the redirect of every second other one."""
    n = t(spark, sf, "nation")
    seen = n.where(F.col("n_nationkey") % 3 == 0).select(F.col("n_name").alias("title"))
    redirects = n.where(F.col("n_nationkey") % 3 == 1).select(F.col("n_name").alias("from_title"), (F.col("n_nationkey") - 1).alias("k")).join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("to_title")), "k").drop("k")
    return relational.missing(n.select(F.col("n_name").alias("title")), seen, redirects)


@query("""SELECT p_partkey, 'Target ' || p_partkey AS target, 'label' AS label, CAST(0 AS INTEGER) AS link_no FROM part""")
def flat_links(spark, sf):
    s = F.concat(F.lit("see [[Target "), F.col("p_partkey"), F.lit("|label]] and [[a\nb]]"))
    return markup.links(t(spark, sf, "part").select("p_partkey", s.alias("text"))).select("p_partkey", "target", "label", "link_no")


@query("""SELECT page_id, url AS url, 'name ' || page_id AS label FROM pages""")
def named_urls(spark, sf):
    s = F.concat(F.lit("x ["), F.col("url"), F.lit(" name "), F.col("page_id"), F.lit("] y [http://open"))
    return markup.named_urls(t(spark, sf, "pages").select("page_id", s.alias("text"))).select("page_id", "url", "label")


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS pos, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f) AS number, 'http://' || l_shipmode AS url FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_shipmode) AS f FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode FROM lineitem))""")
def url_footnotes(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("//"), "l_returnflag", "l_linestatus").alias("url"))
    return layout.url_footnotes(rows)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN p_size % 2 <> 0 ELSE TRUE END AS bordered FROM part""")
def table_borders(spark, sf):
    k = F.col("p_partkey") % 4
    a = F.when(k == 0, F.create_map(F.lit("class"), F.lit("big wikitable"))).when(k == 1, F.create_map(F.lit("class"), F.lit("cquote"), F.lit("border"), F.lit("1"))).when(k == 2, F.create_map(F.lit("border"), F.when(F.col("p_size") % 2 == 0, F.lit("0")).otherwise(F.lit("2")))).otherwise(F.create_map(F.lit("bgcolor"), F.lit("red")))
    return t(spark, sf, "part").select("p_partkey", styles.has_border(a, F.create_map().cast("map<string,string>")).alias("bordered"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'lower-alpha' WHEN 1 THEN 'upper-roman' WHEN 2 THEN 'decimal' ELSE 'disc' END AS marker FROM part""")
def list_markers(spark, sf):
    k = F.col("p_size") % 4
    kind = F.when(k == 0, F.lit("a")).when(k == 1, F.lit("I"))
    return t(spark, sf, "part").select("p_partkey", styles.list_marker(kind, k == 2).alias("marker"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || ', ' || c_custkey || ' anonymous contributors' END AS line FROM customer""")
def author_lines(spark, sf):
    anon = F.concat(F.lit("ANONIPEDITS:"), F.when(F.col("c_custkey") % 2 == 0, F.lit("0")).otherwise(F.col("c_custkey").cast("string")))
    return t(spark, sf, "customer").select("c_custkey", text.authors_text(F.array("c_name", anon)).alias("line"))


@query("""SELECT p_partkey, round(least(p_size * 10 * 0.75, p_size * 20 / 75.0 * 72, 470 * 0.6), 4) AS width FROM part""")
def print_sizes(spark, sf):
    rows = t(spark, sf, "part").select("p_partkey", (F.col("p_size") * 20).alias("w"), (F.col("p_size") * 10).alias("h"), (F.col("p_size") * 10).alias("wanted"), F.lit(True).alias("thumb"), F.lit(False).alias("inline"))
    return rows.select("p_partkey", F.round(styles.print_size("w", "h", "wanted", "thumb", "inline")["width"], 4).alias("width"))


@query("""SELECT table_id, col, round(lo + least(hi - lo, greatest(0, 300 - sum(lo) OVER (PARTITION BY table_id)) * (hi - lo) / nullif(sum(hi - lo) OVER (PARTITION BY table_id), 0)), 4) AS width FROM (
SELECT c_nationkey AS table_id, CAST(c_custkey % 5 AS INTEGER) AS col, max(CAST(10 + c_custkey % 7 AS DOUBLE)) AS lo, max(CAST(40 + c_custkey % 50 AS DOUBLE)) AS hi FROM customer GROUP BY 1, 2)""")
def column_widths(spark, sf):
    k = F.col("c_custkey")
    cells = t(spark, sf, "customer").select(F.col("c_nationkey").alias("table_id"), (k % 5).cast("int").alias("col"), F.lit(1).alias("colspan"), (10 + k % 7).cast("double").alias("min_width"), (40 + k % 50).cast("double").alias("max_width"))
    return layout.column_widths(cells, 300.0).withColumn("width", F.round("width", 4))


def _cleaned(spark, sf):
    s = F.concat(F.lit("== Kept ==\n"), F.col("p_name"), F.lit(" words<ref name=a>the note</ref> and<ref name=a/>\n\n== Gone ==\n\n== See also ==\n* [[x]]\n\n[[Category:"), F.col("p_brand"), F.lit("]]\n<div class=\"noprint\">hidden</div>"))
    return wikitext.parse_pages(t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), s.alias("text")), cleaner=clean.clean)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_name || ' words' || 'the note' || ' and' || 'the note' AS body, CAST(1 AS BIGINT) AS sections, CAST(0 AS BIGINT) AS categories FROM part""")
def cleaned_trees(spark, sf):
    nodes = _cleaned(spark, sf)
    inside = tree.ancestors(nodes.where((F.col("class") == "Text") | (F.col("class") == "Node")), ["Node"]).select("doc_id", "node_id")
    body = tree.texts(nodes.join(inside, ["doc_id", "node_id"], "left_anti").where((F.col("class") != "Text") | (F.col("caption") != "Kept")))
    counts = nodes.groupBy("doc_id").agg(F.count_if(F.col("class") == "Section").alias("sections"), F.count_if(F.col("class") == "CategoryLink").alias("categories"))
    return body.join(counts, "doc_id").select("doc_id", F.trim("text").alias("body"), "sections", "categories")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, '<p><b>' || p_name || '</b> and <i>x</i></p><ul><li>one</li></ul>' AS markup FROM part""")
def inline_markup(spark, sf):
    s = F.concat(F.lit("'''"), F.col("p_name"), F.lit("''' and ''x''\n* one"))
    return layout.inline_markup(wikitext.parse_pages(t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), s.alias("text"))))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(1 + p_size % 4 AS BIGINT) AS columns FROM part""")
def parsed_column_counts(spark, sf):
    s = F.concat(F.lit("{|\n|-\n| colspan=\""), 1 + F.col("p_size") % 4, F.lit("\" | a\n|}"))
    nodes = wikitext.parse_pages(t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), s.alias("text")))
    return layout.column_counts(layout.cells(nodes), "doc_id").select("doc_id", F.col("columns").cast("long").alias("columns"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(26 * ceil(length(p_name) / 40.0) AS BIGINT) AS height FROM part""")
def node_heights(spark, sf):
    nodes = wikitext.parse_pages(t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")))
    return tree.heights(nodes).where(F.col("class") == "Article").select("doc_id", F.col("height").cast("long").alias("height"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS source, unnest(['Template:Alpha', 'Template:Beta']) AS template FROM part""")
def template_edges(spark, sf):
    s = F.concat(F.lit("{{alpha|{{ beta }}}} {{#if:x|{{lc:Y}}}} "), F.col("p_name"))
    return templates.edges(t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("source"), s.alias("text")))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS c FROM events), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(spark, sf):
    return jobs.sessions(t(spark, sf, "events")).select("user_id", "start", "n")


@query("""SELECT time_bucket(INTERVAL '15 minutes', ts) - k.m * INTERVAL '15 minutes' AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1), (2), (3)) k(m) GROUP BY 1, 2""")
def sliding_windows(spark, sf):
    return jobs.sliding(t(spark, sf, "events"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%' THEN 'bad' ELSE o_orderpriority END AS shown FROM orders""")
def error_branches(spark, sf):
    bad = F.col("o_orderpriority").rlike("URGENT|HIGH")
    s = F.when(bad, F.concat(F.lit('<strong class="error">'), "o_orderpriority", F.lit("</strong>"))).otherwise(F.col("o_orderpriority"))
    return t(spark, sf, "orders").select("o_orderkey", text.iferror(s, F.lit("bad")).alias("shown"))


@query("""SELECT DISTINCT l_orderkey AS title, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS revid FROM lineitem WHERE l_linenumber <= 3""")
def edits_until(spark, sf):
    edits = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("title"), F.col("l_linenumber").alias("revid"))
    marks = edits.select("title").distinct().withColumn("revid", F.lit(3))
    return relational.edits_until(edits, marks).groupBy("title").agg(F.max("revid").alias("revid"))
