"""Queries that write page stores and read them back, and queries over trees, layout, queues and resources, with results that SQL works out."""

from __future__ import annotations

import io
import json
import sqlite3
import tempfile
import zipfile

from pyspark.sql import functions as F

from ..functions import markup
from ..operators import layout, relational, resources, tree, wikitext
from ..session import shared_folder
from ..sources import stores
from ..streaming import jobs
from .queries import query, t

_PAGES = "SELECT CAST(0 AS INTEGER) AS ns, c_name AS title, c_custkey AS revid, c_custkey % 2 = 0 AS expanded, c_mktsegment || chr(10) || 'line two' AS rawtext FROM customer"


def _pages(spark, sf):
    return t(spark, sf, "customer").select(F.lit(0).alias("ns"), F.col("c_name").alias("title"), F.col("c_custkey").alias("revid"), (F.col("c_custkey") % 2 == 0).alias("expanded"), F.concat("c_mktsegment", F.lit("\nline two")).alias("rawtext"))


# -- stores ------------------------------------------------------------------------------------------------------------------
@query(_PAGES)
def revision_files(spark, sf):
    path = shared_folder(spark, "revisions")
    stores.write_revisions(_pages(spark, sf), path)
    return stores.read_revision_folder(spark, path)


@query("SELECT c_name AS title, c_custkey AS pageid, c_custkey + 1 AS revid, c_mktsegment AS text FROM customer")
def dump_pages(spark, sf):
    """An XML dump, compressed, with two revisions a page, of which the last counts."""
    path = shared_folder(spark, "dump")
    revision = lambda k, text: F.struct(k.alias("id"), text.alias("text"))
    rows = t(spark, sf, "customer").select(F.col("c_name").alias("title"), F.col("c_custkey").alias("id"), F.array(revision(F.col("c_custkey"), F.lit("old")), revision(F.col("c_custkey") + 1, F.col("c_mktsegment"))).alias("revision"))
    rows.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").option("compression", "bzip2").save(path)
    return stores.read_dump(spark, path).select("title", "pageid", "revid", "text")


@query("SELECT v.wiki AS wiki_id, n_name AS title, n_nationkey AS revid FROM nation, (VALUES ('one'), ('two')) v(wiki) WHERE v.wiki = 'one' OR n_nationkey % 2 = 0")
def several_wikis(spark, sf):
    root = shared_folder(spark, "wikis")
    pages = t(spark, sf, "nation").select(F.lit(0).alias("ns"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("long").alias("revid"), F.lit(False).alias("expanded"), F.lit("text").alias("rawtext"))
    for name, rows in (("one", pages), ("two", pages.where("revid % 2 = 0"))):
        stores.write_revisions(rows, f"{root}/{name}/revisions-1.txt")
    return stores.open_wikis(spark, {"one": f"{root}/one", "two": f"{root}/two"}).select("wiki_id", "title", "revid").withColumn("revid", F.col("revid").cast("int"))


@query("SELECT n_name AS from_title, 'T' || n_nationkey AS to_title FROM nation")
def snapshot_sidecars(spark, sf):
    root = shared_folder(spark, "snapshot")
    rows = t(spark, sf, "nation").select("n_name", F.concat(F.lit("T"), F.col("n_nationkey")).alias("to")).collect()
    stores.put(spark, f"{root}/redirects.json", json.dumps({r["n_name"]: r["to"] for r in rows}).encode())
    stores.put(spark, f"{root}/excluded.json", json.dumps(["x"]).encode())
    tables = stores.open_snapshot(spark, root)
    return tables["redirects"].join(tables["excluded"], F.col("from_title") == F.col("title"), "left_anti")


@query("SELECT 'pages/' || n_nationkey || '.txt' AS name, n_name AS content FROM nation")
def zipped_snapshot(spark, sf):
    rows = t(spark, sf, "nation").select("n_nationkey", "n_name").collect()
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for r in rows:
            z.writestr(f"pages/{r['n_nationkey']}.txt", r["n_name"])
    path = stores.put(spark, shared_folder(spark, "zip") + "/a.zip", blob.getvalue())
    return stores.read_zip(spark, path).select("name", F.col("content").cast("string").alias("content"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation")
def key_value_database(spark, sf):
    rows = t(spark, sf, "nation").select("n_nationkey", "n_name").collect()
    with tempfile.TemporaryDirectory() as d:  # the driver's own, to make the file's bytes
        with sqlite3.connect(f"{d}/x.db") as db:
            db.execute("CREATE TABLE unnamed (key TEXT PRIMARY KEY, value TEXT)")
            db.executemany("INSERT INTO unnamed VALUES (?, ?)", [(str(r["n_nationkey"]), r["n_name"]) for r in rows])
        db.close()
        with open(f"{d}/x.db", "rb") as f:
            blob = f.read()
    return stores.read_sqlite(spark, stores.put(spark, shared_folder(spark, "kv") + "/x.db", blob)).select("key", "value")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, '{\"c_name\":\"' || c_name || '\"}' AS value FROM customer")
def key_value_table(spark, sf):
    path = shared_folder(spark, "pairs")
    stores.write_key_values(t(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", path)
    return spark.read.schema("key string, value string").parquet(path)


@query("SELECT 'Book' AS book, CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS item_no, 'article' AS type, n_name AS title FROM nation")
def metabook_files(spark, sf):
    rows = t(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()
    book = {"type": "collection", "version": 1, "title": "Book", "items": [{"type": "Article", "title": r["n_name"]} for r in rows]}
    path = stores.put(spark, shared_folder(spark, "book") + "/metabook.json", json.dumps(book, indent=1).encode())
    return relational.metabook_items(stores.read_metabook(spark, path)).select("book", "item_no", "type", "title")


def _answers(spark, sf):
    rows = t(spark, sf, "nation").select("n_nationkey", "n_name").collect()
    made = []
    for r in rows:
        k = r["n_nationkey"]
        page = {"pageid": k, "ns": 0, "title": r["n_name"], "revisions": [{"revid": 10 * k, "user": "U", "comment": "c"}, {"revid": 10 * k + 1, "user": "1.2.3.4", "anon": ""}], "images": [{"title": f"File:{k}.png"}], "templates": [{"title": "Template:T"}], "contributors": [{"name": f"N{k}"}], "anoncontributors": k}
        made.append(json.dumps({"query": {"pages": {str(k): page}, "redirects": [{"from": f"R{k}", "to": r["n_name"]}]}}))
    path = stores.put(spark, shared_folder(spark, "answers") + "/a.jsonl", "\n".join(made).encode())
    return stores.read_responses(spark, path)


@query("SELECT n_name AS title, CAST(10 * n_nationkey + v.i AS BIGINT) AS revid, v.i = 1 AS anon, CAST(n_nationkey AS BIGINT) AS anonymous, 'N' || n_nationkey AS name, 'R' || n_nationkey AS from_title, 'File:' || n_nationkey || '.png' AS image FROM nation, (VALUES (0), (1)) v(i)")
def stored_answers(spark, sf):
    a = _answers(spark, sf)
    images = relational.used(stores.response_pages(a).select(F.transform("images", lambda x: x["title"]).alias("images")), "images")["images"].withColumnRenamed("images", "image")
    edits = stores.response_edits(a).select("title", "revid", "anon").join(stores.response_contributors(a).select("title", "name", F.col("anoncontributors").alias("anonymous")), "title")
    out = edits.join(stores.response_redirects(a).withColumnRenamed("to_title", "title"), "title")
    return out.join(images, F.concat(F.lit("File:"), F.col("anonymous").cast("string"), F.lit(".png")) == F.col("image")).withColumn("anonymous", F.col("anonymous").cast("long"))


@query("SELECT page_id, 'http://h/i' || page_id || '.png' AS image, 'http://h/extensions/t' || page_id || '.png' AS drawn, 'a ' || page_id AS shown FROM pages")
def page_images(spark, sf):
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit("<p>a <img src=\"http://h/i"), k, F.lit(".png\"><img src=\"http://h/extensions/t"), k, F.lit(".png\"></p>"), k, F.lit("<script>x</script>"))
    return t(spark, sf, "pages").select("page_id", markup.image_urls(html)[0].alias("image"), markup.extension_images(html)[0].alias("drawn"), markup.visible_text(html).alias("shown"))


# -- relations ------------------------------------------------------------------------------------------------------------------
@query("SELECT DISTINCT c_mktsegment AS title, FALSE AS numbered FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), TRUE FROM customer WHERE c_custkey % 2 = 1")
def requested_entries(spark, sf):
    items = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("title"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_custkey").cast("string")).alias("revision"))
    names, numbers = relational.split_requests(items)
    return names.select("title", F.lit(False).alias("numbered")).unionByName(numbers.select(F.col("revision").alias("title"), F.lit(True).alias("numbered")))


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'l,r' ELSE 'r' END AS list FROM customer")
def merged_lists(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    left = c.where("k % 3 < 2").select("k", F.array(F.lit("l")).alias("list"))
    right = c.where("k % 3 > 0").select("k", F.array(F.lit("r")).alias("list"))
    return relational.merged(left, right, "k").select("k", F.array_join("list", ",").alias("list"))


@query("SELECT 'unknown' || s_nationkey AS template, count(DISTINCT s_suppkey) AS images, least(5, count(DISTINCT s_suppkey)) AS samples FROM supplier WHERE s_nationkey > 3 GROUP BY 1")
def unknown_license_groups(spark, sf):
    known = spark.createDataFrame([(f"Unknown{k}", "x", "free") for k in range(4)], "name string, display_name string, license_class string")
    rows = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("image"), F.concat(F.lit("Unknown"), F.col("s_nationkey")).alias("template"))
    return relational.unknown_licenses(rows, known).select("template", "images", F.size("sample").cast("long").alias("samples"))


@query("SELECT p_brand AS category, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS n FROM part")
def category_listing(spark, sf):
    return relational.category_rows(t(spark, sf, "part"), "p_brand", "p_partkey").select(F.col("p_brand").alias("category"), F.col("n").cast("long").alias("n"))


@query("SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN '' ELSE c_mktsegment END AS rawtext FROM customer")
def excluded_pages(spark, sf):
    pages = t(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("title"), (F.col("c_custkey") % 2).cast("int").alias("ns"), F.col("c_mktsegment").alias("rawtext"))
    return relational.excluded(pages, pages.where("c_custkey % 3 = 0").select("title")).select("c_custkey", "title", "rawtext")


@query("SELECT user_id AS title, coalesce(max(event_id) FILTER (WHERE value > 20), arg_max(event_id, (value, event_id))) AS revid FROM events WHERE event_type NOT IN ('error') GROUP BY 1")
def trusted_revisions(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("title"), F.col("event_id").alias("revid"), F.when(F.col("event_type") == "error", F.lit("SomeBot")).otherwise(F.lit("Ann")).alias("user"), F.lit("x").alias("comment"), F.col("ts").alias("timestamp"), "value")
    scored = resources.scored_revisions(e.drop("value"), e.select("revid", F.col("value").alias("score")), "2024-06-01 00:00:00")
    return relational.trusted_revision(scored, 20.0, 1e9)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 3")
def last_of_each(spark, sf):
    return resources.last_entries(t(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 3)


@query("SELECT event_type AS part, CAST(sum(event_id) AS BIGINT) AS done, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1")
def progress_of_parts(spark, sf):
    return resources.shared_progress(t(spark, sf, "events").select(F.col("event_type").alias("part"), F.col("event_id").alias("done"), F.col("user_id").alias("total")), "part")


@query("SELECT o_custkey AS doc_id, 't' || o_orderkey AS tag_id, 'u' || n AS url FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 4")
def drawn_images(spark, sf):
    tags = t(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("t"), F.col("o_orderkey")).alias("tag_id"))
    images = tags.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("pos")).withColumn("url", F.concat(F.lit("u"), F.col("pos")))
    return resources.paired_by_place(tags, images).select("doc_id", "tag_id", "url")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'images/safe/' || sha256('Datei:N' || s_suppkey || '.png') || '.png' WHEN 1 THEN 'images/safe/' || sha256('File:N' || s_suppkey || '.svg') || '.png' END AS path,
 CASE s_suppkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'english' END AS described FROM supplier""")
def image_store(spark, sf):
    """Images under their local names, under English ones, under names with a slash, and missing ones."""
    k, n = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    title = F.when(k == 0, F.concat(F.lit("Datei:N"), n, F.lit(".png"))).when(k == 1, F.concat(F.lit("Datei:N"), n, F.lit(".svg"))).when(k == 2, F.concat(F.lit("Datei:a/"), n)).otherwise(F.concat(F.lit("Datei:none"), n))
    asked = t(spark, sf, "supplier").select("s_suppkey", title.alias("title"))
    stored = t(spark, sf, "supplier").where(k < 3).select(F.when(k == 1, F.concat(F.lit("File:N"), n, F.lit(".svg"))).otherwise(title).alias("title"), F.when(k == 0, F.lit("local")).when(k == 1, F.lit("english")).otherwise(F.lit("slash")).alias("rawtext"))
    paths = resources.image_paths(asked, stored, lang="de")
    return paths.join(resources.description_pages(asked, stored, lang="de").select("s_suppkey", F.col("rawtext").alias("described")), "s_suppkey").select("s_suppkey", "path", "described")


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Ann ' || s_suppkey WHEN 1 THEN 'User:Bob' || s_suppkey ELSE 'User:Zed' END AS names, 'Datei:x' || s_suppkey AS title FROM supplier""")
def image_authors(spark, sf):
    k, n = F.col("s_suppkey") % 3, F.col("s_suppkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("{{Information|Author='''Ann''' "), n, F.lit("}} [[User:Zed]]"))).when(k == 1, F.concat(F.lit("{{Other|[[User:bob"), n, F.lit("]]}} [[User:Zed]]"))).otherwise(F.lit("text [[User:Zed]]"))
    pages = t(spark, sf, "supplier").select(F.concat(F.lit("File:x"), n).alias("title"), raw.alias("rawtext"), F.col("s_suppkey").alias("revid"))
    names = resources.description_contributors(pages)
    local = resources.foreign_pages(pages, "de").where(F.col("revid").isNull()).select("title", F.regexp_extract("title", r"x(\d+)$", 1).cast("long").alias("s_suppkey"))
    return names.select(F.regexp_extract("title", r"x(\d+)$", 1).cast("long").alias("s_suppkey"), F.array_join("names", ",").alias("names")).join(local, "s_suppkey").select("s_suppkey", "names", "title")


@query("SELECT s_suppkey, 'http://w' || s_nationkey AS baseurl, CASE WHEN s_suppkey % 2 = 0 THEN 'by id' || s_suppkey ELSE 'by name' END AS html FROM supplier")
def wikis_and_html(spark, sf):
    items = t(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("w"), F.col("s_nationkey")).alias("wikiident"))
    wikis = t(spark, sf, "nation").select(F.concat(F.lit("w"), F.col("n_nationkey")).alias("ident"), F.concat(F.lit("http://w"), F.col("n_nationkey")).alias("baseurl"))
    asked = items.select("s_suppkey", F.lit("P").alias("title"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("revision"))
    stored = items.select(F.lit(None).cast("string").alias("page"), F.col("s_suppkey").alias("oldid"), F.concat(F.lit("by id"), F.col("s_suppkey")).alias("html")).unionByName(spark.createDataFrame([("P", None, "by name")], "page string, oldid long, html string"))
    html = resources.html_of(asked.select("title", "revision").distinct(), stored)
    grouped = resources.grouped_by_wiki(items, wikis).join(resources.wiki_of(wikis, baseurl="http://none").select(F.col("ident").alias("wikiident")), "wikiident", "left_anti")
    return grouped.select("s_suppkey", "baseurl").join(asked, "s_suppkey").join(html.select(F.col("revision").alias("r"), "html"), F.col("revision").eqNullSafe(F.col("r"))).select("s_suppkey", "baseurl", "html")


@query("SELECT prefix FROM (VALUES " + ", ".join(f"('{p}')" for p in [*resources.LACKING, "en"]) + ") v(prefix)")
def interwiki_repair(spark, sf):
    there = spark.createDataFrame([("en", "en", "http://en/$1"), ("koi", "koi", "own")], "prefix string, language string, url string")
    return resources.repaired_interwiki(there).select("prefix")


# -- trees and layout --------------------------------------------------------------------------------------------------------------
def _trees(spark, sf):
    """A section with a list of one to four items, in a div that says how it is aligned, and a table."""
    k, n = (F.col("s_suppkey") % 4 + 1).cast("int"), F.col("s_suppkey").cast("string")
    page = F.concat(F.lit('<div align="right" dir="rtl">'), n, F.lit("</div>\n\n== S ==\n"), F.repeat(F.lit("* item\n"), k), F.lit("{|\n! h || i\n|-\n| colspan=\"2\" | c\n|}\n[[File:a.png]][[File:b.png]][[File:c.png]]"))
    return wikitext.parse_pages(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), page.alias("text")))


_K4 = "(s_suppkey % 4 + 1)"


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST({_K4} AS BIGINT) AS items, CAST(1 AS BIGINT) AS first, CAST(1 AS BIGINT) AS last, CAST({_K4} - 1 AS BIGINT) AS followed FROM supplier")
def sibling_relations(spark, sf):
    s = tree.siblings(_trees(spark, sf)).where(F.col("class") == "Item")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.count_if("is_first").alias("first"), F.count_if("is_last").alias("last"), F.count(F.col("next")).alias("followed"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'Div:right Cell:center Cell:center Cell:none' AS aligned, 'rtl' AS dir FROM supplier")
def alignment_and_direction(spark, sf):
    nodes = _trees(spark, sf)
    a = tree.alignments(nodes).where(F.col("class").isin("Div", "Cell"))
    listed = a.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", F.concat_ws(":", "class", "align").alias("x")))), lambda s: s["x"]), " ").alias("aligned"))
    divs = nodes.where(F.col("class") == "Div").select("doc_id", "node_id")
    return listed.join(tree.directions(nodes).join(divs, ["doc_id", "node_id"]).select("doc_id", "dir"), "doc_id")


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(0 AS BIGINT) AS items, CAST(0 AS BIGINT) AS broken, CAST(2 AS BIGINT) AS lists FROM supplier")
def edited_trees(spark, sf):
    """Trees without their items, and trees whose section gives way to its children, are trees; the latter have the section's list below the root."""
    nodes = _trees(spark, sf)
    less = tree.removed(nodes, F.col("class") == "Item")
    flat = tree.spliced(nodes, F.col("class") == "Section")
    bad = tree.violations(less).unionByName(tree.violations(flat)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("broken"))
    counts = less.groupBy("doc_id").agg(F.count_if(F.col("class") == "Item").alias("items"), F.count_if(F.col("class") == "ItemList").alias("lists"))
    top = flat.where((F.col("class") == "ItemList") & (F.col("parent") == 0)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("up"))
    return counts.join(top, "doc_id").join(bad, "doc_id", "left").select("doc_id", "items", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"), (F.col("lists") + F.col("up")).alias("lists"))


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(CASE WHEN {_K4} > 2 THEN 1 ELSE 0 END AS BIGINT) AS deep FROM supplier")
def structure_rules(spark, sf):
    """Lists of more than two items break a rule on their items' siblings, tables none on their children."""
    nodes = _trees(spark, sf)
    bad = tree.check(nodes, [("Table", "children", "allow", ["Row"]), ("Item", "parent", "equal", ["ItemList"]), ("Cell", "ancestors", "require", ["Table"])])
    large = nodes.where(F.col("class") == "ItemList").join(nodes.where(F.col("class") == "Item").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id").where("n > 2").select("doc_id").distinct()
    every = nodes.select("doc_id").distinct().join(bad.select("doc_id").distinct(), "doc_id", "left_anti")
    return every.join(large.withColumn("deep", F.lit(1)), "doc_id", "left").select("doc_id", F.coalesce("deep", F.lit(0)).cast("long").alias("deep"))


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST({_K4} * 4 AS BIGINT) AS item_text, length(CAST(s_suppkey AS VARCHAR)) + {_K4} * 4 + 1 AS before, TRUE AS starts, CAST(2 AS BIGINT) AS width FROM supplier")
def text_weights(spark, sf):
    nodes = _trees(spark, sf)
    below = tree.descendants(nodes.where(F.col("class") == "Text"), nodes.where(F.col("class") == "ItemList"))
    items = tree.weights(below.select("doc_id", "class", "caption")).select("doc_id", F.col("weight").cast("long").alias("item_text"))
    width = layout.row_widths(layout.cells(nodes), "doc_id").select("doc_id", F.col("width").cast("long").alias("width"))
    return items.join(tree.text_before(nodes), "doc_id").join(width, "doc_id").select("doc_id", "item_text", F.col("before").cast("long").alias("before"), "starts", "width")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, '0,0 0,1 1,0' AS places, CAST(0 AS BIGINT) AS empty, 'S' AS anchors, CAST(3 AS BIGINT) AS kinds FROM supplier")
def figures_and_tables(spark, sf):
    nodes = _trees(spark, sf)
    f = layout.figure_rows(nodes).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col"))), lambda x: F.concat_ws(",", x["row"].cast("string"), x["col"].cast("string"))), " ").alias("places"))
    empty = layout.empty_tables(nodes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("empty"))
    marks = layout.anchors(nodes).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("anchor")), ",").alias("anchors"))
    kinds = layout.content_types(nodes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kinds"))
    return f.join(empty, "doc_id", "left").join(marks, "doc_id").join(kinds, "doc_id").select("doc_id", "places", F.coalesce("empty", F.lit(0)).cast("long").alias("empty"), "anchors", "kinds")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(9 + 2 * (s_suppkey % 4) + (s_suppkey % 4 + 1) AS BIGINT) IS NOT NULL AS outlined, 'Article' AS first FROM supplier")
def tree_outlines(spark, sf):
    lines = tree.dump(_trees(spark, sf))
    return lines.groupBy("doc_id").agg((F.count(F.lit(1)) > 9).alias("outlined"), F.min_by("line", "node_id").alias("first"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS doc_id, count(DISTINCT part) AS parts, count(*) FILTER (WHERE part IS NULL) AS alone FROM (
  SELECT *, CASE WHEN o_orderkey = first OR o_orderkey = second THEN 1 END AS part FROM (SELECT o_custkey, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders)) GROUP BY 1""")
def kept_together(spark, sf):
    """A heading, elements of the page's height behind it: the first of them stays with the heading, all others stand alone."""
    o = t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), "o_orderkey")
    first = o.groupBy("doc_id").agg(F.min("o_orderkey").alias("f"))
    rows = o.join(first, "doc_id").select("doc_id", F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") == F.col("f")).alias("is_heading"), F.lit(500.0).alias("height"), F.lit(False).alias("breaks"))
    return layout.keep_together(rows, 800.0).groupBy("doc_id").agg(F.count_distinct("part").alias("parts"), F.count_if(F.col("part").isNull()).alias("alone"))


@query("""SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'C' || s_suppkey END AS text, CASE WHEN s_suppkey % 3 = 0 THEN '<a href="#' || md5('P') || '">l</a>' ELSE '<a href="http://o">l</a>' END AS markup, 'Source: http://s Contributors: A, B' AS line FROM supplier""")
def link_texts(spark, sf):
    s = t(spark, sf, "supplier")
    cats = layout.category_texts(s.select("s_suppkey", (F.col("s_suppkey") % 2 == 0).alias("colon"), F.lit("").alias("label"), F.concat(F.lit("C"), F.col("s_suppkey"), F.lit("|x")).alias("target"))).select("s_suppkey", "text")
    links = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.lit("P")).otherwise(F.lit("Q")).alias("target"), F.lit("l").alias("label"), F.lit("http://o").alias("url"))
    made = layout.link_markup(links, spark.createDataFrame([("P",)], "title string")).select("s_suppkey", "markup")
    lines = layout.sources_appendix(s.select(F.col("s_suppkey").alias("title"), F.lit("http://s").alias("url"), F.array(F.lit("A"), F.lit("B")).alias("authors"))).select(F.col("title").alias("s_suppkey"), "line")
    return cats.join(made, "s_suppkey").join(lines, "s_suppkey")


@query("SELECT CAST(1 AS INTEGER) AS ord, 'L0' AS title, 'text 0' AS wikitext UNION ALL SELECT 2, 'L1', 'text 1' UNION ALL SELECT 3, 'L2', 'text 2'")
def license_pages(spark, sf):
    rows = t(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("L"), F.col("n_nationkey")).alias("name"), F.when(F.col("n_nationkey") < 20, F.concat(F.lit("text "), F.col("n_nationkey") % 3)).alias("mw_rights_text"), F.lit("").alias("mw_rights_page"), F.lit(None).cast("string").alias("mw_rights_url"))
    return layout.license_appendix(rows)


@query("SELECT kind, count(*) AS n FROM (VALUES ('text', 1), ('preformatted', 1), ('caption', 1), ('heading', 6), ('list', 8)) v(kind, k), LATERAL (SELECT unnest(range(v.k)) AS i) GROUP BY 1")
def paragraph_styles(spark, sf):
    return layout.style_table(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# -- queue ---------------------------------------------------------------------------------------------------------------------------
def _states(spark, sf):
    state = F.element_at(F.array(*[F.lit(s) for s in ("success", "running", "waiting", "error")]), (F.col("event_id") % 4 + 1).cast("int"))
    return t(spark, sf, "events").select(F.concat("event_type", F.lit(":"), F.col("event_id")).alias("jobid"), F.col("event_type").alias("channel"), (F.col("user_id") % 3).cast("int").alias("priority"), state.alias("state"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("info"), F.col("event_id").alias("serial"))


@query("SELECT row_number() OVER (ORDER BY user_id % 3, event_id) AS place, event_id AS serial FROM events WHERE event_id % 4 = 2 AND event_type IN ('click', 'view')")
def next_jobs(spark, sf):
    from pyspark.sql import Window

    rows = jobs.pop_order(_states(spark, sf), ["click", "view"])
    return rows.select(F.row_number().over(Window.orderBy("priority", "serial")).cast("long").alias("place"), "serial")


@query("SELECT event_type AS request, bool_and(event_id % 4 IN (0, 3)) AS finished FROM events GROUP BY 1")
def waiting_requests(spark, sf):
    s = _states(spark, sf)
    return jobs.waited_for(s, s.select(F.col("channel").alias("request"), "jobid"))


@query("SELECT event_type AS channel, count(*) FILTER (WHERE event_id % 4 = 1 AND event_type <> 'click') AS running, count(*) FILTER (WHERE event_id % 4 = 2 OR (event_id % 4 = 1 AND event_type = 'click')) AS waiting FROM events GROUP BY 1")
def requeued_jobs(spark, sf):
    """After a snapshot is loaded nothing runs; after a worker is lost its jobs wait; finished jobs are preened."""
    s = _states(spark, sf)
    lost = jobs.preened(jobs.requeued(s, spark.createDataFrame([("click",)], "channel string")))
    path = shared_folder(spark, "queue")
    jobs.save_states(s.drop("serial"), path)
    assert jobs.load_states(spark, path).where("state = 'running'").isEmpty()
    return lost.groupBy("channel").agg(F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state") == "waiting").alias("waiting"))


@query("SELECT event_type AS channel, count(*) FILTER (WHERE event_id % 4 IN (1, 2)) > 1200 AS overloaded FROM events GROUP BY 1")
def overloaded_channels(spark, sf):
    return jobs.overloaded(jobs.channel_stats(_states(spark, sf).withColumn("error", F.lit(""))), 1200)


@query("SELECT count(*) AS n FROM events WHERE event_type = 'view' AND CAST(event_id AS VARCHAR) LIKE '1%'")
def jobs_by_prefix(spark, sf):
    return jobs.with_prefix(_states(spark, sf), "view:1").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(event_id AS VARCHAR) AS jobid, CASE event_id % 3 WHEN 0 THEN 'killed' WHEN 1 THEN 'waiting' ELSE 'running' END AS state FROM events WHERE event_id % 4 <> 0")
def killed_and_dropped(spark, sf):
    """Jobs that are killed, pushed anew after a kill, popped, or dropped after they have finished."""
    k, d, at = F.col("event_id") % 3, F.col("event_id") % 4 == 0, F.lit
    made = F.array(
        F.struct(at(0.0).alias("event_time"), at("push").alias("op")), F.struct(at(1.0).alias("event_time"), F.when(k == 2, at("pop")).otherwise(at("kill")).alias("op")),
        F.struct(at(2.0).alias("event_time"), F.when(k == 1, at("push")).otherwise(at("tick")).alias("op")), F.struct(at(3.0).alias("event_time"), F.when(d, at("finish")).otherwise(at("tick")).alias("op")),
        F.struct(at(4.0).alias("event_time"), F.when(d, at("drop")).otherwise(at("tick")).alias("op")),
    )
    log = t(spark, sf, "events").select(F.col("event_id").cast("string").alias("jobid"), F.explode(made).alias("e")).select("jobid", "e.event_time", "e.op")
    log = log.withColumns({"channel": F.lit("c"), "priority": F.lit(0), "serial": F.lit(0), "timeout_s": F.lit(120.0), "ttl_s": F.lit(3600.0), "error": F.lit(None).cast("string"), "info": F.lit(None).cast("string")})
    return jobs.replay(log).where(F.col("state") != "gone").select("jobid", "state")


@query("SELECT 'd' || user_id AS dir, CAST(min(event_id) AS DOUBLE) AS oldest FROM events GROUP BY 1 HAVING min(event_id) < 50")
def stale_cache(spark, sf):
    files = t(spark, sf, "events").select(F.concat(F.lit("d"), F.col("user_id")).alias("dir"), F.col("event_id").cast("double").alias("mtime"))
    return jobs.stale_folders(files, 150.0, 100.0).select("dir", "oldest")


@query("SELECT k FROM (SELECT unnest(range(1, 11)) AS k)")
def work_list(spark, sf):
    start = spark.createDataFrame([(1,)], "k long")
    return relational.fixpoint(start, lambda d: d.select((F.col("k") * 2 % 11).alias("k")), "k")
