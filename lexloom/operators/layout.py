"""Tables, widths, inline markup, contents and appendices as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamped


def cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, table_id, row_no, ord, colspan, rowspan, is_header, node_id) of a node table's cells."""
    tables = nodes.where(F.col("class") == "Table").select("doc_id", F.col("node_id").alias("table_id"))
    rows = nodes.where(F.col("class") == "Row").join(tables.withColumnRenamed("table_id", "parent"), ["doc_id", "parent"]).withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("node_id")) - 1)
    rows = rows.select("doc_id", F.col("parent").alias("table_id"), F.col("node_id").alias("parent"), "row_no")
    a = lambda k: F.try_element_at("attrs", F.lit(k))
    return nodes.where(F.col("class") == "Cell").join(rows, ["doc_id", "parent"]).select("doc_id", "table_id", "row_no", "ord", clamped(a("colspan")).alias("colspan"), clamped(a("rowspan")).alias("rowspan"), (F.col("tag") == "th").alias("is_header"), "node_id")


def column_counts(cells_: DataFrame, table: str = "table_id", row: str = "row_no", span: str = "colspan") -> DataFrame:
    """(table, columns): the widest row."""
    return cells_.groupBy(table, row).agg(F.sum(span).alias("w")).groupBy(table).agg(F.max("w").alias("columns"))


def row_widths(cells_: DataFrame, table: str = "table_id", row: str = "row_no", span: str = "colspan") -> DataFrame:
    """(table, width): as above, but a row of one cell counts one."""
    return cells_.groupBy(table, row).agg(F.when(F.count(F.lit(1)) > 1, F.sum(span)).otherwise(1).alias("w")).groupBy(table).agg(F.max("w").alias("width"))


def span_grid(cells_: DataFrame) -> DataFrame:
    """(table_id, row, col, owner_row, owner_ord, placeholder): every place that a cell covers; row spans end with the table.

    A cell starts behind the spans of the cells left of it in its row; places that row spans from above take are told by the overlap flag."""
    w = Window.partitionBy("table_id", "row_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("table_id")
    placed = cells_.withColumn("col_no", F.coalesce(F.sum("colspan").over(w), F.lit(0))).withColumn("rows_", F.max("row_no").over(last))
    span = F.least(F.col("rowspan"), F.col("rows_") - F.col("row_no") + 1)
    spread = placed.withColumn("row", F.explode(F.sequence(F.col("row_no"), F.col("row_no") + span - 1))).withColumn("col", F.explode(F.sequence(F.col("col_no"), F.col("col_no") + F.col("colspan") - 1)))
    return spread.select("table_id", "row", "col", F.col("row_no").alias("owner_row"), F.col("ord").alias("owner_ord"), ((F.col("row") != F.col("row_no")) | (F.col("col") != F.col("col_no"))).alias("placeholder"))


def column_widths(cells_: DataFrame, available: float) -> DataFrame:
    """(table_id, col, width) of (table_id, col, colspan, min_width, max_width): each column gets its widest minimum, spans share theirs evenly, and what is left of the page is
    dealt in proportion to the room up to the maxima."""
    spread = cells_.withColumn("at", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1))).select("table_id", F.col("at").alias("col"), (F.col("min_width") / F.col("colspan")).alias("lo"), (F.col("max_width") / F.col("colspan")).alias("hi"))
    columns = spread.groupBy("table_id", "col").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    t = Window.partitionBy("table_id")
    room = F.greatest(F.lit(0.0), F.lit(float(available)) - F.sum("lo").over(t))
    slack = F.sum(F.col("hi") - F.col("lo")).over(t)
    return columns.select("table_id", "col", (F.col("lo") + F.least(F.col("hi") - F.col("lo"), F.coalesce(F.try_divide(room * (F.col("hi") - F.col("lo")), slack), F.lit(0.0)))).alias("width"))


def content_types(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent, kinds, characters): what the children of cells are, inline ones as Text, and how much text they hold."""
    block = ["Table", "ItemList", "Paragraph", "Div", "Gallery", "ImageLink", "PreFormatted", "DefinitionList", "Section"]
    kind = F.when(F.col("class").isin(block), F.col("class")).otherwise(F.lit("Text"))
    own = nodes.where(F.col("class") == "Cell").select("doc_id", F.col("node_id").alias("parent"))
    return nodes.join(own, ["doc_id", "parent"]).groupBy("doc_id", "parent").agg(F.array_sort(F.collect_set(kind)).alias("kinds"), F.sum(F.length("caption")).alias("characters"))


#: Markup of classes when a document is written inline (start, end).
MARKUP = {"Strong": ("<b>", "</b>"), "Emphasized": ("<i>", "</i>"), "Underline": ("<u>", "</u>"), "Sub": ("<sub>", "</sub>"), "Sup": ("<super>", "</super>"), "Strike": ("<strike>", "</strike>"), "Teletyped": ("<font face=\"mono\">", "</font>"), "Code": ("<font face=\"mono\">", "</font>"), "Paragraph": ("<p>", "</p>"), "Item": ("<li>", "</li>"), "Cell": ("<td>", "</td>"), "Row": ("<tr>", "</tr>"), "Table": ("<table>", "</table>"), "Section": ("<section>", "</section>"), "ItemList": ("<ul>", "</ul>")}


def escaped(s):
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def inline_markup(nodes: DataFrame) -> DataFrame:
    """(doc_id, markup): start and end marks of all nodes and escaped texts, put in order by their places."""
    start = F.create_map(*[F.lit(x) for k, v in MARKUP.items() for x in (k, v[0])])
    end = F.create_map(*[F.lit(x) for k, v in MARKUP.items() for x in (k, v[1])])
    text = F.when(F.col("class") == "Text", escaped(F.col("caption"))).when(F.col("class") == "BreakingReturn", F.lit("<br/>")).otherwise(F.coalesce(F.try_element_at(start, F.col("class")), F.lit("")))
    opens = nodes.select("doc_id", F.struct(F.col("node_id").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("at"), text.alias("t"))
    closes = nodes.select("doc_id", F.struct(F.col("post").alias("a"), F.lit(1).alias("b"), (-F.col("node_id")).alias("c")).alias("at"), F.coalesce(F.try_element_at(end, F.col("class")), F.lit("")).alias("t"))
    return opens.unionByName(closes).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "").alias("markup"))


def contents(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, level, text): the table of contents."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    return nodes.where(F.col("class") == "Section").select("doc_id", F.row_number().over(w).alias("ord"), "level", F.col("caption").alias("text"))


def url_footnotes(urls: DataFrame) -> DataFrame:
    """(doc_id, pos, url, number): addresses are numbered by their first use; // gains http:."""
    full = urls.withColumn("url", F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url")))
    first = full.withColumn("_f", F.min("pos").over(Window.partitionBy("doc_id", "url")))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_f"))).drop("_f")


def link_markup(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Links as text: to an anchor if the target is in the book, to nothing if it starts with #, else to the address up to a quotation mark."""
    inside = articles.select(F.col("title").alias("target"), F.lit(True).alias("_in")).distinct()
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.try_url_decode(F.replace("target", F.lit("_"), F.lit(" "))))
    href = F.substring_index(F.coalesce("url", "target"), '"', 1)
    made = F.when(F.col("target").startswith("#"), label).when(F.col("_in"), F.concat(F.lit('<a href="#'), F.md5(F.col("target").cast("binary")), F.lit('">'), label, F.lit("</a>"))).otherwise(F.concat(F.lit('<a href="'), href, F.lit('">'), label, F.lit("</a>")))
    return links.join(inside, "target", "left").withColumn("markup", made).drop("_in")


def sources_appendix(articles: DataFrame) -> DataFrame:
    """One line an article: title, source, contributors."""
    return articles.select("title", F.concat_ws(" ", F.concat(F.lit("Source: "), "url"), F.concat(F.lit("Contributors: "), F.array_join("authors", ", "))).alias("line")).orderBy("title")


def css(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``style``: entries of all classes of a node, later classes over earlier ones, under its own. rules: (css_class, style map)."""
    own = nodes.select("doc_id", "node_id", F.posexplode(F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"\s+")).alias("k", "css_class")).join(rules, "css_class")
    rows = own.select("doc_id", "node_id", "k", F.explode("style").alias("name", "value")).groupBy("doc_id", "node_id", "name").agg(F.max_by("value", "k").alias("value"))
    styles = rows.groupBy("doc_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("style"))
    return nodes.join(styles, ["doc_id", "node_id"], "left")


def figure_rows(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent, node_id, row, col): runs of neighbouring images in rows of two."""
    w = Window.partitionBy("doc_id", "parent").orderBy("ord")
    image = F.col("class") == "ImageLink"
    marked = nodes.withColumn("_g", F.sum(F.when(image, 0).otherwise(1)).over(w)).where(image)
    n = F.row_number().over(Window.partitionBy("doc_id", "parent", "_g").orderBy("ord")) - 1
    return marked.select("doc_id", "parent", "node_id", F.floor(n / 2).alias("row"), (n % 2).alias("col"))


def gallery_rows(images: DataFrame, per_row: int = 4) -> DataFrame:
    return images.withColumn("row", F.floor(F.col("ord") / per_row)).withColumn("col", F.col("ord") % per_row)


def license_appendix(licenses: DataFrame) -> DataFrame:
    """(ord, title, wikitext): the collection's licences in order, each text once, those without any left out."""
    from .resources import license_text

    rows = licenses.withColumn("wikitext", license_text()).where(F.col("wikitext") != "")
    once = rows.groupBy("wikitext").agg(F.min(F.struct("ord", "name")).alias("first"))
    return once.select(F.row_number().over(Window.orderBy("first.ord")).alias("ord"), F.col("first.name").alias("title"), "wikitext")


def category_texts(links: DataFrame) -> DataFrame:
    """Category links with the text that is shown: none without a colon in front, else the label or target up to a bar."""
    shown = F.substring_index(F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("target")), "|", 1)
    return links.withColumn("text", F.when(F.col("colon"), shown))


def empty_tables(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id) of tables whose rows hold nothing."""
    rows = nodes.where(F.col("class") == "Row").select("doc_id", F.col("node_id").alias("row"), F.col("parent").alias("node_id"))
    full = nodes.select("doc_id", F.col("parent").alias("row")).join(rows, ["doc_id", "row"]).select("doc_id", "node_id").distinct()
    return nodes.where(F.col("class") == "Table").select("doc_id", "node_id").join(full, ["doc_id", "node_id"], "left_anti")


def anchors(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, anchor): sections and nodes with an id, by names that are safe in an address."""
    name = F.coalesce(F.try_element_at("attrs", F.lit("id")), F.when(F.col("class") == "Section", F.col("caption")))
    return nodes.where(name.isNotNull()).select("doc_id", "node_id", F.replace(F.trim(name), F.lit(" "), F.lit("_")).alias("anchor"))


def keep_together(elements: DataFrame, page_height: float) -> DataFrame:
    """(doc_id, ord, part) of (doc_id, ord, is_heading, height, breaks): a heading opens a part, which goes on up to the first element that isn't a
    heading and, as long as its height stays within a tenth of the page, further; an element outside any part has none."""
    state = "named_struct('open', false, 'heading', false, 'height', 0d, 'part', 0, 'out', cast(array() as array<struct<ord:int,part:int>>))"
    row = "named_struct('ord', e.ord, 'part', {})"
    step = f"""if(not s.open,
      if(e.is_heading, named_struct('open', true, 'heading', true, 'height', 0d, 'part', s.part + 1, 'out', concat(s.out, array({row.format('s.part + 1')}))),
        named_struct('open', false, 'heading', false, 'height', 0d, 'part', s.part, 'out', concat(s.out, array({row.format('cast(null as int)')})))),
      if(s.heading or (s.height <= {page_height / 10} and not e.breaks),
        named_struct('open', true, 'heading', e.is_heading, 'height', if(e.is_heading, s.height, s.height + e.height), 'part', s.part, 'out', concat(s.out, array({row.format('s.part')}))),
        if(e.is_heading, named_struct('open', true, 'heading', true, 'height', 0d, 'part', s.part + 1, 'out', concat(s.out, array({row.format('s.part + 1')}))),
          named_struct('open', false, 'heading', false, 'height', 0d, 'part', s.part, 'out', concat(s.out, array({row.format('cast(null as int)')}))))))"""
    listed = elements.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), "is_heading", F.col("height").cast("double").alias("height"), "breaks"))).alias("all"))
    return listed.select("doc_id", F.explode(F.expr(f"aggregate(all, {state}, (s, e) -> {step}).out")).alias("r")).select("doc_id", "r.ord", "r.part")


#: Paragraph styles: a row for each kind of text and depth (points).
def style_table(spark, base: float = 10.0) -> DataFrame:
    """(kind, level, size, leading, indent) of paragraphs, headings, lists and preformatted text."""
    rows = [("text", 0, base, base * 1.5, 0.0), ("preformatted", 0, base * 0.8, base, 0.0), ("caption", 0, base * 0.8, base, 0.0)]
    rows += [("heading", k, base * max(1.0, 2.0 - 0.25 * (k - 1)), base * max(1.5, 3.0 - 0.25 * (k - 1)), 0.0) for k in range(1, 7)]
    rows += [("list", k, base, base * 1.5, 1.5 * base * k) for k in range(1, 9)]
    return spark.createDataFrame([(a, b, float(c), float(d), float(e)) for a, b, c, d, e in rows], "kind string, level int, size double, leading double, indent double")


def repeated(links: DataFrame) -> DataFrame:
    """(..., repeats) of links that occur more than once among equal columns."""
    return links.groupBy(*links.columns).agg(F.count(F.lit(1)).alias("repeats")).where(F.col("repeats") > 1)
