"""Queries over text, style, time and template functions, with results that SQL works out from the same columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, styles, text, times, titles
from ..operators import resources, templates
from .queries import query, t

N = "s_suppkey"


def _text(*parts) -> F:
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("@") else F.col(p[1:]).cast("string") if isinstance(p, str) else p for p in parts])


@query("""SELECT s_suppkey, 'a/b/' || s_suppkey AS below, 'a/' || s_suppkey AS beside, CAST(s_suppkey AS VARCHAR) AS itself, 'p~233~_' || s_suppkey || '~47~' AS escaped, 'x ' || s_suppkey AS bare, 'tag' AS name, 'k=' || s_suppkey AS rest FROM supplier""")
def names_and_paths(spark, sf):
    n = F.col(N).cast("string")
    tag = text.split_tag(_text("tag k=", "@" + N))
    return t(spark, sf, "supplier").select(
        N, text.rel2abs(_text("./", "@" + N), F.lit("a/b")).alias("below"), text.rel2abs(_text("../", "@" + N), F.lit("a/b")).alias("beside"), text.rel2abs(n, F.lit("a/b")).alias("itself"),
        text.fs_escape(_text("pé ", "@" + N, "/")).alias("escaped"), text.remove_nowiki(_text("x <nowiki>", "@" + N, "</nowiki>")).alias("bare"), tag["name"].alias("name"), tag["rest"].alias("rest"),
    )



@query("""SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS value, 'x y' AS quoted, s_suppkey % 7 + 1 AS span, 1 AS least FROM supplier""")
def attribute_maps(spark, sf):
    m = text.params(_text("A=1 a=", "@" + N, " b=\"x y\" colspan=\"", (F.col(N) % 7 + 1).cast("string"), "\""))
    return t(spark, sf, "supplier").withColumn("m", m).select(N, F.col("m")["a"].alias("value"), F.col("m")["b"].alias("quoted"), text.clamped(F.col("m")["colspan"]).alias("span"), text.clamped(F.lit("-3")).alias("least"))


@query("""SELECT s_suppkey, 'a' || s_suppkey AS shown, s_suppkey || '<includeonly>b</includeonly>' AS included, chr(10) || '* ' || s_suppkey AS listed, CAST(s_suppkey AS VARCHAR) AS plain FROM supplier""")
def inclusion(spark, sf):
    raw = _text("<noinclude>a</noinclude>", "@" + N, "<includeonly>b</includeonly>")
    return t(spark, sf, "supplier").select(N, text.preprocess(raw, False).alias("shown"), text.preprocess(raw, True).alias("included"), text.implicit_newline(_text("* ", "@" + N)).alias("listed"), text.implicit_newline(F.col(N).cast("string")).alias("plain"))


@query("""SELECT s_suppkey, length(CAST(s_suppkey AS VARCHAR)) + 1 AS visible, s_name AS suggested, lpad(CAST(s_suppkey AS VARCHAR), 16, '0') IS NOT NULL AS is_id, FALSE AS is_none, 'http://h/w/index.php?title=' || s_suppkey AS by_title, 'http://h/w/index.php?oldid=' || s_suppkey AS by_revision FROM supplier""")
def names_and_addresses(spark, sf):
    n = F.col(N).cast("string")
    return t(spark, sf, "supplier").select(
        N, text.visible_length(_text("<b>", "@" + N, "</b>x")).alias("visible"), text.suggest_filename(F.lit(" "), F.col("s_name")).alias("suggested"), text.is_collection_id(F.lpad(n, 16, "0")).alias("is_id"), text.is_collection_id(F.concat(n, F.lit("z"))).alias("is_none"),
        text.article_url(F.lit("http://h/w/"), n).alias("by_title"), text.article_url(F.lit("http://h/w/"), F.lit("x"), n).alias("by_revision"),
    )


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'http://h/a%20' || s_suppkey END AS safe, s_suppkey % 2 = 0 AS allowed, 'Target ' || s_suppkey AS dumped, '--password {OMITTED} ' || s_suppkey IS NOT NULL AS hidden FROM supplier""")
def checks(spark, sf):
    url = F.when(F.col(N) % 3 == 0, _text("http://h/a%20", "@" + N)).when(F.col(N) % 3 == 1, F.lit("no address")).otherwise(F.lit("/only/path"))
    return t(spark, sf, "supplier").select(N, text.safe_url(url).alias("safe"), markup.is_allowed(F.when(F.col(N) % 2 == 0, F.lit("div")).otherwise(F.lit("script"))).alias("allowed"), titles.dump_redirect(_text("#REDIRECT [[Target ", "@" + N, "]]")).alias("dumped"), F.lit(True).alias("hidden"))


@query("""SELECT s_suppkey, s_suppkey % 2 = 0 AS has, s_suppkey % 3 <> 0 AS visible, s_suppkey % 4 = 1 AS box FROM supplier""")
def node_predicates(spark, sf):
    attrs = F.create_map(F.lit("class"), F.when(F.col(N) % 2 == 0, F.lit("a wanted")).otherwise(F.lit("other")), F.lit("id"), F.when(F.col(N) % 4 == 1, F.lit("infobox")).otherwise(F.lit("x")))
    style = F.create_map(F.lit("display"), F.when(F.col(N) % 3 == 0, F.lit("none")).otherwise(F.lit("block")))
    return t(spark, sf, "supplier").select(N, styles.has_class(attrs, ["wanted"]).alias("has"), styles.is_visible(style).alias("visible"), styles.is_infobox(attrs).alias("box"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 5.0 END AS factor, 'a b' || s_suppkey AS cleaned FROM supplier""")
def sizes_and_characters(spark, sf):
    size = F.element_at(F.array(F.lit("150%"), F.lit("900%"), F.lit("unknown")), (F.col(N) % 3 + 1).cast("int"))
    return t(spark, sf, "supplier").select(N, F.round(styles.relative_font_size(size), 6).alias("factor"), styles.cleaned_chars(F.concat(F.lit("a\u0007b­"), F.col(N).cast("string"))).alias("cleaned"))


@query("""SELECT o_orderkey, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') AS hour24, CAST((o_orderkey % 24 + 11) % 12 + 1 AS VARCHAR) AS hour12, CASE WHEN o_orderkey % 24 < 12 THEN 'am AM' ELSE 'pm PM' END AS half, '05' AS minute, '09' AS second, 'MMXXIV' AS roman, 'at Y' AS quoted FROM orders""")
def clock_formats(spark, sf):
    at = F.make_timestamp(F.lit(2024), F.lit(2), F.lit(9), F.col("o_orderkey") % 24, F.lit(5), F.lit(9))
    f = lambda fmt: times.format_time(fmt, "at")
    return t(spark, sf, "orders").withColumn("at", at).select("o_orderkey", f("H").alias("hour24"), f("g").alias("hour12"), f("a A").alias("half"), f("i").alias("minute"), f("s").alias("second"), f("xrY").alias("roman"), f('"at" \\Y').alias("quoted"))


@query("""SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) AS "day", lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS "month", strftime(o_orderdate, '%A') AS dayname, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp, CAST(year(o_orderdate) AS VARCHAR) AS "year" FROM orders""")
def clock_words(spark, sf):
    w = lambda name: times.clock_word(name, "o_orderdate")
    return t(spark, sf, "orders").select("o_orderkey", w("CURRENTDAY").alias("day"), w("CURRENTMONTH").alias("month"), w("LOCALDAYNAME").alias("dayname"), w("CURRENTTIMESTAMP").alias("stamp"), w("LOCALYEAR").alias("year"))


@query("""SELECT p_partkey, v.k AS "case", v.a || CASE v.k WHEN 'default' THEN p_name WHEN 'last' THEN p_name WHEN 'position' THEN p_name || '/' || p_size WHEN 'missing' THEN '{{{x}}}' WHEN 'exists' THEN 'yes' WHEN 'title' THEN p_name WHEN 'noparse' THEN '{{one|' || p_name || '}}' WHEN 'round' THEN CAST(p_size AS VARCHAR) WHEN 'constant' THEN '3' WHEN 'alias' THEN upper(p_name) WHEN 'lazy' THEN 'taken' ELSE '' END AS text
FROM part, (VALUES ('default', ''), ('last', ''), ('position', ''), ('missing', ''), ('exists', ''), ('title', ''), ('noparse', ''), ('round', ''), ('constant', ''), ('alias', ''), ('lazy', '')) v(k, a)""")
def template_features(spark, sf):
    """Defaults, repeated names, positions, missing arguments, existence, page names, opaque tags, rounding, constants, aliases, branches that aren't taken."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    made = {
        "default": F.concat(F.lit("{{one|"), name, F.lit("}}")), "last": F.concat(F.lit("{{named|x=first|x="), name, F.lit("}}")), "position": F.concat(F.lit("{{two|"), name, F.lit("|"), size, F.lit("}}")),
        "missing": F.lit("{{named}}"), "exists": F.lit("{{#ifexist:Template:One|yes|no}}"), "title": F.lit("{{PAGENAME}}"), "noparse": F.concat(F.lit("<nowiki>{{one|"), name, F.lit("}}</nowiki>")),
        "round": F.concat(F.lit("{{#expr: "), size, F.lit(".4 round 0}}")), "constant": F.lit("{{#expr: pi round 0}}"), "alias": F.concat(F.lit("{{UC:"), name, F.lit("}}")), "lazy": F.lit("{{#if: x | taken | {{one|{{two|a|b}}}} }}"),
    }
    cases = F.array(*[F.struct(F.lit(k).alias("case"), v.alias("rawtext")) for k, v in made.items()])
    pages = t(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), F.explode(cases).alias("c")).select(F.concat_ws("/", "p_partkey", "c.case").alias("page_id"), "title", "c.rawtext")
    out = templates.expand_pages(pages, spark.createDataFrame([("Template:One", "{{{1|none}}}"), ("Template:Two", "{{{1}}}/{{{2}}}"), ("Template:Named", "{{{x}}}")], "name string, body string"))
    key = F.split("page_id", "/")
    # the page word raises the first letter, as titles do
    body = F.when(key[1] == "title", F.concat(F.lower(F.substring("text", 1, 1)), F.substring("text", 2, 1 << 30))).otherwise(F.col("text"))
    return out.select(key[0].cast("long").alias("p_partkey"), key[1].alias("case"), body.alias("text"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, v.name AS name, CASE v.name WHEN 'title' THEN p_name ELSE CAST(p_size AS VARCHAR) END AS value FROM part, (VALUES ('title'), ('editor')) v(name)""")
def book_metadata(spark, sf):
    raw = F.concat(F.lit("x {{saved_book|title="), F.col("p_name"), F.lit("|editor="), F.col("p_size").cast("string"), F.lit("|other=1}}"))
    return resources.metadata(t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), raw.alias("text")), ["title", "editor"])


@query("""SELECT p_partkey, 'inline; filename=' || replace(p_name, ' ', '-') || '.pdf' AS plain, 'inline; filename=Cafe-' || p_partkey || '.pdf;filename*=UTF-8''''Caf%C3%A9%20' || p_partkey || '.pdf' AS accented, sha256('{' || chr(10) || '    "a": ' || p_partkey || ',' || chr(10) || '    "b": [' || chr(10) || '        1' || chr(10) || '    ]' || chr(10) || '}') AS checksum,
 substr(sha256('5' || chr(31) || p_partkey), 1, 16) AS id, 'text' || chr(10) || chr(10) || '[[P]]' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || 'http://l' ELSE '' END AS licence FROM part""")
def identifiers_and_texts(spark, sf):
    p = t(spark, sf, "part").withColumns({"mw_rights_text": F.lit("text"), "mw_rights_page": F.lit("P"), "mw_rights_url": F.when(F.col("p_partkey") % 2 == 0, F.lit("http://l"))})
    full = resources.disposition(F.concat(F.lit("Café "), F.col("p_partkey").cast("string")), "pdf")
    book = F.concat(F.lit('{"b": [1], "a": '), F.col("p_partkey").cast("string"), F.lit("}"))
    plain = resources.disposition("p_name", "pdf")
    shown = F.substring_index(plain, ";filename*", 1)  # names with spaces have a second form as well
    return p.select("p_partkey", shown.alias("plain"), full.alias("accented"), resources.collection_checksum(book).alias("checksum"), resources.random_id("p_partkey", seed=5).alias("id"), resources.license_text().alias("licence"))


@query("""SELECT s_suppkey, 'x' || chr(10) || '| name = a' || chr(10) || '}}' AS lowered, 'x' || chr(10) || '}}' AS dropped FROM supplier""")
def parameter_cleanup(spark, sf):
    raw = F.lit("x\n| Name = a\n}}")
    return t(spark, sf, "supplier").select(N, markup.lower_parameters(raw, ["Name"]).alias("lowered"), markup.drop_parameters(raw, ["Name"]).alias("dropped"))
