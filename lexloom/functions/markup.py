"""Flat markup constructs as native columns: line kinds, sections, links, URLs, tags, entities, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

LINE_KINDS = (
    (r"^\s*:*\{\|", "table"), (r"^\s*\|\}", "table_end"), (r"^\s*\|-", "row"), (r"^\s*\|\+", "caption"), (r"^\s*[|!]", "cell"),
    (r"^=+.*=+\s*$", "section"), (r"^----", "rule"), (r"^[:;#*]+", "item"), (r"^ \s*\S", "pre"), (r"^\s*$", "blank"),
)


def line_kind(line) -> Column:
    line, out = col(line), None
    for pattern, kind in LINE_KINDS:
        test = line.rlike(pattern)
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out.otherwise(F.lit("text"))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each line with its number, kind, list prefix and, for sections, level and title."""
    out = docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    kind = line_kind("line")
    left, right = F.length(F.regexp_extract("line", "^(=+)", 1)), F.length(F.regexp_extract("line", r"(=+)\s*$", 1))
    level = F.when(kind == "section", F.least(left, right))
    bare = F.rtrim(F.col("line"))
    title = F.when(kind == "section", F.trim(F.substring(bare, level + 1, F.length(bare) - 2 * level)))
    return out.withColumns({"kind": kind, "prefix": F.when(kind == "item", F.regexp_extract("line", "^([:;#*]+)", 1)), "level": level, "title": title})


def paragraphs(text) -> Column:
    """Parts between blank lines."""
    return F.filter(F.split(col(text), r"\n[ \t]*\n[\n \t]*"), lambda p: F.trim(p) != "")


_LINK = r"\[\[([^\[\]\|\n]+)(?:\|([^\[\]]*))?\]\]"


def links(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each ``[[target|label]]`` that holds no other link."""
    t = F.col(text)
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(_LINK), F.lit(1)).alias("target"), F.regexp_extract_all(t, F.lit(_LINK), F.lit(2)).alias("label"))
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(pairs).alias("link_no", "l")).select("*", F.trim("l.target").alias("target"), F.nullif(F.col("l.label"), F.lit("")).alias("label")).drop("l")


def urls(text) -> Column:
    """Addresses in a text, bracketed or bare."""
    return F.regexp_extract_all(col(text), F.lit(r"((?:https?|ftp|irc|news)://[^\s\[\]<>\"{}|\x00-\x20]+|mailto:[^\s\[\]<>\"]+)"), F.lit(1))


def named_urls(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each ``[url label]`` on one line."""
    pattern = r"(?<!\[)\[((?:https?|ftp|irc|news)://[^\s\]]+|//[^\s\]]+|mailto:[^\s\]]+)[ \t]*([^\]\n]*)\]"
    t = F.col(text)
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("url"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("label"))
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(pairs).alias("url_no", "u")).select("*", "u.url", "u.label").drop("u")


_TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)(/?)>"


def tags(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each tag: number, name in lower case, whether it closes, its attribute text, whether it closes itself."""
    t = F.col(text)
    parts = [F.regexp_extract_all(t, F.lit(_TAG), F.lit(i)).alias(n) for i, n in enumerate(("slash", "name", "attrs", "end"), 1)]
    out = docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.arrays_zip(*parts)).alias("tag_no", "t"))
    attrs = F.trim(F.regexp_replace("t.attrs", "/$", ""))
    closed = (F.col("t.end") == "/") | F.col("t.attrs").endswith("/")
    return out.select("*", F.lower("t.name").alias("name"), (F.col("t.slash") == "/").alias("closes"), attrs.alias("attrs"), closed.alias("self_closed")).drop("t")


def attribute(attrs, name: str) -> Column:
    """One attribute's value out of a tag's attribute text, null if it has none."""
    a = col(attrs)
    pattern = rf"(?i)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))"
    found = F.coalesce(*[F.nullif(F.regexp_extract(a, pattern, i), F.lit("")) for i in (1, 2, 3)])
    return F.when(a.rlike(pattern), F.coalesce(found, F.lit("")))


def image_urls(html, base: str | None = None) -> Column:
    """Sources of ``<img>`` tags."""
    found = F.regexp_extract_all(col(html), F.lit(r"(?i)<img\s[^>]*?src\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return found if base is None else F.transform(found, lambda u: F.when(u.rlike("^[a-z]+:"), u).when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(F.concat(F.lit(base), u)))


def extension_images(html) -> Column:
    """Images that extensions have drawn: not thumbnails, and from their folders."""
    found = F.regexp_extract_all(col(html), F.lit(r"(?i)(<img\s[^>]*>)"), F.lit(1))
    keep = F.filter(found, lambda t: ~t.rlike(r"class\s*=\s*\"[^\"]*thumbimage") & t.rlike(r"src\s*=\s*\"[^\"]*(extensions|math)"))
    return F.array_distinct(F.transform(keep, lambda t: F.regexp_extract(t, r"src\s*=\s*\"([^\"]+)\"", 1)))


def visible_text(html) -> Column:
    """Text of a page: without scripts, styles, comments and tags, spaces folded."""
    bare = F.regexp_replace(col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def cells(row) -> Column:
    """Cells of a row's line: ``||`` or, in a heading row, ``!!`` between them, attributes before a single bar cut off."""
    r = col(row)
    body = F.regexp_replace(r, r"^\s*[|!]", "")
    parts = F.when(r.rlike(r"^\s*!"), F.split(body, r"\|\||!!")).otherwise(F.split(body, r"\|\|"))
    return F.transform(parts, lambda c: F.trim(F.regexp_replace(c, r"^[^|\[\]{}]*\|(?!\|)", "")))


def quote_runs(text) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit("('{2,})"), F.lit(1)), F.length)


def list_depth(prefix) -> Column:
    return F.length(col(prefix))


#: Tags that stay tags; others are text.
ALLOWED = ["abbr", "b", "big", "blockquote", "br", "center", "cite", "code", "dd", "del", "div", "dl", "dt", "em", "endfeed", "font", "gallery", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "imagemap", "index", "inputbox", "ins", "kbd", "li", "math", "ol", "p", "pages", "pre", "ref", "references", "ruby", "s", "small", "source", "span", "startfeed", "strike", "strong", "sub", "sup", "caption", "table", "td", "th", "tr", "tt", "u", "ul", "var"]
EMPTY = ["br", "hr", "img", "meta", "link", "input", "area", "base", "col"]


def is_allowed(name) -> Column:
    return col(name).isin(ALLOWED)


def lower_parameters(text, names: list[str]) -> Column:
    """Writes some parameter names of templates in lower case (``| Name =`` becomes ``| name =``)."""
    out = col(text)
    for n in names:
        out = F.regexp_replace(out, rf"(?im)^(\s*\|\s*){n}(\s*=)", f"$1{n.lower()}$2")
    return out


def drop_parameters(text, names: list[str]) -> Column:
    """Takes whole lines of some template parameters out."""
    out = col(text)
    for n in names:
        out = F.regexp_replace(out, rf"(?im)^\s*\|\s*{n}\s*=[^\n]*\n?", "")
    return out


def listing(attributes, order: list[str]) -> Column:
    """A travel listing as text: the attributes that are there, in order."""
    return F.concat_ws(", ", *[F.nullif(F.try_element_at(attributes, F.lit(k)), F.lit("")) for k in order])
