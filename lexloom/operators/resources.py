"""Images, sources and settings of a page store: paths, description pages, contributors, foreign pages, options, identifiers."""

from __future__ import annotations

import configparser
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as strings
from ..functions import titles
from . import templates, wikitext

FILE = 6
#: Image types that are shown as png.
SHOWN_AS_PNG = (".gif", ".svg", ".tif", ".tiff")
#: Wikis whose interwiki prefixes some site descriptions lack.
LACKING = "pnb ckb mwl mhr ace krc pcd frr koi gag bjn pfl mrj rue kbd ltg xmf".split()


# -- images ------------------------------------------------------------------------------------------------------------
def image_names(title, lang: str = "en"):
    """struct(local, english): the full names under which an image may be stored; null outside the file namespace and for names with a slash."""
    name = titles.split_name(F.try_url_decode(F.replace(F.col(title) if isinstance(title, str) else title, F.lit("+"), F.lit("%2B"))), lang, FILE)
    # bound once by the lambda, as the name is read several times
    made = lambda n: F.when((n["ns"] == FILE) & ~F.contains(n["full"], F.lit("/")), F.struct(n["full"].alias("local"), F.concat(F.lit("File:"), n["partial"]).alias("english")))
    return F.transform(F.array(name), made)[0]


def _either(requests: DataFrame, stored: DataFrame, title: str, lang: str) -> DataFrame:
    """Rows of (title, ...) stored under a requested image's local name, else under its English one."""
    asked = requests.withColumn("_names", image_names(title, lang))
    one = stored.select(F.col("title").alias("_local"), F.struct("*").alias("_one"))
    two = stored.select(F.col("title").alias("_english"), F.struct("*").alias("_two"))
    joined = asked.join(one, asked["_names.local"] == F.col("_local"), "left").join(two, asked["_names.english"] == F.col("_english"), "left")
    return joined.withColumn("_found", F.coalesce("_one", "_two")).drop("_names", "_local", "_english", "_one", "_two")


def image_paths(requests: DataFrame, stored: DataFrame, title: str = "title", lang: str = "en") -> DataFrame:
    """Adds path (null if there is no such image): a hash of the stored name with its type, types that browsers show badly as png. stored: (title)."""
    found = _either(requests, stored.select("title").distinct(), title, lang)
    suffix = F.lower(F.replace(F.regexp_extract(F.col("_found.title"), r"(\.[^.]*)$", 1), F.lit(" "), F.lit("")))
    kept = F.replace(F.regexp_extract(F.col("_found.title"), r"(\.[^.]*)$", 1), F.lit(" "), F.lit(""))
    path = F.concat(F.lit("images/safe/"), F.sha2(F.col("_found.title"), 256), F.when(suffix.isin(*SHOWN_AS_PNG), F.lit(".png")).otherwise(kept))
    return found.withColumn("path", path).drop("_found")


def description_pages(requests: DataFrame, pages: DataFrame, title: str = "title", lang: str = "en") -> DataFrame:
    """Adds page and rawtext of an image's description, under the local name or else the English one. pages: (title, rawtext)."""
    found = _either(requests, pages.select("title", "rawtext"), title, lang)
    return found.withColumns({"page": F.col("_found.title"), "rawtext": F.col("_found.rawtext")}).drop("_found")


def foreign_pages(pages: DataFrame, lang: str = "en") -> DataFrame:
    """Description pages of a shared repository under local names; their revision numbers, which could be a local page's, go."""
    local = titles.NAMESPACES.get(lang, titles.NAMESPACES["en"])[FILE]
    partial = F.regexp_replace("title", "^[^:]*:", "")
    return pages.withColumn("title", F.concat(F.lit(local + ":"), partial)).withColumn("revid", F.lit(None).cast("long"))


def paired_by_place(tags: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """The n-th tag of a document with its n-th drawn image, as far as there are both. tags: (key, pos, tag_id), images: (key, pos, url)."""
    w = Window.partitionBy(key).orderBy("pos")
    one, two = tags.withColumn("_n", F.row_number().over(w)).drop("pos"), images.withColumn("_n", F.row_number().over(w)).drop("pos")
    return one.join(two, [key, "_n"]).drop("_n")


def _users(text: str, lang: str) -> list[str]:
    return sorted({n.target for n in wikitext.parsed(text, lang).walk() if n.cls == "NamespaceLink" and n.ns == 2 and n.target})


def contributors_of(text: str, lang: str = "en") -> list[str]:
    """Who made an image, by its description: the author that the template Information names, as text; else user links in its arguments; else those of the other
    templates; else those of the page."""
    names = templates.static_names(text)
    for name in ["Information", *(n for n in names if n.strip().lower() != "information")]:
        args = templates.call_arguments(text, name)
        if not args:
            continue
        author = args.get("Author", "").strip()
        shown = "".join(n.caption if n.cls == "Text" else "" if n.children else (n.target or "") if n.cls.endswith("Link") else "" for n in wikitext.parsed(author, lang).walk()).strip() if author else ""
        found = [shown] if shown else _users("\n".join(args.values()), lang)
        if found:
            return found
    return _users(text, lang)


def description_contributors(pages: DataFrame, lang: str = "en") -> DataFrame:
    """(title, names) of (title, rawtext)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([contributors_of(t or "", lang) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["title", "names"])

    return pages.select("title", "rawtext").mapInArrow(run, "title string, names array<string>")


# -- sites and wikis -----------------------------------------------------------------------------------------------------
def repaired_interwiki(prefixes: DataFrame) -> DataFrame:
    """(prefix, language, url) with the prefixes that some site descriptions lack; those that are there stay as they are."""
    spark = prefixes.sparkSession
    more = spark.createDataFrame([(p, p, f"http://{p}.wikipedia.org/wiki/$1") for p in LACKING], "prefix string, language string, url string")
    return prefixes.select("prefix", "language", "url").unionByName(more.join(prefixes.select("prefix").distinct(), "prefix", "left_anti"))


def source_record(siteinfo: DataFrame) -> DataFrame:
    """(name, url, language) of site descriptions (sitename, base, lang)."""
    return siteinfo.select(F.concat_ws(" ", F.col("sitename"), F.concat(F.lit("("), "lang", F.lit(")"))).alias("name"), F.col("base").alias("url"), F.col("lang").alias("language"))


def wiki_of(wikis: DataFrame, ident: str | None = None, baseurl: str | None = None) -> DataFrame:
    """The wikis with an identifier or with an address; one of the two has to be given."""
    if (ident is None) == (baseurl is None):
        raise ValueError("either an identifier or an address")
    return wikis.where(F.col("ident") == ident) if ident is not None else wikis.where(F.col("baseurl") == baseurl)


def grouped_by_wiki(items: DataFrame, wikis: DataFrame) -> DataFrame:
    """Items (wikiident, ...) with their wiki's address; an item whose wiki isn't known is an error."""
    joined = items.join(wikis.select(F.col("ident").alias("wikiident"), "baseurl"), "wikiident", "left")
    return joined.withColumn("baseurl", F.when(F.col("baseurl").isNotNull(), F.col("baseurl")).otherwise(F.raise_error(F.concat(F.lit("no such wiki: "), F.coalesce("wikiident", F.lit("null")))).cast("string")))


def html_of(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests (title, revision) with stored pages (page, oldid, html): by revision where one is named, else by title."""
    by_id = stored.where(F.col("oldid").isNotNull()).select(F.col("oldid").alias("revision"), F.col("html").alias("_id"))
    by_name = stored.where(F.col("oldid").isNull()).select(F.col("page").alias("title"), F.col("html").alias("_name"))
    joined = requests.join(by_id, "revision", "left").join(by_name, "title", "left")
    return joined.select("title", "revision", F.when(F.col("revision").isNotNull(), F.col("_id")).otherwise(F.col("_name")).alias("html"))


# -- shares and scores ---------------------------------------------------------------------------------------------------
def shared_progress(parts: DataFrame, by: str) -> DataFrame:
    """(by, done, total) over all parts."""
    return parts.groupBy(by).agg(F.sum("done").alias("done"), F.sum("total").alias("total"))


def last_entries(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def scored_revisions(revisions: DataFrame, scores: DataFrame, now) -> DataFrame:
    """Revisions (title, revid, user, comment, timestamp) with age_days and score; bots' and reverting ones have no score and go."""
    bot = F.contains(F.lower("user"), F.lit("bot")) | F.contains(F.lower(F.coalesce("comment", F.lit(""))), F.lit("revert"))
    aged = revisions.where(~F.coalesce(bot, F.lit(False))).withColumn("age_days", (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("timestamp")) / 86400.0)
    return aged.join(scores.select("revid", "score"), "revid")


# -- texts and identifiers -------------------------------------------------------------------------------------------------
def license_text(text: str = "mw_rights_text", page: str = "mw_rights_page", url: str = "mw_rights_url"):
    """A licence's wikitext: its text, a link to its page and its address, as far as they are given."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.concat(F.coalesce(given(text), F.lit("")), F.coalesce(F.concat(F.lit("\n\n[["), given(page), F.lit("]]")), F.lit("")), F.coalesce(F.concat(F.lit("\n\n"), given(url)), F.lit("")))


@F.arrow_udf(StringType())
def _ascii(names: pa.Array) -> pa.Array:
    return pa.array([None if n is None else unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in names.to_pylist()], pa.string())


def disposition(name, ext: str):
    """A header value that names a file: in ASCII, and in full where that differs."""
    full = F.coalesce(F.nullif(F.trim(strings.col(name)), F.lit("")), F.lit("collection"))
    plain = F.replace(F.coalesce(F.nullif(F.trim(F.regexp_replace(_ascii(full), "[ ;:\"',]+", " ")), F.lit("")), F.lit("collection")), F.lit(" "), F.lit("-"))
    more = F.when(plain != full, F.concat(F.lit(";filename*=UTF-8''"), strings.quote(full), F.lit("." + ext))).otherwise(F.lit(""))
    return F.concat(F.lit("inline; filename="), plain, F.lit("." + ext), more)


@F.arrow_udf(StringType())
def canonical_json(texts: pa.Array) -> pa.Array:
    """JSON with sorted keys, indented by four, as collections are compared."""
    return pa.array([None if t is None else json.dumps(json.loads(t), sort_keys=True, indent=4) for t in texts.to_pylist()], pa.string())


def collection_checksum(metabook):
    return F.sha2(canonical_json(strings.col(metabook)), 256)


def random_id(*columns, seed: int = 0):
    """An identifier of 16 digits that follows from the row."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *[strings.col(c).cast("string") for c in columns]), 256), 1, 16)


def metadata(rows: DataFrame, names: list[str], template: str = "saved_book") -> DataFrame:
    """(doc_id, name, value) of some named arguments of a saved book's template. rows: (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                args = templates.call_arguments(text or "", template) or {}
                out += [{"doc_id": key, "name": n, "value": args[n]} for n in names if n in args]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.string()), ("name", pa.string()), ("value", pa.string())]))

    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "doc_id string, name string, value string")


# -- settings --------------------------------------------------------------------------------------------------------------
@dataclass
class Settings:
    """Values from an ini text under those of an environment: ``PREFIX_SECTION_NAME`` comes before the file's entry."""

    values: dict[str, str] = field(default_factory=dict)

    @classmethod
    def read(cls, ini: str, environment: dict[str, str], prefix: str) -> Settings:
        parser = configparser.ConfigParser(interpolation=None)
        parser.read_string(ini)
        values = {f"{s}.{k}".lower(): v for s in parser.sections() for k, v in parser.items(s)}
        for name, value in environment.items():
            head, _, rest = name.partition("_")
            section, _, key = rest.partition("_")
            if head == prefix and key:
                values[f"{section}.{key}".lower()] = value
        return cls(values)

    def get(self, section: str, name: str, default=None, kind: type = str):
        raw = self.values.get(f"{section}.{name}".lower())
        if raw is None:
            return default
        return raw.strip().lower() in ("1", "yes", "true", "on") if kind is bool else kind(raw)


@dataclass
class BuildOptions:
    """What a collection is built from and to; contradictions are errors."""

    output: str | None = None
    post_url: str | None = None
    metabook: str | None = None
    collection_page: str | None = None
    pages: tuple[str, ...] = ()
    image_size: int = 1280

    def check(self) -> BuildOptions:
        if (self.output is None) == (self.post_url is None):
            raise ValueError("either an output or an address to post to")
        if sum(x is not None and x != () for x in (self.metabook, self.collection_page, self.pages or None)) != 1:
            raise ValueError("one of a collection, a collection's page, or pages")
        if self.image_size <= 0:
            raise ValueError("images have a positive size")
        return self


