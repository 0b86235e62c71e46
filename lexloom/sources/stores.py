"""Sources and sinks of page stores: revision files, dumps, snapshots (zip, SQLite), metabooks, collection pages, API responses."""

from __future__ import annotations

import io
import json
import os
import posixpath
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARK = "\n --page-- "
HEADER = "title string, ns int, revid long, expanded int"


def read_revisions(spark: SparkSession, path: str, wiki_id: str = "") -> DataFrame:
    """A revision file: records between page marks, each a JSON line and text. What stands before the first mark is dropped."""
    raw = spark.read.option("lineSep", MARK).text(path).withColumn("value", F.regexp_replace("value", f"^{MARK.strip(chr(10))}", "")).where(F.trim("value").startswith("{"))
    head = F.from_json(F.substring_index("value", "\n", 1), HEADER)
    rest = F.when(F.contains(F.col("value"), F.lit("\n")), F.regexp_replace("value", r"^[^\n]*\n", "")).otherwise(F.lit(""))
    return raw.select(F.lit(wiki_id).alias("wiki_id"), head.alias("h"), rest.alias("rawtext")).select("wiki_id", "h.ns", "h.title", "h.revid", (F.coalesce("h.expanded", F.lit(0)) == 1).alias("expanded"), "rawtext")


def write_revisions(pages: DataFrame, path: str) -> None:
    """Writes records of (ns, title, revid, expanded, rawtext), the first of equal revision numbers."""
    once = pages.where(F.col("revid").isNull()).unionByName(pages.where(F.col("revid").isNotNull()).dropDuplicates(["revid"]))
    head = F.to_json(F.struct("ns", "title", "revid", F.when(F.col("expanded"), F.lit(1)).alias("expanded")))
    once.select(F.concat(F.lit(" --page-- "), head, F.lit("\n"), F.coalesce("rawtext", F.lit(""))).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes one small file through Hadoop's file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()
    return path


def read_revision_folder(spark: SparkSession, path: str) -> DataFrame:
    """Reads back what write_revisions has written: part files begin with a mark as well."""
    raw = spark.read.text(path, wholetext=True)
    records = raw.select(F.explode(F.split("value", r"(?:^|\n) --page-- ")).alias("value")).where(F.trim("value").startswith("{"))
    head = F.from_json(F.substring_index("value", "\n", 1), HEADER)
    text = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\n$", "")
    return records.select(head.alias("h"), text.alias("rawtext")).select("h.ns", "h.title", "h.revid", (F.coalesce("h.expanded", F.lit(0)) == 1).alias("expanded"), "rawtext")


def read_dump(spark: SparkSession, path: str, skip_redirects: bool = False) -> DataFrame:
    """An XML dump (plain or .bz2): one row a page, its last revision."""
    if path.endswith(".7z"):
        raise ValueError("7z archives can't be read; decompress them first")
    schema = "title string, id long, revision array<struct<id:long,timestamp:string,contributor:struct<username:string,id:long>,minor:string,comment:string,text:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    last = F.try_element_at("revision", F.lit(-1))
    out = pages.select("title", F.col("id").alias("pageid"), last.id.alias("revid"), last.timestamp.alias("timestamp"), last.contributor.username.alias("username"), last.contributor.id.alias("userid"), last.minor.isNotNull().alias("minor"), last.comment.alias("comment"), last.text.alias("text"))
    return out.where(~F.coalesce(F.col("text").rlike(r"(?i)^\s*#REDIRECT"), F.lit(False))) if skip_redirects else out


def safe_member(name: str) -> bool:
    """Whether an archive's member stays below the folder it is unpacked to."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    return not (clean.startswith(("/", "../")) or clean == ".." or (len(clean) > 1 and clean[1] == ":"))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of archives' members, one task an archive; a member that leaves its folder is an error."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for info in z.infolist():
                        if not safe_member(info.filename):
                            raise ValueError(f"{archive}: {info.filename} leaves the folder")
                        if not info.is_dir():
                            yield pa.RecordBatch.from_pylist([{"archive": archive, "name": info.filename, "content": z.read(info)}], pa.schema([("archive", pa.string()), ("name", pa.string()), ("content", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(members, "archive string, name string, content binary")


def read_sqlite(spark: SparkSession, path: str, table: str = "unnamed") -> DataFrame:
    """(source, key, value) of key-value databases, values as JSON text."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with tempfile.NamedTemporaryFile(suffix=".db") as f:  # gone at the end of the file's turn
                    f.write(blob)
                    f.flush()
                    with sqlite3.connect(f"file:{f.name}?mode=ro", uri=True) as db:
                        rows = [{"source": source, "key": str(k), "value": v.decode() if isinstance(v, bytes) else str(v)} for k, v in db.execute(f'SELECT key, value FROM "{table}"')]
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("source", pa.string()), ("key", pa.string()), ("value", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(entries, "source string, key string, value string")


_ITEM = "type:string,title:string,displaytitle:string,revision:string,content_type:string,wikiident:string"
METABOOK = f"type string, version int, title string, subtitle string, editor string, summary string, items array<struct<{_ITEM},items:array<struct<{_ITEM}>>>>, licenses array<struct<type:string,name:string,mw_license_url:string,mw_rights_text:string,mw_rights_page:string,mw_rights_url:string>>, wikis array<struct<type:string,ident:string,baseurl:string>>"


def read_metabook(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METABOOK).option("multiLine", True).json(path)


def _framed(line, start: str, end: str):
    """(whether a line has this start and end and something between them, what lies between them)"""
    inner = F.substring(line, len(start) + 1, 1 << 30)
    inner = F.substring(inner, F.lit(1), F.length(inner) - len(end))
    return F.startswith(line, F.lit(start)) & F.endswith(line, F.lit(end)) & (F.length(line) > len(start) + len(end)), inner


def book_line(line):
    """struct(type, title, displaytitle, revision) of a line of a collection's page: headings, ``;`` chapters, ``:[[ ]]`` articles, ``:[ ]`` links to old
    revisions and templates; every other line is summary. A link's parts are told by the first bar."""
    none = F.lit(None).cast("string")
    made = lambda kind, title, shown=none, revision=none: F.struct(F.lit(kind).alias("type"), F.trim(title).alias("title"), F.nullif(F.trim(shown), F.lit("")).alias("displaytitle"), revision.alias("revision"))
    signs = F.length(line) - F.length(F.ltrim(line, F.lit("=")))
    behind = F.length(line) - F.length(F.rtrim(line, F.lit("=")))
    heading = (signs == behind) & (F.length(line) > 2 * signs)
    text = F.trim(line, F.lit("="))
    linked, link = _framed(line, ":[[", "]]")
    link = F.regexp_replace(link, "^:", "")
    target = F.substring_index(link, "|", 1)
    label = F.when(F.contains(link, F.lit("|")), F.substring(link, F.length(target) + 2, F.lit(1 << 30)))
    dated, old = _framed(line, ":[{{fullurl:", "]")
    call, after = F.substring_index(old, "}}", 1), F.substring_index(old, "}}", -1)
    name = F.substring_index(call, "|oldid=", 1)
    called, inner = _framed(line, "{{", "}}")
    return (
        F.when(heading & (signs == 2), made("title", text)).when(heading & (signs == 3), made("subtitle", text))
        .when(F.startswith(line, F.lit(";")) & (F.length(line) > 1), made("chapter", F.substring(line, 2, 1 << 30)))
        .when(linked & (F.length(target) > 0) & ~F.contains(target, F.lit("]")), made("article", target, label))
        .when(dated & F.contains(call, F.lit("|oldid=")) & F.contains(old, F.lit("}}")), made("oldarticle", name, after, F.substring(call, F.length(name) + 8, F.lit(1 << 30))))
        .when(called, made("template", inner)).otherwise(made("summary", line))
    )


def parse_collection_pages(pages: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line_no, type, title, displaytitle, revision, chapter_no) of collections written as pages; lines that are nothing else are summary."""
    lines = pages.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where(F.col("line") != "")
    typed = lines.select(key, "line_no", book_line(F.col("line")).alias("b")).select(key, "line_no", "b.*")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return typed.withColumn("chapter_no", F.sum(F.when(F.col("type") == "chapter", 1).otherwise(0)).over(w))


def open_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot folder: revisions, and each JSON sidecar that is there."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(name: str) -> bool:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        return where.getFileSystem(conf).exists(where)

    tables = {}
    for revisions in ("revisions-1.txt", "revisions.txt"):
        if there(revisions):
            tables["pages"] = read_revisions(spark, f"{path}/{revisions}")
            break
    for name in ("redirects", "siteinfo", "excluded", "nfo", "licenses", "authors", "imageinfo"):
        if there(f"{name}.json"):
            raw = spark.read.text(f"{path}/{name}.json", wholetext=True)
            value = F.regexp_replace("value", "^﻿", "")
            if name == "redirects":
                tables[name] = raw.select(F.explode(F.from_json(value, "map<string,string>")).alias("from_title", "to_title"))
            elif name == "excluded":
                tables[name] = raw.select(F.explode(F.from_json(value, "array<string>")).alias("title"))
            else:
                tables[name] = raw.select(F.explode(F.from_json(value, "map<string,string>")).alias("key", "value"))
    return tables


def open_wikis(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    """Pages of several snapshots under their identifiers."""
    out = None
    for ident, path in places.items():
        if "/" in ident or ".." in ident:
            raise ValueError(f"bad identifier {ident!r}")
        own = open_snapshot(spark, path)["pages"].withColumn("wiki_id", F.lit(ident))
        out = own if out is None else out.unionByName(own)
    return out


def write_sidecars(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_key_values(df: DataFrame, key: str, path: str) -> None:
    """A keyed table with all other columns as one JSON value."""
    df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("value")).write.mode("overwrite").parquet(path)


# -- API responses ---------------------------------------------------------------------------------------------------
PAGE = "pageid:long,ns:int,title:string,missing:string,revisions:array<struct<revid:long,`*`:string,user:string,timestamp:string,comment:string,anon:string,minor:string,size:long>>,images:array<struct<title:string>>,templates:array<struct<title:string>>,categories:array<struct<title:string>>,contributors:array<struct<name:string,userid:long>>,anoncontributors:int,imageinfo:array<struct<url:string,thumburl:string,descriptionurl:string,user:string,sha1:string,size:long>>"
RESPONSE = f"query struct<pages:map<string,struct<{PAGE}>>,redirects:array<struct<`from`:string,`to`:string>>,categorymembers:array<struct<title:string,ns:int>>>"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored API responses, one JSON document a file or line; a byte order mark in front is dropped."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "^(﻿|ï»¿)", "").alias("value"))
    return raw.select(F.from_json("value", RESPONSE).alias("r")).select("r.query")


def response_pages(responses: DataFrame) -> DataFrame:
    return responses.select(F.explode(F.map_values("query.pages")).alias("p")).select("p.*")


def response_edits(responses: DataFrame) -> DataFrame:
    """(title, revid, user, anon, minor, size, comment): flags are there or not."""
    return response_pages(responses).select("title", F.explode("revisions").alias("r")).select("title", "r.revid", "r.user", F.col("r.anon").isNotNull().alias("anon"), F.col("r.minor").isNotNull().alias("minor"), "r.size", "r.comment")


def response_redirects(responses: DataFrame) -> DataFrame:
    return responses.select(F.explode("query.redirects").alias("r")).select(F.col("r.from").alias("from_title"), F.col("r.to").alias("to_title")).distinct()


def response_contributors(responses: DataFrame) -> DataFrame:
    return response_pages(responses).select("title", "anoncontributors", F.explode_outer("contributors").alias("c")).select("title", F.col("c.name").alias("name"), "anoncontributors")


def fetch_pages(ask, start: dict, rounds: int = 1000) -> Iterator[dict]:
    """Follows a paged API: ``ask(parameters)`` gives one response; its continuation is added until there is none or it repeats. Used by a data source's reader, one series of requests a partition."""
    more: dict = {}
    for _ in range(rounds):
        answer = ask(start | more)
        yield answer
        after = answer.get("query-continue") or {}
        new = {k: v for part in after.values() for k, v in part.items()} or answer.get("continue") or {}
        if not new or new == more:
            return
        more = new


def backoff(attempts: int, base: float = 1.0, most: float = 60.0) -> list[float]:
    """Seconds to wait before each further attempt."""
    return [min(most, base * 2**k) for k in range(attempts)]


def register_api_source(spark: SparkSession) -> None:
    """Registers the format ``pagedapi``: option ``folder`` names stored answers (JSON lists, one file a series) that stand for a server."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.folder = options["folder"]

        def partitions(self):
            return [InputPartition(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".json")]

        def read(self, partition):
            with open(partition.value) as f:
                answers = json.load(f)
            series = iter(answers)
            for answer in fetch_pages(lambda _: next(series, {}), {}):
                yield (os.path.basename(partition.value), json.dumps(answer))

    class PagedApi(DataSource):
        @classmethod
        def name(cls):
            return "pagedapi"

        def schema(self):
            return "series string, answer string"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(PagedApi)
