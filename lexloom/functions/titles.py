"""Titles and namespaces: the key functions of every join on titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import col

#: Namespace numbers with their names in English and German, canonical names included.
NAMESPACES = {
    "en": {-2: "Media", -1: "Special", 0: "", 1: "Talk", 2: "User", 3: "User talk", 4: "Wikipedia", 5: "Wikipedia talk", 6: "File", 7: "File talk", 8: "MediaWiki", 9: "MediaWiki talk", 10: "Template", 11: "Template talk", 12: "Help", 13: "Help talk", 14: "Category", 15: "Category talk"},
    "de": {-2: "Medium", -1: "Spezial", 0: "", 1: "Diskussion", 2: "Benutzer", 3: "Benutzer Diskussion", 4: "Wikipedia", 5: "Wikipedia Diskussion", 6: "Datei", 7: "Datei Diskussion", 8: "MediaWiki", 9: "MediaWiki Diskussion", 10: "Vorlage", 11: "Vorlage Diskussion", 12: "Hilfe", 13: "Hilfe Diskussion", 14: "Kategorie", 15: "Kategorie Diskussion"},
}
ALIASES = {"en": {"image": 6, "image talk": 7, "wp": 4, "project": 4, "project talk": 5}, "de": {"bild": 6, "bild diskussion": 7}}
#: Words that begin a redirect.
REDIRECTS = {"en": ["#REDIRECT"], "de": ["#REDIRECT", "#WEITERLEITUNG"], "fr": ["#REDIRECT", "#REDIRECTION"], "es": ["#REDIRECT", "#REDIRECCIÓN"]}


def namespace_numbers(lang: str) -> dict[str, int]:
    """Lower-case names, canonical names and aliases of a language's namespaces."""
    names = {v.lower(): k for k, v in NAMESPACES["en"].items() if v}
    names |= {"project": 4, "project talk": 5}
    names |= {v.lower(): k for k, v in NAMESPACES.get(lang, NAMESPACES["en"]).items() if v}
    return names | ALIASES["en"] | ALIASES.get(lang, {})


def _map(entries: dict):
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _capitalised(s):
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def split_name(title, lang: str = "en", default_ns: int = 0, case_sensitive: bool = False):
    """struct(ns, partial, full): underscores are spaces, runs of spaces one, a leading colon means the main namespace, the known prefix
    before the first colon names the namespace, and the first letter is raised."""
    names = NAMESPACES.get(lang, NAMESPACES["en"])
    trimmed = F.regexp_replace(F.trim(F.translate(col(title), "_", " ")), " +", " ")
    colon = trimmed.startswith(":")
    name = F.when(colon, F.trim(F.substring(trimmed, 2, 1 << 30))).otherwise(trimmed)
    base = F.when(colon, F.lit(0)).otherwise(F.lit(default_ns))
    prefix = F.lower(F.trim(F.substring_index(name, ":", 1)))
    hit = F.when(F.contains(name, F.lit(":")), F.try_element_at(_map(namespace_numbers(lang)), prefix))
    ns = F.coalesce(hit, base)
    rest = F.when(hit.isNotNull(), F.trim(F.regexp_replace(name, "^[^:]*:", ""))).otherwise(name)
    rest = F.regexp_replace(rest, "^[‎‏]+|[‎‏]+$", "")
    partial = rest if case_sensitive else _capitalised(rest)
    shown = F.element_at(_map(names), ns)
    return F.struct(ns.alias("ns"), partial.alias("partial"), F.when(shown == "", partial).otherwise(F.concat(shown, F.lit(":"), partial)).alias("full"))


def full_name(title, lang: str = "en", default_ns: int = 0):
    return split_name(title, lang, default_ns)["full"]


def namespace_name(number, lang: str = "en"):
    """``ns:n``: the name of a namespace, empty for unknown numbers."""
    return F.coalesce(F.try_element_at(_map(NAMESPACES.get(lang, NAMESPACES["en"])), col(number).try_cast("int")), F.lit(""))


def talk_ns(number):
    return col(number).bitwiseOR(F.lit(1))


def subject_ns(number):
    return F.when(col(number) < 0, col(number)).otherwise(col(number).bitwiseAND(F.lit(-2)))


def redirect_target(text, lang: str = "en"):
    """The full name that a text redirects to, null if it is no redirect; what follows ``|`` or ``#`` in the link is dropped."""
    words = "|".join(w.replace("#", "\\#") for w in REDIRECTS.get(lang, REDIRECTS["en"]))
    target = F.regexp_extract(col(text), rf"(?iu)^[ \t\n\r\x00\x0B]*(?:{words})\s*:?\s*?\[\[(.*?)\]\]", 1)
    bare = F.substring_index(F.substring_index(target, "|", 1), "#", 1)
    return F.when(F.trim(bare) != "", full_name(bare, lang))


def dump_redirect(text):
    """The simpler rule of dumps: the first link's target as it stands."""
    target = F.regexp_extract(col(text), r"(?i)^\s*#REDIRECT\s*:?\s*\[\[([^\]|]+)", 1)
    return F.when(target != "", F.trim(target))


def interwiki(titles: DataFrame, prefixes: DataFrame, title: str = "title") -> DataFrame:
    """Adds prefix, partial and url for titles that begin with a prefix of the (small) table (prefix, url)."""
    name = F.regexp_replace(F.trim(F.translate(F.col(title), "_", " ")), "^:\\s*", "")
    marked = titles.withColumn("iw_prefix", F.when(F.contains(name, F.lit(":")), F.lower(F.trim(F.substring_index(name, ":", 1))))).withColumn("iw_partial", F.translate(F.regexp_replace(F.regexp_replace(name, "^[^:]*:", ""), r"^[ _\n\t\r]+|[ _\n\t\r]+$", ""), " ", "_"))
    found = prefixes.select(F.lower("prefix").alias("iw_prefix"), F.col("url").alias("iw_url"))
    out = marked.join(found, "iw_prefix", "left")
    return out.withColumn("iw_url", F.replace("iw_url", F.lit("$1"), F.col("iw_partial"))).withColumn("iw_partial", F.when(F.col("iw_url").isNotNull(), F.col("iw_partial")))


def namespace_table(spark: SparkSession, lang: str = "en") -> DataFrame:
    """(ns, name) as a table, for joins."""
    return spark.createDataFrame([(k, v) for k, v in NAMESPACES.get(lang, NAMESPACES["en"]).items()], "ns int, name string")


def plain_split(title: str, lang: str = "en", default_ns: int = 0) -> tuple[int, str, str]:
    """The same as :func:`split_name` for one title, for use within document functions: (ns, partial, full)."""
    import re

    name = re.sub(" +", " ", title.replace("_", " ").strip())
    if name.startswith(":"):
        name, default_ns = name[1:].strip(), 0
    ns, rest = default_ns, name
    if ":" in name:
        prefix, after = name.split(":", 1)
        hit = namespace_numbers(lang).get(prefix.strip().lower())
        if hit is not None:
            ns, rest = hit, after.strip()
    rest = rest.strip("‎‏")
    rest = rest[:1].upper() + rest[1:]
    shown = NAMESPACES.get(lang, NAMESPACES["en"]).get(ns, "")
    return ns, rest, f"{shown}:{rest}" if shown else rest
