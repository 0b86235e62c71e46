"""Queries whose markup differs from row to row, with counts that SQL works out from the same columns."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..operators import clean, templates, wikitext
from .queries import query, t
from .step_cases import CASES


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- cleaner ---------------------------------------------------------------------------------------------------------------
_K = "(s_suppkey % 5 + 1)"


@query(" UNION ALL ".join(f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, {_lit(name)} AS \"case\", CAST({before} AS BIGINT) AS before, CAST({after} AS BIGINT) AS after FROM (SELECT s_suppkey, {_K} AS k FROM supplier)" for name, (_, _, _, _, _, before, after) in CASES.items()))
def cleaner_steps(spark, sf):
    """Every cleaning step over markup whose unit stands one to five times."""
    k = F.col("s_suppkey") % 5 + 1
    made = F.array(*[F.struct(F.lit(name).alias("case"), F.concat(F.lit(a), F.repeat(F.lit(u), k.cast("int")), F.lit(b)).alias("text")) for name, (_, _, a, u, b, _, _) in CASES.items()])
    docs = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.explode(made).alias("c")).select("doc_id", "c.case", "c.text")
    return clean.effects(docs, {name: (c[0], c[1]) for name, c in CASES.items()})


# -- parser ----------------------------------------------------------------------------------------------------------------
_KIND = "(l_orderkey + l_linenumber) % 5"
_COUNTED = {
    "Section": f"count(*) FILTER (WHERE {_KIND} = 0)", "Table": f"count(*) FILTER (WHERE {_KIND} = 1)", "Row": f"coalesce(sum(q % 3 + 1) FILTER (WHERE {_KIND} = 1), 0)",
    "Cell": f"coalesce(sum((q % 3 + 1) * (l_linenumber % 2 + 1)) FILTER (WHERE {_KIND} = 1), 0)", "Item": f"coalesce(sum(q % 4 + 1) FILTER (WHERE {_KIND} = 2), 0)",
    "Strong": f"count(*) FILTER (WHERE {_KIND} = 3)", "Emphasized": f"count(*) FILTER (WHERE {_KIND} = 3)", "ArticleLink": f"coalesce(sum(q % 2 + 1) FILTER (WHERE {_KIND} = 3), 0)",
    "PreFormatted": f"count(*) FILTER (WHERE {_KIND} = 4)", "HorizontalRule": f"count(*) FILTER (WHERE {_KIND} = 4)",
}


@query(" UNION ALL ".join(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, '{c}' AS class, CAST({x} AS BIGINT) AS n FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1 HAVING {x} > 0" for c, x in _COUNTED.items()))
def parsed_structures(spark, sf):
    """A page for each order, with a block for each of its lines: headings, tables, lists, styled text with links, preformatted text."""
    q, n, kind = F.col("l_quantity").cast("int"), F.col("l_linenumber"), (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    row = F.concat(F.lit("|-\n|"), F.repeat(F.lit(" a ||"), n % 2), F.lit(" b\n"))
    links = F.concat(F.lit("'''bold''' and ''slanted'' "), F.repeat(F.lit("[[Target|label]] "), q % 2 + 1), F.lit("\n\n"))
    block = (
        F.when(kind == 0, F.concat(F.repeat(F.lit("="), n % 3 + 2), F.lit(" T "), F.repeat(F.lit("="), n % 3 + 2), F.lit("\n")))
        .when(kind == 1, F.concat(F.lit("{|\n"), F.repeat(row, q % 3 + 1), F.lit("|}\n"))).when(kind == 2, F.concat(F.repeat(F.lit("* item\n"), q % 4 + 1), F.lit("\n")))
        .when(kind == 3, links).otherwise(F.lit(" pre\n----\n"))
    )
    lines = t(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", block.alias("b")).alias("x"))
    pages = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("text"))
    nodes = wikitext.parse_pages(pages, key="l_orderkey", columns=["class"])
    return nodes.where(F.col("class").isin(*_COUNTED)).groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"))


def _least_sums() -> str:
    """(a, b, c, least): by all readings of three runs of apostrophes, each tried."""
    rows = []
    for runs in product(range(2, 8), repeat=3):
        sums = []
        for ways in product(*[[(extra + max(0, n - 5), kind) for extra, kind in wikitext._READINGS[min(n, 5)]] for n in runs]):
            toggled = "".join(kind for _, kind in ways)
            sums.append(sum(extra for extra, _ in ways) + toggled.count("b") % 2 + toggled.count("i") % 2)
        rows.append((*runs, min(sums)))
    return ", ".join(map(str, rows))


@query(f"""SELECT l_orderkey, l_linenumber, CAST(v.least AS BIGINT) AS least FROM lineitem JOIN (VALUES {_least_sums()}) v(a, b, c, least)
ON v.a = 2 + l_linenumber % 6 AND v.b = 2 + CAST(l_quantity AS BIGINT) % 6 AND v.c = 2 + l_partkey % 6""")
def apostrophe_runs(spark, sf):
    """Text apostrophes and open styles of the best reading of three runs, against all readings."""
    runs = F.array(2 + F.col("l_linenumber") % 6, 2 + F.col("l_quantity").cast("long") % 6, 2 + F.col("l_partkey") % 6)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", wikitext.least_sum(runs).alias("least"))


_HOSTILE = {"nested tags": ("<i>", 3000), "open links": ("[[", 5000), "deep list": ("*", 3000), "deep table": ("{|\n|", 40), "braces": ("{{", 3000), "bars": ("|", 3000)}


@query(" UNION ALL ".join(f"SELECT n_name AS doc_id, '{name}' AS \"case\", TRUE AS whole, CAST(1 AS BIGINT) AS roots FROM nation" for name in _HOSTILE))
def hostile_pages(spark, sf):
    """Pages that nest and open without end: each gives one tree that holds the page's words."""
    made = F.array(*[F.struct(F.lit(name).alias("case"), F.concat(F.repeat(F.lit(u), F.lit(n)), F.lit(" "), F.col("n_name")).alias("text")) for name, (u, n) in _HOSTILE.items()])
    pages = t(spark, sf, "nation").select(F.explode(made).alias("c"), "n_name").select(F.concat_ws("/", "n_name", "c.case").alias("doc_id"), "c.text")
    nodes = wikitext.parse_pages(pages, columns=["parent", "class", "caption"])
    counts = nodes.groupBy("doc_id").agg(F.max(F.contains(F.col("caption"), F.substring_index("doc_id", "/", 1))).alias("whole"), F.count_if(F.col("parent").isNull()).alias("roots"))
    return counts.select(F.substring_index("doc_id", "/", 1).alias("doc_id"), F.substring_index("doc_id", "/", -1).alias("case"), "whole", "roots")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS page_id, v.k AS "case", v.text || CASE WHEN v.k = 'name' THEN n_name ELSE '' END AS text FROM nation, (VALUES ('month', '2008-02-29'), ('late', '<strong class="error">Error: invalid time</strong>'), ('wide', '262144'), ('name', 'is ')) v(k, text)""")
def hostile_expansion(spark, sf):
    """Dates past a month's end and past the calendar, and a width beyond any text: each page has a result."""
    cases = {"month": "{{#time:Y-m-d|2008-01-31 + 1 month}}", "late": "{{#time:Y-m-d|2008-01-31 + 9999999 day}}", "wide": "{{padleft:a|99999999999|b}}", "name": "is {{{1|"}
    made = F.array(*[F.struct(F.lit(k).alias("case"), F.concat(F.lit(v), F.when(F.lit(k == "name"), F.concat("n_name", F.lit("}}}"))).otherwise(F.lit(""))).alias("rawtext")) for k, v in cases.items()])
    pages = t(spark, sf, "nation").select("n_nationkey", F.explode(made).alias("c")).select(F.concat_ws("/", "n_nationkey", "c.case").alias("page_id"), F.lit("P").alias("title"), "c.rawtext")
    out = templates.expand_pages(pages, spark.createDataFrame([], "name string, body string"))
    shown = F.when(F.length("text") > 1000, F.length("text").cast("string")).otherwise(F.col("text"))
    return out.select(F.substring_index("page_id", "/", 1).alias("page_id"), F.substring_index("page_id", "/", -1).alias("case"), shown.alias("text"))
