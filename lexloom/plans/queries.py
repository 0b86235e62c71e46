"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

The tables hold no wiki markup, so the operators run over their text and HTML columns, or over markup that a query builds from columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions, markup, styles, text, times, titles
from ..operators import clean, layout, relational, templates, tree, wikitext
from ..session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- page store ------------------------------------------------------------------------------------------------------
@query("SELECT o_custkey AS title, o_orderkey AS revid, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def newest_revision(spark, sf):
    pages = t(spark, sf, "orders").select(F.col("o_custkey").alias("title"), F.col("o_orderkey").alias("revid"), F.col("o_totalprice").alias("price"))
    return relational.newest(pages)


@query("SELECT o_custkey AS title, max(o_orderkey) AS revid FROM orders GROUP BY 1")
def latest_revision(spark, sf):
    return relational.latest_revision(t(spark, sf, "orders").select(F.col("o_custkey").alias("title"), F.col("o_orderkey").alias("revid")))


_REDIRECTS = [("CANADA", "UNITED STATES"), ("BRAZIL", "ARGENTINA"), ("FRANCE", "NOWHERE"), ("NATION_1", "NATION_2"), ("NATION_3", "NATION_4"), ("NATION_5", "ATLANTIS")]
_SQL_REDIRECTS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _REDIRECTS) + ") r(from_title, to_title)"


@query(f"""SELECT n.n_name AS title, coalesce(r.to_title, n.n_name) AS resolved, coalesce(a.n_nationkey, b.n_nationkey) AS key
FROM nation n LEFT JOIN {_SQL_REDIRECTS} ON n.n_name = r.from_title LEFT JOIN nation a ON a.n_name = coalesce(r.to_title, n.n_name) LEFT JOIN nation b ON b.n_name = n.n_name""")
def redirect_resolution(spark, sf):
    pages = t(spark, sf, "nation").select(F.col("n_name").alias("title"), F.col("n_nationkey").alias("key"))
    return relational.resolve(pages.select("title"), pages, spark.createDataFrame(_REDIRECTS, "from_title string, to_title string"))


@query("""SELECT CAST(user_id % 50 AS INTEGER) AS title, coalesce(string_agg(DISTINCT CASE WHEN NOT anon AND NOT bot THEN event_type END, ',' ORDER BY CASE WHEN NOT anon AND NOT bot THEN event_type END), '') AS names, CAST(count(*) FILTER (WHERE anon) AS BIGINT) AS anonymous
FROM (SELECT *, event_id % 3 = 0 AS anon, event_type = 'error' AS bot FROM events) GROUP BY 1""")
def authors_by_page(spark, sf):
    e = t(spark, sf, "events")
    anon = F.col("event_id") % 3 == 0
    name = F.when(F.col("event_type") == "error", F.lit("errorBot")).otherwise(F.col("event_type"))
    edits = e.select((F.col("user_id") % 50).cast("int").alias("title"), F.when(anon, F.lit("127.0.0.1")).otherwise(name).alias("user"), anon.alias("anon"), F.lit("").alias("comment"))
    out = relational.authors(edits)
    names = F.filter("authors", lambda a: ~a.startswith("ANONIPEDITS:"))
    count = F.regexp_extract(F.element_at("authors", -1), r"ANONIPEDITS:(\d+)", 1).try_cast("long")
    return out.select("title", F.array_join(names, ",").alias("names"), count.alias("anonymous"))


@query("""SELECT CAST(user_id % 20 AS INTEGER) AS title, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names, CAST(sum(event_id % 4) AS BIGINT) AS anonymous FROM events GROUP BY 1""")
def contributors_merged(spark, sf):
    rows = t(spark, sf, "events").select((F.col("user_id") % 20).cast("int").alias("title"), F.col("event_type").alias("name"), (F.col("event_id") % 4).alias("anoncontributors"))
    return relational.contributors(rows).select("title", F.array_join("names", ",").alias("names"), "anonymous")


@query("SELECT p_brand AS category, string_agg(p_name, '|' ORDER BY p_name) AS members FROM part GROUP BY 1")
def category_members(spark, sf):
    out = relational.category_members(t(spark, sf, "part"), "p_brand", "p_name")
    return out.select(F.col("p_brand").alias("category"), F.array_join("members", "|").alias("members"))


@query("SELECT DISTINCT url FROM pages WHERE url BETWEEN 'http://a' AND 'https://m'")
def title_range(spark, sf):
    return relational.select_titles(t(spark, sf, "pages"), "http://a", "https://m", "url")


@query("SELECT DISTINCT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 40)")
def unscheduled_work(spark, sf):
    done = t(spark, sf, "lineitem").where(F.col("l_quantity") > 40).select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.unscheduled(t(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 15 AS BIGINT) AS block FROM customer")
def request_blocks(spark, sf):
    return relational.blocks(t(spark, sf, "customer").select("c_custkey"), "c_custkey", 15)


@query("SELECT l_orderkey AS doc_id, l_linenumber AS pos, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f) AS number FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS f FROM lineitem)")
def reference_numbers(spark, sf):
    refs = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("name"))
    return relational.reference_numbers(refs).drop("name")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events")
def monotone_progress(spark, sf):
    return relational.running_max(t(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value").select("event_id", "progress")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS calls FROM events")
def rate_window(spark, sf):
    return relational.rate(t(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600).select("event_id", "calls")


@query("SELECT user_id AS switch_id, event_id AS pos, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM (SELECT *, CASE WHEN event_type <> 'view' THEN event_type END AS v FROM events)")
def switch_fall_through(spark, sf):
    cases = t(spark, sf, "events").select(F.col("user_id").alias("switch_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("value"))
    return relational.fall_through(cases)


@query("""SELECT user_id, run, any_value(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, run""")
def font_runs(spark, sf):
    return relational.runs(t(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("""SELECT s_suppkey AS image, CASE WHEN s_nationkey % 4 = 0 THEN TRUE WHEN s_nationkey % 4 = 1 THEN FALSE ELSE TRUE END AS shown, CASE s_nationkey % 4 WHEN 0 THEN 'Free' WHEN 1 THEN 'Nonfree' ELSE '' END AS licence FROM supplier""")
def license_gate(spark, sf):
    licenses = spark.createDataFrame([("cc-by", "Free", "free-display"), ("fairuse", "Nonfree", "nonfree"), ("logo", "Logo", "other")], "name string, display_name string, license_class string")
    kind = F.element_at(F.array(F.lit("CC-by"), F.lit("FairUse"), F.lit("logo"), F.lit("mystery")), (F.col("s_nationkey") % 4 + 1).cast("int"))
    images = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("image"), kind.alias("template"), F.lit(1).alias("ord"))
    return relational.license_gate(images, licenses, "blacklist")


@query("SELECT round(CAST(count(*) FILTER (WHERE s) AS DOUBLE) / count(*), 6) AS ratio FROM (SELECT o_custkey, max(o_totalprice) > 150000 AS s FROM orders GROUP BY 1)")
def free_ratio(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("url"), (F.col("o_totalprice") > 150000).alias("shown"))
    return relational.free_ratio(rows).select(F.round("ratio", 6).alias("ratio"))


@query("SELECT event_type AS channel, CAST(count(*) FILTER (WHERE user_id % 5 IN (0, 1)) AS BIGINT) AS success, CAST(count(*) FILTER (WHERE user_id % 5 = 2) AS BIGINT) AS error, CAST(count(*) FILTER (WHERE user_id % 5 = 3) AS BIGINT) AS timeout, CAST(0 AS BIGINT) AS killed, CAST(count(*) FILTER (WHERE user_id % 5 = 4) AS BIGINT) AS busy FROM events GROUP BY 1")
def channel_stats(spark, sf):
    from ..streaming import jobs

    state = F.element_at(F.array(*[F.lit(s) for s in ("success", "success", "error", "timeout", "waiting")]), (F.col("user_id") % 5 + 1).cast("int"))
    return jobs.channel_stats(t(spark, sf, "events").select(F.col("event_type").alias("channel"), state.alias("state"), F.lit("bad").alias("error")))


@query("SELECT CAST(event_id AS VARCHAR) AS jobid, CASE WHEN event_id % 3 = 0 THEN 'success' WHEN event_id % 3 = 1 THEN 'error' ELSE 'timeout' END AS state FROM events")
def job_replay(spark, sf):
    """The queue's state machine over a log with every event as a job: a third of the jobs finishes in time, a third with an error, a third too late."""
    return _replayed(t(spark, sf, "events"))


def _replayed(e):
    from ..streaming import jobs

    k = F.col("event_id") % 3
    push = e.select(F.col("event_id").cast("string").alias("jobid"), F.lit(0.0).alias("event_time"), F.lit("push").alias("op"), F.lit(None).cast("string").alias("error"))
    finish = e.select(F.col("event_id").cast("string").alias("jobid"), F.when(k == 2, 500.0).otherwise(5.0).alias("event_time"), F.lit("finish").alias("op"), F.when(k == 1, F.lit("failed")).alias("error"))
    log = push.unionByName(finish).withColumns({"channel": F.lit("render"), "priority": F.lit(0), "serial": F.lit(0), "timeout_s": F.lit(120.0), "ttl_s": F.lit(3600.0), "info": F.lit(None).cast("string")})
    return jobs.replay(log).where(F.col("state") != "gone").unionByName(jobs.replay(log.where((F.col("op") == "push")), until=125.0).join(finish.where(F.col("event_time") > 125).select("jobid"), "jobid", "left_semi")).select("jobid", "state")


# -- titles and strings ------------------------------------------------------------------------------------------------
@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 10 WHEN 1 THEN 14 ELSE 0 END AS ns, CASE p_size % 3 WHEN 0 THEN 'Template:' WHEN 1 THEN 'Category:' ELSE '' END || upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS "full" FROM part""")
def split_names(spark, sf):
    prefix = F.when(F.col("p_size") % 3 == 0, F.lit(" template: ")).when(F.col("p_size") % 3 == 1, F.lit("Category:_")).otherwise(F.lit(":"))
    name = titles.split_name(F.concat(prefix, F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))))
    return t(spark, sf, "part").select("p_partkey", name["ns"].alias("ns"), name["full"].alias("full"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Customer ' || c_custkey END AS target FROM customer""")
def redirect_targets(spark, sf):
    link = F.concat(F.lit(" #redirect: [[customer_"), F.col("c_custkey"), F.lit("#part|label]] rest"))
    plain = F.concat(F.lit("text [[customer "), F.col("c_custkey"), F.lit("]]"))
    return t(spark, sf, "customer").select("c_custkey", titles.redirect_target(F.when(F.col("c_custkey") % 2 == 0, link).otherwise(plain)).alias("target"))


@query("""SELECT p_partkey, lower(substr(p_name, 1, 1)) || substr(p_name, 2) AS lcfirst, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS ucfirst, upper(p_name) AS uc, lower(p_name) AS lc FROM part""")
def letter_case(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.lcfirst("p_name").alias("lcfirst"), text.ucfirst("p_name").alias("ucfirst"), text.uc("p_name").alias("uc"), text.lc("p_name").alias("lc"))


@query("""SELECT p_partkey, CASE WHEN length(s) >= 6 THEN s ELSE lpad(s, 6, 'ab') END AS padleft, CASE WHEN length(s) >= 6 THEN s ELSE rpad(s, 6, 'ab') END AS padright FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS s FROM part)""")
def padding(spark, sf):
    s = F.col("p_partkey").cast("string")
    return t(spark, sf, "part").select("p_partkey", text.padleft(s, F.lit("6"), "ab").alias("padleft"), text.padright(s, F.lit("6"), "ab").alias("padright"))


@query("""SELECT page_id, array_to_string(p[1:2], '/') AS first_two, array_to_string(p[3:], '/') AS from_third, p[len(p)] AS last FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)""")
def title_parts(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.titleparts("url", 2).alias("first_two"), text.titleparts("url", 0, 3).alias("from_third"), text.subpagename("url").alias("last"))


@query("""SELECT p_partkey, replace(p_name, ' ', '+') AS encoded, replace(p_name, ' ', '_') AS anchor, '/wiki/' || p_name AS localurl, '/wiki/' || replace(p_name, ' ', '%20') AS localurle, 'http://h/' || upper(substr(p_name, 1, 1)) || lower(replace(substr(p_name, 2), ' ', '_')) AS fullurl FROM part""")
def url_functions(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.urlencode("p_name").alias("encoded"), text.anchorencode("p_name").alias("anchor"), text.localurl("p_name").alias("localurl"), text.localurle("p_name").alias("localurle"), text.fullurl("p_name", "http://h").alias("fullurl"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS server, NOT regexp_matches(url, '^[a-z]+://(localhost|127\.0\.|192\.168\.)') AS good, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages""")
def url_parts(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.servername("url").alias("server"), text.good_base_url("url").alias("good"), F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = l_quantity THEN 'same' ELSE 'other' END AS ifeq, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS ifs FROM lineitem""")
def comparisons(spark, sf):
    li = t(spark, sf, "lineitem")
    a, b = F.concat(F.lit("+0"), F.col("l_linenumber").cast("string")), F.col("l_quantity").cast("string")
    return li.select("l_orderkey", "l_linenumber", text.ifeq(a, b, F.lit("same"), F.lit("other")).alias("ifeq"), text.if_(F.when(F.col("l_returnflag") == "N", F.lit("  ")).otherwise(F.lit("x")), F.concat(F.lit(" "), F.col("l_returnflag")), F.lit(" ")).alias("ifs"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'rest' END AS literal FROM orders""")
def switch_literal(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", text.switch("o_orderstatus", [("f", "no"), ("F", "done"), ("X", None), ("O", "open")], "rest").alias("literal"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) * l_linenumber + 7 AS VARCHAR) AS product, CAST(CAST(l_quantity AS BIGINT) % 7 AS VARCHAR) AS rest, CASE WHEN l_quantity > 25 THEN '1' ELSE '0' END AS larger, CAST(l_linenumber * l_linenumber AS VARCHAR) AS power FROM lineitem""")
def expressions_evaluated(spark, sf):
    return _evaluated(t(spark, sf, "lineitem"))


def _evaluated(li):
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    make = lambda *p: expressions.expr_column(F.concat(*p))
    return li.select("l_orderkey", "l_linenumber", make(q, F.lit(" * "), n, F.lit(" + 7")).alias("product"), make(q, F.lit(" mod 7")).alias("rest"), make(q, F.lit(" > 25 and not 0")).alias("larger"), make(F.lit("-"), n, F.lit("^2")).alias("power"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ymd, CAST(day(o_orderdate) AS VARCHAR) || '.' || CAST(month(o_orderdate) AS VARCHAR) || '.' AS short, strftime(o_orderdate, '%b %B %a %A') AS names, CAST(dayofyear(o_orderdate) - 1 AS VARCHAR) AS z, CAST(isodow(o_orderdate) AS VARCHAR) || CAST(isodow(o_orderdate) % 7 AS VARCHAR) AS dow, lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week, CAST(day(last_day(o_orderdate)) AS VARCHAR) AS days, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM orders""")
def time_formats(spark, sf):
    f = lambda fmt: times.format_time(fmt, "o_orderdate")
    return t(spark, sf, "orders").select("o_orderkey", f("Y-m-d").alias("ymd"), f("j.n.").alias("short"), f("M F D l").alias("names"), f("z").alias("z"), f("Nw").alias("dow"), f("W").alias("week"), f("t").alias("days"), f("c").alias("iso"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '2008-02-09' WHEN c_custkey % 3 = 1 THEN '2008-02-10' ELSE '<strong class="error">Error: invalid time</strong>' END AS parsed FROM customer""")
def time_parsing(spark, sf):
    s = F.when(F.col("c_custkey") % 3 == 0, F.lit("09 Feb 2008 10:55:17")).when(F.col("c_custkey") % 3 == 1, F.lit("2008-2-9 + 1 day")).otherwise(F.lit("some day"))
    rows = t(spark, sf, "customer").select("c_custkey", s.alias("s"), F.lit("2000-01-01 00:00:00").cast("timestamp").alias("clock"))
    return rows.select("c_custkey", times.time("Y-m-d", "s", "clock").alias("parsed"))


@query("""SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey * 1000 AS VARCHAR)) <= 3 THEN CAST(o_orderkey * 1000 AS VARCHAR) ELSE format('{:,}', o_orderkey * 1000) END AS grouped FROM orders""")
def format_numbers(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", text.formatnum((F.col("o_orderkey") * 1000).cast("string")).alias("grouped"))


@query("""SELECT s_suppkey, sha1(CAST(s_suppkey AS VARCHAR) || 'x' || CAST(s_nationkey AS VARCHAR) || 'x1xx5') AS map_id, substr(sha256(s_name || chr(10) || CAST(s_suppkey AS VARCHAR)), 1, 16) AS collection FROM supplier""")
def identifiers(spark, sf):
    rows = t(spark, sf, "supplier").withColumns({"lat": F.lit("1"), "lon": F.lit(None).cast("string"), "zoom": F.lit("5")})
    return rows.select("s_suppkey", text.mapframe_id("s_suppkey", "s_nationkey", "lat", "lon", "zoom").alias("map_id"), text.collection_id("s_name", "s_suppkey").alias("collection"))


@query(f"""SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS rot FROM part""")
def rot13(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.rot13("p_name").alias("rot"))


# -- styles -------------------------------------------------------------------------------------------------------------
@query("""SELECT p_partkey, round((p_partkey % 256) / 255.0, 6) AS r, round((p_size % 256) / 255.0, 6) AS g, CAST(1 AS DOUBLE) AS b, round(least(1.0, 0.3 * (p_partkey % 256) / 255.0 + 0.59 * (p_size % 256) / 255.0 + 0.11), 6) AS grey FROM part""")
def colours(spark, sf):
    c = styles.colour(F.concat(F.lit("rgb("), F.col("p_partkey") % 256, F.lit(", "), F.col("p_size") % 256, F.lit(", 255)")))
    return t(spark, sf, "part").select("p_partkey", F.round(c["r"], 6).alias("r"), F.round(c["g"], 6).alias("g"), F.round(c["b"], 6).alias("b"), F.round(styles.greyscale(c, 0.0), 6).alias("grey"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size * 0.75 WHEN 2 THEN p_size * 9.6 ELSE p_size / 100.0 * 400 END AS points FROM part""")
def lengths(spark, sf):
    unit = F.element_at(F.array(F.lit("pt"), F.lit("px"), F.lit("em"), F.lit("%")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t(spark, sf, "part").withColumn("ref", F.lit(400.0)).select("p_partkey", F.round(styles.points(F.concat(F.col("p_size").cast("string"), unit), "ref"), 6).alias("points"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'thumb' END AS kind, CASE p_partkey % 3 WHEN 1 THEN 'left' END AS align, p_size AS width, p_name AS caption FROM part""")
def image_modifiers(spark, sf):
    option = F.element_at(F.array(F.lit("thumb"), F.lit("left"), F.lit("border")), (F.col("p_partkey") % 3 + 1).cast("int"))
    m = t(spark, sf, "part").withColumn("parts", F.array(option, F.concat(F.col("p_size").cast("string"), F.lit("px")), F.col("p_name"))).select("p_partkey", styles.image_modifiers("parts").alias("m"), "p_name")
    return m.select("p_partkey", "m.kind", "m.align", "m.width", F.when(F.col("m.caption") == F.lower("p_name"), F.col("p_name")).otherwise(F.col("m.caption")).alias("caption"))


@query("""SELECT doc_id, regexp_matches(text, '[\\x{0}-\\x{7F}]') AS latin, regexp_matches(text, '[\\x{80}-\\x{FF}]') AS latin1, regexp_matches(text, '[\\x{400}-\\x{4FF}]') AS cyrillic FROM documents""")
def script_blocks(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", styles.scripts("text").alias("s"))
    return d.select("doc_id", F.array_contains("s", "Basic Latin").alias("latin"), F.array_contains("s", "Latin-1 Supplement").alias("latin1"), F.array_contains("s", "Cyrillic").alias("cyrillic"))


# -- markup ----------------------------------------------------------------------------------------------------------------
@query(r"""SELECT page_id, lower(tag[2:]) AS name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*')) AS tag FROM (SELECT page_id, regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>') AS whole FROM pages) w, LATERAL (SELECT array_to_string(w.whole, '') AS html)) GROUP BY 1, 2""")
def html_tags(spark, sf):
    out = markup.tags(t(spark, sf, "pages").select("page_id", "html"), "html").where(~F.col("closes"))
    return out.groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^<>]*?href\s*=\s*"([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def html_links(spark, sf):
    tags = markup.tags(t(spark, sf, "pages").select("page_id", "html"), "html").where((F.col("name") == "a") & ~F.col("closes")).withColumn("href", markup.attribute("attrs", "href")).where(F.col("href").isNotNull())
    return tags.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, href, any_value(n) AS repeats FROM (SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^<>]*?href\s*=\s*"([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2) WHERE n > 1 GROUP BY 1, 2""")
def repeated_links(spark, sf):
    tags = markup.tags(t(spark, sf, "pages").select("page_id", "html"), "html").where((F.col("name") == "a") & ~F.col("closes")).withColumn("href", markup.attribute("attrs", "href")).where(F.col("href").isNotNull())
    return layout.repeated(tags.select("page_id", "href")).select("page_id", "href", "repeats")


@query(r"""SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN regexp_matches(l, '^\s*:*\{\|') THEN 'table' WHEN regexp_matches(l, '^\s*\|\}') THEN 'table_end' WHEN regexp_matches(l, '^\s*\|-') THEN 'row' WHEN regexp_matches(l, '^\s*\|\+') THEN 'caption' WHEN regexp_matches(l, '^\s*[|!]') THEN 'cell' WHEN regexp_matches(l, '^=+.*=+\s*$') THEN 'section' WHEN regexp_matches(l, '^----') THEN 'rule' WHEN regexp_matches(l, '^[:;#*]+') THEN 'item' WHEN regexp_matches(l, '^ \s*\S') THEN 'pre' WHEN regexp_matches(l, '^\s*$') THEN 'blank' ELSE 'text' END AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY 1, 2""")
def line_kinds(spark, sf):
    return markup.lines(t(spark, sf, "documents").select("doc_id", "text")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(o_orderkey % 160 < 79 AS BIGINT) AS short, CAST(1 AS BIGINT) AS paragraphs FROM orders""")
def short_paragraphs(spark, sf):
    """Paragraphs of 1 to 160 characters, one for each order; those of fewer than 80 are marked."""
    pages = t(spark, sf, "orders").select("o_orderkey", F.repeat(F.lit("x"), (F.col("o_orderkey") % 160 + 1).cast("int")).alias("text"))
    nodes = wikitext.parse_pages(pages, key="o_orderkey", columns=["class", "attrs"], cleaner=lambda tree_: clean.clean(tree_, [clean.mark_short_paragraphs])).where(F.col("class") == "Paragraph")
    return nodes.groupBy("doc_id").agg(F.count_if(F.map_contains_key("attrs", F.lit("short"))).alias("short"), F.count(F.lit(1)).alias("paragraphs"))


@query(r"""SELECT doc_id, count(*) AS n, sum(length(p)) AS characters FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE trim(p, ' ') <> '' GROUP BY 1""")
def paragraph_sizes(spark, sf):
    parts = t(spark, sf, "documents").select("doc_id", F.explode(markup.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("p"))
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("p")).alias("characters"))


# -- tables ----------------------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey AS table_id, max(w) AS columns FROM (SELECT l_orderkey, l_returnflag, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def column_counts(spark, sf):
    cells = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_returnflag").alias("row_no"), F.col("l_linenumber").cast("long").alias("colspan"))
    return layout.column_counts(cells)


@query("""SELECT table_id, r AS "row", c AS col, r <> row_no OR c <> 0 AS placeholder FROM (SELECT table_id, row_no, unnest(range(row_no, row_no + least(rowspan, rows_ - row_no + 1))) AS r, colspan FROM (
  SELECT c_nationkey AS table_id, c_custkey AS row_no, 1 + c_custkey % 3 AS colspan, 1 + c_custkey % 2 AS rowspan, max(c_custkey) OVER (PARTITION BY c_nationkey) AS rows_ FROM customer)) x, LATERAL (SELECT unnest(range(0, x.colspan)) AS c)""")
def span_grid(spark, sf):
    n = F.col("c_custkey")
    cells = t(spark, sf, "customer").select(F.col("c_nationkey").alias("table_id"), n.alias("row_no"), F.lit(0).alias("ord"), (1 + n % 3).alias("colspan"), (1 + n % 2).alias("rowspan"))
    return layout.span_grid(cells).select("table_id", "row", "col", "placeholder")


# -- templates and parsing -----------------------------------------------------------------------------------------------------
_TEMPLATES = [("Template:Price", "{{#ifexpr: {{{1}}} > 1500 | dear | cheap }}"), ("Template:Label", "{{ucfirst:{{{name|none}}}}} ({{price|{{{cost}}}}})<noinclude>docs</noinclude>")]


@query("""SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || CASE WHEN p_retailprice > 1500 THEN ' (dear)' ELSE ' (cheap)' END AS text FROM part""")
def template_expansion(spark, sf):
    call = F.concat(F.lit("{{label|name="), F.col("p_name"), F.lit("|cost="), F.col("p_retailprice").cast("string"), F.lit("}}"))
    pages = t(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), call.alias("rawtext"))
    out = templates.expand_pages(pages, spark.createDataFrame(_TEMPLATES, "name string, body string"))
    return out.select(F.col("page_id").cast("long").alias("p_partkey"), "text")


def _markup_nodes(spark, sf, columns: list[str] | None = None) -> DataFrame:
    row = F.concat(F.lit("== "), F.col("p_brand"), F.lit(" ==\n'''"), F.col("p_name"), F.lit("''' is a [["), F.col("p_type"), F.lit("|kind]].\n* one\n** two\n* three\n{|\n! a !! b\n|-\n| 1 || 2\n|}\n=== Sub ===\nlast <ref name=\"r\">note</ref>"))
    return wikitext.parse_pages(t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), row.alias("text")), columns=columns)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, v.class AS class, CAST(v.n AS BIGINT) AS n FROM part, (VALUES ('Article', 1), ('Section', 2), ('Strong', 1), ('ArticleLink', 1), ('ItemList', 2), ('Item', 3), ('Table', 1), ('Row', 2), ('Cell', 4), ('Reference', 1), ('Paragraph', 2)) v(class, n)""")
def parsed_classes(spark, sf):
    nodes = _markup_nodes(spark, sf).where(~F.col("class").isin("Text", "Node"))
    return nodes.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, v.ord AS ord, v.level AS level, CASE WHEN v.ord = 1 THEN p_brand ELSE 'Sub' END AS text FROM part, (VALUES (1, 2), (2, 3)) v(ord, level)""")
def contents(spark, sf):
    return layout.contents(_markup_nodes(spark, sf))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 0 AS violations, 2 AS deepest_list FROM part""")
def tree_relations(spark, sf):
    path = shared_folder(spark, "nodes")  # pages are parsed once, and joins see how large the tree tables are
    _markup_nodes(spark, sf, ["node_id", "parent", "post", "class"]).write.parquet(path)
    nodes = spark.read.schema("doc_id string, node_id int, parent int, post int, class string").parquet(path)
    bad = tree.violations(nodes).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("bad"))
    deep = tree.level(nodes.where(F.col("class") == "ItemList")).groupBy("doc_id").agg((F.max("same_above") + 1).cast("int").alias("deepest_list"))
    return deep.join(bad, "doc_id", "left").select("doc_id", F.coalesce("bad", F.lit(0)).alias("violations"), "deepest_list")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, upper(substr(p_type, 1, 1)) || substr(p_type, 2) AS target, 'kind' AS text FROM part""")
def display_texts(spark, sf):
    return tree.display_text(_markup_nodes(spark, sf)).select("doc_id", "target", "text")


# -- events (an extension: windows over a table or stream) -------------------------------------------------------------------------
@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf):
    from ..streaming import jobs

    return jobs.tumbling(t(spark, sf, "events")).withColumn("total", F.round("total", 4))
