"""The relational operations behind a page store: lookups, redirects, histories, categories, licences, work lists, metabooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import styles, titles

# -- pages and redirects ---------------------------------------------------------------------------------------------


def newest(pages: DataFrame, title: str = "title", revision: str = "revid") -> DataFrame:
    """One row a title: rows without a revision number win, then the largest number."""
    w = Window.partitionBy(title).orderBy(F.col(revision).isNull().desc(), F.desc(revision))
    return pages.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def latest_revision(pages: DataFrame, title: str = "title", revision: str = "revid") -> DataFrame:
    return pages.groupBy(title).agg(F.max(revision).alias(revision))


def with_key(df: DataFrame, title: str = "title", lang: str = "en", default_ns: int = 0, name: str = "key") -> DataFrame:
    return df.withColumn(name, titles.full_name(title, lang, default_ns))


def resolve(requests: DataFrame, pages: DataFrame, redirects: DataFrame, title: str = "title") -> DataFrame:
    """Pages for requested titles: the redirect's target if there is one, else (or if it is missing) the title itself."""
    asked = requests.join(redirects.select(F.col("from_title").alias(title), "to_title"), title, "left").withColumn("resolved", F.coalesce("to_title", title)).drop("to_title")
    first = pages.select(F.col("title").alias("resolved"), *[F.col(c).alias(f"r_{c}") for c in pages.columns if c != "title"])
    second = pages.select(F.col("title").alias(title), *[F.col(c).alias(f"o_{c}") for c in pages.columns if c != "title"])
    out = asked.join(first, "resolved", "left").join(second, title, "left")
    return out.select(*requests.columns, "resolved", *[F.coalesce(f"r_{c}", f"o_{c}").alias(c if c not in requests.columns else f"page_{c}") for c in pages.columns if c != "title"])


def redirect_chains(redirects: DataFrame) -> DataFrame:
    """(from_title, to_title) with chains followed to their ends. Steps double, so that they end after the logarithm of the longest chain; a title on or
    before a cycle, which has no end, is led to the cycle's smallest title."""
    now = redirects.select("from_title", "to_title").dropDuplicates(["from_title"]).withColumn("least", F.col("to_title")).checkpoint()
    for _ in range(max(1, now.count().bit_length())):
        step = now.select(F.col("from_title").alias("to_title"), F.col("to_title").alias("further"), F.col("least").alias("lower"))
        now = now.join(step, "to_title", "left").select("from_title", F.coalesce("further", "to_title").alias("to_title"), F.least("least", "lower").alias("least"), F.col("further").isNotNull().alias("on")).checkpoint()
        if now.where("on").isEmpty():
            return now.select("from_title", "to_title")
    # what still goes on after as many steps as there are redirects goes round; a whole turn from there has met all of its titles
    ends = now.where("on").select(F.col("from_title").alias("to_title"), F.col("least").alias("round"))
    return now.join(ends, "to_title", "left").select("from_title", F.coalesce("round", "to_title").alias("to_title"))


def excluded(pages: DataFrame, titles_: DataFrame) -> DataFrame:
    """Pages outside the main namespace whose titles are excluded keep their rows but lose their text."""
    flags = titles_.select(F.col("title"), F.lit(True).alias("_out")).distinct()
    text = F.when(F.coalesce("_out", F.lit(False)) & (F.col("ns") != 0), F.lit("")).otherwise(F.col("rawtext"))
    return pages.join(flags, "title", "left").withColumn("rawtext", text).drop("_out")


def select_titles(pages: DataFrame, start: str, end: str, title: str = "title") -> DataFrame:
    return pages.where(F.col(title).between(start, end)).select(title).distinct().orderBy(title)


def articles(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("ns") == 0).select("title").distinct().orderBy("title")


def page_range(index: str, first: int, last: int, spark) -> DataFrame:
    """Titles ``index/first`` to ``index/last``."""
    return spark.range(first, last + 1).select(F.concat(F.lit(index + "/"), F.col("id").cast("string")).alias("title"))


# -- histories -------------------------------------------------------------------------------------------------------
#: What counts as an address of an anonymous editor.
IP4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
IP6 = r"(?i)^(?=.*:)(?:[\da-f]{0,4}:){2,7}[\da-f]{0,4}$"


def is_bot(user, comment=None):
    test = F.coalesce(user.rlike("(?i)bot$"), F.lit(False))
    return test if comment is None else test | F.coalesce(comment.rlike("(?i)bot$"), F.lit(False))


def authors(edits: DataFrame, title: str = "title") -> DataFrame:
    """(title, authors): sorted names that are no bots, with ANONIPEDITS:n behind if there is anyone. An anonymous edit has the flag, and an address or no
    name; edits without a name otherwise don't count."""
    user = F.col("user")
    blank = user.isNull() | (user == "")
    anon = F.coalesce(F.col("anon"), F.lit(False)) & (blank | user.rlike(IP4) | user.rlike(IP6))
    named = ~anon & ~blank & ~is_bot(user, F.col("comment"))
    out = edits.groupBy(title).agg(F.array_sort(F.collect_set(F.when(named, user))).alias("names"), F.count_if(anon).alias("anonymous"))
    tail = F.array(F.concat(F.lit("ANONIPEDITS:"), F.col("anonymous").cast("string")))
    return out.select(title, F.when((F.size("names") > 0) | (F.col("anonymous") > 0), F.concat("names", tail)).otherwise(F.array().cast("array<string>")).alias("authors"))


def contributors(rows: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(title, names, anonymous) of (title, name, anoncontributors): anonymous counts are summed, names ending in bot are left out, redirected titles
    are counted with their targets."""
    if redirects is not None:
        rows = rows.join(redirects.select(F.col("from_title").alias("title"), "to_title"), "title", "left").withColumn("title", F.coalesce("to_title", "title")).drop("to_title")
    return rows.groupBy("title").agg(F.array_sort(F.collect_set(F.when(~is_bot(F.col("name")), F.col("name")))).alias("names"), F.coalesce(F.sum("anoncontributors"), F.lit(0)).alias("anonymous"))


def edits_until(edits: DataFrame, marks: DataFrame) -> DataFrame:
    """Edits up to a given revision of each title (title, revid)."""
    return edits.join(marks.select("title", F.col("revid").alias("_until")), "title").where(F.col("revid") <= F.col("_until")).drop("_until")


def trusted_revision(revisions: DataFrame, least: float = 0.8, max_age_days: float = 365.0) -> DataFrame:
    """Per title the newest revision whose score is above the threshold, else the best of those that aren't too old."""
    young = revisions.where(F.col("age_days") <= max_age_days)
    return young.groupBy("title").agg(F.coalesce(F.max(F.when(F.col("score") > least, F.col("revid"))), F.max_by("revid", F.struct("score", "revid"))).alias("revid"))


# -- resources ---------------------------------------------------------------------------------------------------------


def category_rows(rows: DataFrame, category: str = "category", title: str = "title") -> DataFrame:
    """(category, n, title): members in order, a row each, for categories of any size."""
    w = Window.partitionBy(category).orderBy(title)
    return rows.select(category, F.row_number().over(w).alias("n"), title)


def category_members(rows: DataFrame, category: str = "category", title: str = "title") -> DataFrame:
    """The same with all members in one row, for categories that are known to be small."""
    return rows.groupBy(category).agg(F.array_sort(F.collect_list(title)).alias("members"))


def used(rows: DataFrame, *columns: str) -> dict[str, DataFrame]:
    """Distinct entries of array columns, each as a table."""
    return {c: rows.select(F.explode(c).alias(c)).distinct() for c in columns}


def split_requests(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(titles, revids): an entry with a revision counts among the revisions only."""
    return items.where(F.col("revision").isNull()).select("title").distinct().orderBy("title"), items.where(F.col("revision").isNotNull()).select("revision").distinct().orderBy("revision")


def unscheduled(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that isn't scheduled yet, once each."""
    return work.dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")


def missing(requested: DataFrame, seen: DataFrame, redirects: DataFrame) -> DataFrame:
    """Requested titles that were seen neither themselves nor under their redirect's target."""
    asked = requested.join(redirects.select(F.col("from_title").alias("title"), "to_title"), "title", "left").withColumn("target", F.coalesce("to_title", "title"))
    return asked.join(seen.select(F.col("title").alias("target")).distinct(), "target", "left_anti").select("title")


def fixpoint(start: DataFrame, step, key: str, rounds: int = 10_000) -> DataFrame:
    """Rows reached from a start: ``step`` gives further rows for new ones; rows already reached are left out; written each round. A step that still
    finds new rows after so many rounds is an error, not a shorter result."""
    found = fresh = start.dropDuplicates([key]).checkpoint()
    for _ in range(rounds):
        fresh = unscheduled(step(fresh), found, key).checkpoint()
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
    raise RuntimeError(f"new rows after {rounds} rounds")


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Arrays are put together, of other columns the left value counts."""
    kinds = dict(left.dtypes)
    both = left.join(right.select(key, *[F.col(c).alias(f"_{c}") for c in right.columns if c != key]), key, "full")
    pick = lambda c: F.concat(F.coalesce(c, F.array().cast(kinds[c])), F.coalesce(f"_{c}", F.array().cast(kinds[c]))) if kinds[c].startswith("array") else F.coalesce(c, f"_{c}")
    return both.select(key, *[(pick(c) if c in right.columns else F.col(c)).alias(c) for c in left.columns if c != key])


def blocks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Numbers rows in blocks of a size, in an order: rows are dealt by ranges, numbered within them, and moved on by the rows of the ranges before (one number a partition)."""
    dealt = rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()).checkpoint()
    own = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    before, starts = 0, []
    for r in sorted(dealt.groupBy("_p").count().collect()):
        starts.append((r["_p"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "_p int, _start long")
    return dealt.withColumn("_own", own).join(offsets, "_p").withColumn("block", F.floor((F.col("_own") + F.col("_start")) / size)).drop("_p", "_own", "_start")


def by_path(rows: DataFrame, url: str = "descriptionurl") -> DataFrame:
    """(path, titles): titles under the parent path of their description's URL."""
    return rows.groupBy(F.regexp_replace(url, "/[^/]*$", "").alias("path")).agg(F.array_sort(F.collect_set("title")).alias("titles"))


# -- licences ----------------------------------------------------------------------------------------------------------


def license_gate(image_licenses: DataFrame, licenses: DataFrame, filter_type: str = "blacklist") -> DataFrame:
    """(image, licence, shown): decided by an image's first free or nonfree licence."""
    known = licenses.select(F.lower("name").alias("template"), styles.license_class("license_class").alias("kind"), "display_name")
    rows = image_licenses.withColumn("template", F.lower("template")).join(known, "template", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    relevant = F.col("kind").isin("free", "nonfree")
    first = rows.groupBy("image").agg(F.min_by("kind", F.when(relevant, F.col("ord"))).alias("kind"), F.min_by("display_name", F.when(relevant, F.col("ord"))).alias("display_name"))
    return first.select("image", F.coalesce(F.when(F.col("kind").isin("free", "nonfree"), F.col("display_name")), F.lit("")).alias("licence"), styles.license_decision("kind", filter_type).alias("shown"))


def free_ratio(decisions: DataFrame, url: str = "url") -> DataFrame:
    """Share of distinct addresses that are shown; 1 if there are none."""
    once = decisions.groupBy(url).agg(F.max("shown").alias("shown"))
    return once.agg(F.coalesce(F.try_divide(F.count_if("shown"), F.count(F.lit(1))), F.lit(1.0)).alias("ratio"))


def unknown_licenses(image_licenses: DataFrame, licenses: DataFrame) -> DataFrame:
    """(template, images, sample): licences that the list doesn't know, most used first, with five images each."""
    known = licenses.select(F.lower("name").alias("template"))
    rows = image_licenses.withColumn("template", F.lower("template")).join(known, "template", "left_anti")
    return rows.groupBy("template").agg(F.count_distinct("image").alias("images"), F.slice(F.array_sort(F.collect_set("image")), 1, 5).alias("sample")).orderBy(F.desc("images"), "template")


# -- collections -------------------------------------------------------------------------------------------------------


def metabook_items(books: DataFrame) -> DataFrame:
    """Chapters and articles of nested collections in reading order (pre-order), with the number of the chapter."""
    outer = books.select(F.col("title").alias("book"), F.posexplode_outer("items").alias("i", "item"))
    inner = outer.select("book", "i", F.lower("item.type").alias("type"), "item.title", "item.displaytitle", "item.revision", F.posexplode_outer("item.items").alias("j", "sub"))
    heads = outer.select("book", "i", F.lit(-1).alias("j"), F.lower("item.type").alias("type"), "item.title", "item.displaytitle", "item.revision")
    subs = inner.where(F.col("sub").isNotNull()).select("book", "i", "j", F.lower("sub.type").alias("type"), "sub.title", "sub.displaytitle", "sub.revision")
    rows = heads.unionByName(subs).where(F.col("type").isNotNull())
    order = Window.partitionBy("book").orderBy("i", "j")
    return rows.withColumn("item_no", F.row_number().over(order)).withColumn("chapter_no", F.sum(F.when(F.col("type") == "chapter", 1).otherwise(0)).over(order)).drop("i", "j")


def in_book(links: DataFrame, articles_: DataFrame, base: str = "") -> DataFrame:
    """Links whose target is an article of the book; both sides are compared by md5 of address and title."""
    own = articles_.select(F.md5(F.concat(F.lit(base), "title").cast("binary")).alias("article_id")).distinct()
    return links.withColumn("article_id", F.md5(F.concat(F.lit(base), "target").cast("binary"))).join(own, "article_id", "left_semi")


def image_contributors(images: DataFrame) -> DataFrame:
    """(image, names): the information template's author, else user links of its arguments, else of the page; the first source that has any."""
    return images.select("image", F.coalesce(*[F.when(F.size(c) > 0, F.array_sort(F.array_distinct(c))) for c in ("author_arg", "arg_users", "page_users")], F.array().cast("array<string>")).alias("names"))


# -- windows -----------------------------------------------------------------------------------------------------------


def reference_numbers(refs: DataFrame) -> DataFrame:
    """Numbers references (doc_id, pos, name) in order of first use; a repeated name keeps its number."""
    named = F.coalesce(F.concat(F.lit("n"), "name"), F.concat(F.lit("p"), F.col("pos").cast("string")))
    keyed = refs.withColumn("_key", named)
    first = keyed.withColumn("_first", F.min("pos").over(Window.partitionBy("doc_id", "_key")))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_first"))).drop("_key", "_first")


def running_max(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Progress that only grows."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("progress", F.max(value).over(w))


def rate(rows: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """How many rows lie in the trailing seconds."""
    w = Window.partitionBy(by).orderBy(F.unix_timestamp(ts)).rangeBetween(-(seconds - 1), 0)
    return rows.withColumn("calls", F.count(F.lit(1)).over(w))


def fall_through(cases: DataFrame) -> DataFrame:
    """(switch_id, pos, key, value): a key without a value takes the next one."""
    w = Window.partitionBy("switch_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    return cases.withColumn("value", F.first("value", ignorenulls=True).over(w))


def runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Gaps and islands: (by, run, value, first, last, n) of neighbouring equal values."""
    w = Window.partitionBy(by).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    numbered = rows.withColumn("_c", F.when(F.row_number().over(w) == 1, 1).otherwise(changed)).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def type_sorted(rows: DataFrame, value: str) -> DataFrame:
    """Numbers before texts, each in their own order."""
    number = F.col(value).try_cast("double")
    return rows.orderBy(number.isNull(), number, value)
