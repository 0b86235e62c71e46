"""Relations within node tables (pre-order numbers and intervals): navigation, projections, inheritance, structural rules.

All joins have the document as an equality key; the interval test is the residual condition, so that no cartesian product arises.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOC = "doc_id"


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, top, node_id): nodes below (and at) those of ``of`` (doc_id, node_id, post)."""
    top = of.select(DOC, F.col("node_id").alias("top"), F.col("post").alias("top_post"))
    return nodes.join(top, DOC).where((F.col("node_id") >= F.col("top")) & (F.col("node_id") <= F.col("top_post"))).drop("top_post")


def ancestors(nodes: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """(doc_id, node_id, ancestor, class, depth) of all proper ancestors."""
    up = nodes.select(DOC, F.col("node_id").alias("ancestor"), F.col("post").alias("up_post"), F.col("class").alias("ancestor_class"), F.col("depth").alias("ancestor_depth"))
    up = up if classes is None else up.where(F.col("ancestor_class").isin(classes))
    return nodes.select(DOC, "node_id").join(up, DOC).where((F.col("ancestor") < F.col("node_id")) & (F.col("node_id") <= F.col("up_post"))).drop("up_post")


def level(nodes: DataFrame) -> DataFrame:
    """How many ancestors of its own class a node has: of the intervals of its class that began before it, those that haven't ended; one pass over each document."""
    rest = [c for c in nodes.columns if c not in (DOC, "node_id")]
    node = F.struct(*nodes.columns)
    begin = F.struct((F.col("node_id") * 2).alias("at"), F.lit(1).alias("d"), node.alias("node"))
    end = F.struct((F.col("post") * 2 + 1).alias("at"), F.lit(-1).alias("d"), F.when(F.lit(False), node).alias("node"))
    both = nodes.where(F.col(DOC).isNotNull() & F.col("node_id").isNotNull()).select(DOC, "class", F.explode(F.array(begin, end)).alias("_e")).select(DOC, "class", "_e.*")
    before = Window.partitionBy(DOC, "class").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("same_above", F.coalesce(F.sum("d").over(before), F.lit(0))).where(F.col("d") == 1)
    return counted.select(*[F.col(f"node.{c}").alias(c) for c in (DOC, "node_id", *rest)], "same_above")


def siblings(nodes: DataFrame) -> DataFrame:
    """Adds previous and next sibling, and whether a node is the first or last of its parent's children."""
    w = Window.partitionBy(DOC, "parent").orderBy("ord")
    prev, after = F.lag("node_id").over(w), F.lead("node_id").over(w)
    has = F.col("parent").isNotNull()
    return nodes.select("*", F.when(has, prev).alias("previous"), F.when(has, after).alias("next"), (has & prev.isNull()).alias("is_first"), (has & after.isNull()).alias("is_last"))


def texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): captions of text nodes in order."""
    return nodes.where(F.col("class") == "Text").groupBy(DOC).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "caption"))), lambda x: x["caption"]), "").alias("text"))


def display_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) for links: the label's text, else the target's."""
    links = nodes.where(F.col("class").endswith("Link") | F.col("class").isin("NamedURL", "URL"))
    inner = descendants(nodes.where(F.col("class") == "Text").select(DOC, "node_id", "caption"), links).groupBy(DOC, "top").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "caption"))), lambda x: x["caption"]), "").alias("label"))
    return links.join(inner.withColumnRenamed("top", "node_id"), [DOC, "node_id"], "left").select(DOC, "node_id", "class", "target", F.coalesce("label", "target").alias("text"))


def nearest(nodes: DataFrame, value) -> DataFrame:
    """(doc_id, node_id, value): the value of the nearest node at or above each node that has one; one pass over each document."""

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node_id")
        ids, ends, own = (rows[c].to_pylist() for c in ("node_id", "post", "value"))
        stack, out = [], []
        for n, end, v in zip(ids, ends, own, strict=True):
            while stack and stack[-1][0] < n:
                stack.pop()
            v = v if v is not None else stack[-1][1] if stack else None
            stack.append((end, v))
            out.append(v)
        return pa.table({"doc_id": rows[DOC], "node_id": rows["node_id"], "value": pa.array(out, pa.string())})

    slim = nodes.select(F.col(DOC).cast("string").alias(DOC), F.col("node_id").cast("int").alias("node_id"), F.col("post").cast("int").alias("post"), value.cast("string").alias("value"))
    return slim.groupBy(DOC).applyInArrow(walk, "doc_id string, node_id int, value string").where(F.col("value").isNotNull())


def inherited(nodes: DataFrame, name: str) -> DataFrame:
    """(doc_id, node_id, value): the attribute of the nearest node at or above that has it."""
    return nearest(nodes, F.try_element_at("attrs", F.lit(name)))


def style_of(name: str):
    """One entry of a node's style attribute, null if there is none."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(F.coalesce(F.try_element_at("attrs", F.lit("style")), F.lit("")), rf"(?i)(?:^|;)\s*{name}\s*:\s*([^;]*)", 1))), F.lit(""))


def alignments(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, align, vertical): the nearest alignment at or above each node, none where there isn't any; a header cell without one is centred, one that isn't known is left."""
    boxed = F.when(F.col("class").isin("Div", "Cell", "Row"), F.lower(F.try_element_at("attrs", F.lit("align"))))
    own = F.nullif(F.coalesce(style_of("text-align"), boxed), F.lit("none"))
    own = F.when(F.col("class") == "Center", F.lit("center")).when(own.isin("left", "center", "right", "justify"), own).when(own.isNotNull(), F.lit("left"))
    up = F.coalesce(style_of("vertical-align"), F.lower(F.try_element_at("attrs", F.lit("valign"))))
    across = nearest(nodes, own).withColumnRenamed("value", "_a")
    down = nearest(nodes, F.when(up.isin("top", "middle", "bottom"), up)).withColumnRenamed("value", "vertical")
    base = F.when((F.col("class") == "Cell") & (F.col("tag") == "th"), F.lit("center")).otherwise(F.lit("none"))
    return nodes.select(DOC, "node_id", "class", base.alias("_b")).join(across, [DOC, "node_id"], "left").join(down, [DOC, "node_id"], "left").select(DOC, "node_id", "class", F.coalesce("_a", "_b").alias("align"), "vertical")


def directions(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, dir): rtl or ltr from the nearest node at or above that says so."""
    said = F.lower(F.trim(F.coalesce(F.try_element_at("attrs", F.lit("dir")), style_of("direction"))))
    return nodes.select(DOC, "node_id").join(nearest(nodes, F.when(said.isin("rtl", "ltr"), said)).withColumnRenamed("value", "dir"), [DOC, "node_id"], "left").withColumn("dir", F.coalesce("dir", F.lit("ltr")))


# -- changes of trees ------------------------------------------------------------------------------------------------------
def renumbered(nodes: DataFrame) -> DataFrame:
    """Trees with gaps in their numbers, numbered anew: node_id, parent, post and ord follow the order of the rows that are there."""
    w = Window.partitionBy(DOC).orderBy("node_id")
    new = nodes.withColumn("_new", F.row_number().over(w) - 1)
    last = new.select(DOC, F.col("node_id").alias("_at"), F.col("_new").alias("_last"))
    ends = new.groupBy(DOC).agg(F.array_sort(F.collect_list("node_id")).alias("_ids"))
    named = new.join(ends, DOC).withColumn("post", F.size(F.filter("_ids", lambda x: x <= F.col("post"))) - 1).drop("_ids")
    parents = last.select(DOC, F.col("_at").alias("parent"), F.col("_last").alias("_parent"))
    out = named.join(parents, [DOC, "parent"], "left")
    place = F.row_number().over(Window.partitionBy(DOC, "_parent").orderBy("_new")) - 1
    return out.withColumn("ord", place).drop("parent", "node_id").withColumnsRenamed({"_new": "node_id", "_parent": "parent"}).select(*nodes.columns)


def removed(nodes: DataFrame, which) -> DataFrame:
    """Trees without some nodes and all that is below them."""
    gone = nodes.where(which).groupBy(DOC).agg(F.collect_list(F.struct("node_id", "post")).alias("_gone"))
    inside = F.exists("_gone", lambda g: (g["node_id"] <= F.col("node_id")) & (F.col("node_id") <= g["post"]))
    return renumbered(nodes.join(gone, DOC, "left").where(~F.coalesce(inside, F.lit(False))).drop("_gone"))


def spliced(nodes: DataFrame, which) -> DataFrame:
    """Trees in which some nodes give way to their children."""
    out = nodes.select(DOC, F.col("node_id").alias("_id"), "parent", (which & F.col("parent").isNotNull()).alias("_out"))
    stay = nodes
    while True:  # ends: each turn lifts the parents of what is left by one removed node
        up = out.where("_out").select(DOC, F.col("_id").alias("parent"), F.col("parent").alias("_above"))
        lifted = stay.join(up, [DOC, "parent"], "left").withColumn("_hit", F.col("_above").isNotNull()).withColumn("parent", F.coalesce("_above", "parent")).drop("_above").checkpoint()
        stay = lifted.drop("_hit")
        if lifted.where("_hit").isEmpty():
            return renumbered(stay.join(out.where("_out").select(DOC, F.col("_id").alias("node_id")), [DOC, "node_id"], "left_anti").select(*nodes.columns))


def sections(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, level, caption, above): sections with the section that they lie in."""
    own = nodes.where(F.col("class") == "Section")
    up = ancestors(own, ["Section"]).groupBy(DOC, "node_id").agg(F.max("ancestor").alias("above"))
    return own.join(up, [DOC, "node_id"], "left").select(DOC, "node_id", "level", "caption", "above")


def violations(nodes: DataFrame) -> DataFrame:
    """Rows that break the encoding: an interval that leaves its parent's, or a second root.

    Nodes and their parents are as many, and what Spark takes a parsed table's size to be is far too small: they never meet by a broadcast."""
    up = nodes.select(DOC, F.col("node_id").alias("parent"), F.col("post").alias("up_post")).hint("merge")
    bad = nodes.join(up, [DOC, "parent"]).where((F.col("node_id") <= F.col("parent")) | (F.col("post") > F.col("up_post"))).select(DOC, "node_id", F.lit("interval").alias("rule"))
    roots = nodes.where(F.col("parent").isNull()).groupBy(DOC).agg(F.count(F.lit(1)).alias("n"), F.max("node_id").alias("node_id")).where(F.col("n") > 1).select(DOC, "node_id", F.lit("root").alias("rule"))
    return bad.unionByName(roots)


SCOPES = ("children", "descendants", "parent", "ancestors", "siblings")


def _scope(nodes: DataFrame, cls: str, scope: str) -> DataFrame:
    """(doc_id, node_id, other_class) of a class's nodes and the nodes in a scope; children, parents and siblings meet by the parent's number."""
    own = nodes.where(F.col("class") == cls).select(DOC, "node_id", "parent", "post")
    other = nodes.select(DOC, F.col("node_id").alias("o"), F.col("parent").alias("o_parent"), F.col("post").alias("o_post"), F.col("class").alias("other_class"))
    if scope == "children":
        j = own.join(other.withColumnRenamed("o_parent", "_k"), [own[DOC] == other[DOC], F.col("node_id") == F.col("_k")]).drop(other[DOC])
    elif scope == "parent":
        j = own.join(other.withColumnRenamed("o", "_k"), [own[DOC] == other[DOC], F.col("parent") == F.col("_k")]).drop(other[DOC])
    elif scope == "siblings":
        j = own.join(other, [own[DOC] == other[DOC], F.col("o_parent") == F.col("parent")]).drop(other[DOC]).where(F.col("o") != F.col("node_id"))
    elif scope == "descendants":
        j = own.join(other, DOC).where((F.col("o") > F.col("node_id")) & (F.col("o") <= F.col("post")))
    else:
        j = own.join(other, DOC).where((F.col("o") < F.col("node_id")) & (F.col("node_id") <= F.col("o_post")))
    return j.select(DOC, "node_id", "other_class")


def check(nodes: DataFrame, rules: list[tuple[str, str, str, list[str]]]) -> DataFrame:
    """(doc_id, node_id, rule) that break rules (class, scope, forbid | allow | require | equal, classes)."""
    out = None
    for cls, scope, kind, classes in rules:
        found = _scope(nodes, cls, scope).groupBy(DOC, "node_id").agg(F.collect_set("other_class").alias("s"))
        every = nodes.where(F.col("class") == cls).select(DOC, "node_id").join(found, [DOC, "node_id"], "left").withColumn("s", F.coalesce("s", F.array().cast("array<string>")))
        wanted = F.array(*[F.lit(c) for c in classes])
        bad = {
            "forbid": F.arrays_overlap("s", wanted), "allow": F.size(F.array_except("s", wanted)) > 0, "require": ~F.arrays_overlap("s", wanted),
            "equal": (F.size(F.array_except("s", wanted)) > 0) | (F.size(F.array_except(wanted, F.col("s"))) > 0),
        }[kind]
        part = every.where(bad).select(DOC, "node_id", F.lit(f"{cls} {scope} {kind} {','.join(classes)}").alias("rule"))
        out = part if out is None else out.unionByName(part)
    return out


#: Heights of nodes in points that don't follow from their text.
def heights(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, height): an estimate from below: text takes a line of 26 for each 40 characters, images their height or 200; references take none."""
    hidden = ancestors(nodes.where(F.col("class") == "Text"), ["Reference", "NamedURL"]).select(DOC, "node_id").distinct()
    size = F.when(F.col("class") == "Text", F.ceil(F.length("caption") / 40) * 26).when(F.col("class") == "ImageLink", F.coalesce(F.try_element_at("attrs", F.lit("height")).try_cast("int"), F.lit(200)))
    own = nodes.withColumn("h", F.coalesce(size, F.lit(0))).where(F.col("h") > 0).join(hidden, [DOC, "node_id"], "left_anti").select(DOC, "node_id", "h")
    summed = descendants(own, nodes).groupBy(DOC, "top").agg(F.sum("h").alias("height"))
    return nodes.select(DOC, "node_id", "class").join(summed.withColumnRenamed("top", "node_id"), [DOC, "node_id"], "left").withColumn("height", F.coalesce("height", F.lit(0)))


def weights(nodes: DataFrame) -> DataFrame:
    """(doc_id, class, weight): characters for texts, one for every other node."""
    w = F.when(F.col("class") == "Text", F.length("caption")).otherwise(F.lit(1))
    return nodes.groupBy(DOC, "class").agg(F.sum(w).alias("weight"))


def text_before(nodes: DataFrame, cls: str = "Table", limit: int = 200) -> DataFrame:
    """(doc_id, before, starts): characters of text before a document's first node of a class, and whether they are at most the limit."""
    first = nodes.where(F.col("class") == cls).groupBy(DOC).agg(F.min("node_id").alias("at"))
    length = nodes.where(F.col("class") == "Text").join(first, DOC).where(F.col("node_id") < F.col("at")).groupBy(DOC).agg(F.sum(F.length(F.trim("caption"))).alias("before"))
    return first.join(length, DOC, "left").select(DOC, F.coalesce("before", F.lit(0)).alias("before"), (F.coalesce("before", F.lit(0)) <= limit).alias("starts"))


def dump(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, line): an indented outline."""
    return nodes.select(DOC, "node_id", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("class"), F.when(F.col("caption") != "", F.concat(F.lit(" "), F.col("caption"))).otherwise(F.lit(""))).alias("line"))
