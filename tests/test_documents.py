"""Parsing, cleaning, tree relations, stores and the job queue."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom.operators import clean, layout, relational, resources, templates, tree, wikitext
from lexloom.plans.lifecycle import node_table
from lexloom.sources import stores
from lexloom.streaming import jobs


def classes(source):
    return [n.cls for n in wikitext.parse(source).walk()]


def test_parser_structures():
    root = wikitext.parse("== A ==\n'''''x''''' ''y'' [[Foo|bar [[x]]]] [http://a b]\n=== B ===\n* 1\n** 2\n# 3\n;t:d\n")
    assert [(s.caption, s.level) for s in root.find("Section")] == [("A", 2), ("B", 3)]
    assert root.find("Strong")[0].children[0].cls == "Emphasized" and len(root.find("Emphasized")) == 2
    assert len(root.find("ItemList")) == 3 and root.find("DefinitionTerm")[0].text() == "t" and root.find("NamedURL")[0].text() == "b"
    table = wikitext.parse('{| class="wikitable"\n|+ cap\n! h !! i\n|-\n| a || colspan="2" | b\n{|\n| in\n|}\n|}').find("Table")
    assert len(table) == 2 and table[0].find("TableCaption")[0].text() == "cap" and table[0].find("Cell")[3].attrs == {"colspan": "2"}
    assert [n.cls for n in wikitext.parse("[[File:a.png|thumb|100x50px|cap]] [[Category:x]] [[:Category:x]] [[fr:y]]").walk() if n.cls.endswith("Link")] == ["ImageLink", "CategoryLink", "SpecialLink", "LangLink"]
    assert wikitext.parse("a [[b").text() == "a [[b" and "PreFormatted" in classes(" x\n y") and "HorizontalRule" in classes("----")
    assert [e[0] for e in wikitext.image_map("Image:x\n# no\n\nrect 1 2 3 4 [[a]]\ndefault [[b]]")] == ["rect", "default"]


def test_quote_runs_are_quick():
    assert wikitext.bold_italic([2] + [3] * 24 + [2])


def test_cleaner_steps():
    root = clean.clean(wikitext.parse("x<ref name=q>full</ref> y<ref name=q/>\n\n== Empty ==\n\n== See also ==\n[[z]]\n[[Category:C]]\n<div class=\"noprint\">no</div>"))
    assert [r.text() for r in root.find("Reference")] == ["full", "full"] and not root.find("Section") and not root.find("CategoryLink") and "no" not in root.text().split()
    lists = clean.clean(wikitext.parse("{|\n|-\n|\n* 1\n* 2\n* 3\n* 4\n* 5\n* 6\n* 7\n|}"))
    assert len(lists.find("Row")) == 7
    wide = clean.clean(wikitext.parse('{|\n|-\n| colspan="9" | a\n|-\n| b || c\n|}'))
    assert wide.find("Cell")[0].attrs["colspan"] == "2"
    assert len(clean.STEPS) >= 55 and "failed" not in root.attrs


def test_node_tables(spark):
    pages = spark.createDataFrame([("1", "A", "== S ==\n* {{x}}\n** b\ntext [[t]]"), ("2", "B", None)], "page_id string, title string, rawtext string")
    nodes = node_table(pages, spark.createDataFrame([("Template:X", "from template")], "name string, body string")).cache()
    assert tree.violations(nodes).isEmpty()
    assert "from template" in {r.doc_id: r.text for r in tree.texts(nodes).collect()}["1"]
    assert {(r["class"], r.same_above) for r in tree.level(nodes).where("class = 'ItemList'").collect()} == {("ItemList", 0), ("ItemList", 1)}
    assert tree.check(nodes, [("ItemList", "children", "allow", ["Item"]), ("Item", "parent", "require", ["ItemList"])]).isEmpty()
    assert not tree.check(nodes, [("Item", "descendants", "forbid", ["ItemList"])]).isEmpty()
    assert tree.ancestors(nodes, ["Section"]).where("doc_id = '1'").count() > 3
    assert "<li>" in layout.inline_markup(nodes).where("doc_id = '1'").first().markup
    assert [r.text for r in layout.contents(nodes).collect()] == ["S"]


EDITS = [("CosmicPenguin", False), ("Denelson83", False), ("SmackBot", False), ("127.0.0.1", True), ("Qyd", False), ("", False), ("Qyd", False), ("::1", True)]


def test_authors(spark):
    df = spark.createDataFrame([("t", u, a, "") for u, a in EDITS] + [("bots", "XBot", False, "")], "title string, user string, anon boolean, comment string")
    assert {r.title: r.authors for r in relational.authors(df).collect()} == {"t": ["CosmicPenguin", "Denelson83", "Qyd", "ANONIPEDITS:2"], "bots": []}


def test_relations(spark):
    spark.sparkContext.setCheckpointDir("/tmp/lexloom-test-checkpoints")
    chains = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "x")], "from_title string, to_title string")
    assert {r.from_title: r.to_title for r in relational.redirect_chains(chains).collect()}["a"] == "d"
    pages = spark.createDataFrame([("p", 1), ("p", None), ("q", 3), ("q", 9)], "title string, revid long")
    assert {(r.title, r.revid) for r in relational.newest(pages).collect()} == {("p", None), ("q", 9)}
    start = spark.createDataFrame([(1,)], "k int")
    assert relational.fixpoint(start, lambda d: d.select((F.col("k") * 2 % 11).alias("k")), "k").count() == 10
    runs = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "g int, o int, v string")
    assert sorted((r.first, r.last) for r in relational.runs(runs, "g", "o", "v").collect()) == [(1, 2), (3, 4), (5, 5)]


def test_stores(spark, tmp_path):
    (tmp_path / "revisions-1.txt").write_text('\n --page-- {"ns": 0, "title": "A", "revid": 5}\ntext\nmore\n --page-- {"ns": 10, "title": "T", "expanded": 1}\n')
    (tmp_path / "redirects.json").write_text('{"B": "A"}')
    tables = stores.open_snapshot(spark, str(tmp_path))
    assert sorted((r.title, r.revid, r.expanded, r.rawtext) for r in tables["pages"].collect()) == [("A", 5, False, "text\nmore"), ("T", None, True, "")]
    assert tables["redirects"].collect()[0].to_title == "A"
    stores.write_revisions(tables["pages"].drop("wiki_id"), str(tmp_path / "out"))
    assert sorted((r.title, r.rawtext) for r in stores.read_revision_folder(spark, str(tmp_path / "out")).collect()) == [("A", "text\nmore"), ("T", "")]
    (tmp_path / "dump.xml").write_text("<mediawiki><page><title>X</title><id>1</id><revision><id>1</id><text>old</text></revision><revision><id>2</id><text>new</text></revision></page><page><title>Y</title><id>2</id><revision><id>3</id><text>#REDIRECT [[X]]</text></revision></page></mediawiki>")
    assert [(r.title, r.revid, r.text) for r in stores.read_dump(spark, str(tmp_path / "dump.xml"), True).collect()] == [("X", 2, "new")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok/f.txt", "hi")
    assert stores.read_zip(spark, str(tmp_path / "a.zip")).first().content == b"hi"
    assert not stores.safe_member("../x") and not stores.safe_member("/x") and stores.safe_member("a/../b")
    with sqlite3.connect(tmp_path / "k.db") as db:
        db.execute("CREATE TABLE unnamed (key TEXT, value TEXT)")
        db.execute("INSERT INTO unnamed VALUES ('a', '[1]')")
    assert tuple(stores.read_sqlite(spark, str(tmp_path / "k.db")).first())[1:] == ("a", "[1]")
    answers = [{"query": {"pages": {"1": {"title": "P", "revisions": [{"revid": 1, "user": "U", "anon": ""}]}}}, "continue": {"c": 1}}, {"query": {}}]
    (tmp_path / "api").mkdir()
    (tmp_path / "api" / "s.json").write_text(json.dumps(answers))
    stores.register_api_source(spark)
    assert spark.read.format("pagedapi").option("folder", str(tmp_path / "api")).load().count() == 2
    (tmp_path / "r.json").write_text("﻿" + json.dumps(answers[0]))
    assert [(r.user, r.anon) for r in stores.response_edits(stores.read_responses(spark, str(tmp_path / "r.json"))).collect()] == [("U", True)]


def test_collection_pages(spark):
    book = "==Title==\n===Sub===\n;Chapter\n:[[A|shown]]\n:[{{fullurl:B|oldid=12}} old]\n{{t}}\nsummary"
    got = stores.parse_collection_pages(spark.createDataFrame([(1, book)], "doc_id int, text string")).orderBy("line_no").collect()
    assert [(r.type, r.title, r.displaytitle, r.revision, r.chapter_no) for r in got] == [("title", "Title", None, None, 0), ("subtitle", "Sub", None, None, 0), ("chapter", "Chapter", None, None, 1), ("article", "A", "shown", None, 1), ("oldarticle", "B", "old", "12", 1), ("template", "t", None, None, 1), ("summary", "summary", None, None, 1)]


def event(op, at, **more):
    return {"op": op, "event_time": at, **more}


@pytest.mark.parametrize("events,until,state", [
    ([event("push", 0)], 119, "waiting"), ([event("push", 0)], 121, "timeout"), ([event("push", 0), event("pop", 1), event("finish", 2)], 3, "success"), ([event("push", 0), event("finish", 2, error="x")], 11, "error"),
    ([event("push", 0), event("finish", 2, error="x")], 13, "gone"), ([event("push", 0), event("kill", 1), event("push", 2)], 3, "waiting"), ([event("push", 0), event("finish", 1), event("push", 2)], 3, "success"), ([event("push", 0, timeout_s=5.0), event("finish", 9)], 9.5, "timeout"),
])
def test_job_machine(events, until, state):
    job = jobs.Job("j")
    for e in events:
        jobs.step(job, e)
    jobs.advance(job, until)
    assert job.state == state


def test_hash_of_all_registered_queries_have_oracles():
    import __spark_entry__ as entry

    assert len(entry.queries()) >= 45 and set(entry.oracle_sql()) <= set(entry.queries())


def test_apostrophes():
    """Runs of apostrophes: how many stay text and what the rest does, by the least sum over all readings."""
    assert wikitext.bold_italic([2, 2]) == [(0, "i"), (0, "i")] and wikitext.bold_italic([5, 2, 3]) == [(0, "bi"), (0, "i"), (0, "b")]
    assert wikitext.bold_italic([3, 2]) == [(1, "i"), (0, "i")] and wikitext.bold_italic([2, 3]) == [(0, "i"), (1, "i")]
    assert wikitext.bold_italic([3, 4]) == [(0, "b"), (1, "b")] and wikitext.bold_italic([19, 6]) == [(14, "bi"), (1, "bi")]
    assert len(wikitext.bold_italic([2, *[3] * 2000, 2])) == 2002


def test_pages_that_nest_without_end():
    for text in ("<i>" * 3000 + "x", "[[" * 5000 + "x", "*" * 3000 + " x", "{|\n|" * 60 + "x", "<div>" * 3000 + "x" + "</div>" * 3000, "'''''" * 3000 + "x"):
        tree_ = clean.clean(wikitext.parsed(text))
        assert "x" in tree_.text() and len(wikitext.numbered(tree_)) >= 2
    assert wikitext.parsed("ab").text() == "ab"
    broken = wikitext.parsed("text", cleaner=lambda tree_: [][0])
    assert broken.text() == "text" and broken.attrs["failed"].startswith("IndexError")


def test_dates_past_the_calendar():
    assert templates.expand("{{#time:Y-m-d|2008-01-31 + 1 month}}") == "2008-02-29" and templates.expand("{{#time:Y-m-d|2007-12-31 + 2 month}}") == "2008-02-29"
    assert "invalid time" in templates.expand("{{#time:Y|2008-01-31 + 9999999 day}}") and "invalid time" in templates.expand("{{#time:Y|2008-01-31 + 99999999999999 year}}")
    assert len(templates.expand("{{padleft:a|99999999999|b}}")) == 256 * 1024


def test_trees_change(spark):
    nodes = wikitext.parse_pages(spark.createDataFrame([("1", "== A ==\n* one\n* two\n\ntext"), ("2", "plain")], "doc_id string, text string"))
    less = tree.removed(nodes, F.col("class") == "ItemList")
    assert tree.violations(less).count() == 0 and less.where("class = 'Item'").count() == 0
    assert [r.node_id for r in less.where("doc_id = '1'").orderBy("node_id").collect()] == list(range(less.where("doc_id = '1'").count()))
    flat = tree.spliced(nodes, F.col("class").isin("Section", "ItemList"))
    assert tree.violations(flat).count() == 0 and flat.where("class = 'Item' AND parent = 0").count() == 2
    assert tree.level(nodes).count() == nodes.count()


def test_settings():
    found = resources.Settings.read("[fetch]\nlimit = 5\nfast = yes\n", {"WIKI_FETCH_LIMIT": "7", "OTHER_FETCH_LIMIT": "9"}, "WIKI")
    assert found.get("fetch", "limit", kind=int) == 7 and found.get("fetch", "fast", kind=bool) is True and found.get("x", "y", 3) == 3
    assert resources.BuildOptions(output="o", metabook="m").check().image_size == 1280
    for bad in (resources.BuildOptions(output="o"), resources.BuildOptions(output="o", post_url="p", metabook="m"), resources.BuildOptions(output="o", pages=("a",), image_size=0)):
        with pytest.raises(ValueError):
            bad.check()
