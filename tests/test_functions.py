"""Expected values of the language's functions, on columns and in the template engine."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexloom.functions import expressions, styles, text, times, titles
from lexloom.operators import templates

EXPRESSIONS = [("pI", "3.141592653589793"), ("-2^4", "16"), ("ln 2.7182818284590451", "1"), ("abs 1-3", "-2"), ("abs(-5)", "5"), ("2e3", "2000"), ("7 mod -3", "-2"), ("2.5 round 0", "3"), ("-2.5 round 0", "-3"), ("10.0443 round -1", "10"), ("2^3^2", "64"), ("1=1.0", "1"), ("not 0", "1"), ("10 div 4", "2.5"), ("3 < 2 or 1", "1"), ("1.23e-7", "1.23E-7"), ("", "")]


@pytest.mark.parametrize("source,value", EXPRESSIONS)
def test_expressions(source, value):
    assert expressions.expr(source) == value


@pytest.mark.parametrize("source", ["1+Z", "1/0", "2 3", "(1", "1)", "abs", "()", "ln 0"])
def test_bad_expressions_are_marked(source):
    assert expressions.expr(source).startswith('<strong class="error">')


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_columns(spark):
    lit = F.lit
    assert one(spark, text.padleft(lit("7"), lit("5"), "ab"), text.padleft(lit("longer"), lit("3")), text.padleft(lit("7"), lit("x")), text.padright(lit("7"), lit("3"))) == ("abab7", "longer", "7", "700")
    assert one(spark, text.urlencode(lit("a b~*é")), text.anchorencode(lit("a b:é")), text.ucfirst(lit("éA b"))) == ("a+b~%2A%C3%A9", "a_b:.C3.A9", "ÉA b")
    t = lit("Help:Link/a/b")
    assert one(spark, *[text.titleparts(t, *a) for a in ((2,), (0,), (-1,), (1, -1), (2, 2), (1, 3))]) == ("Help:Link/a", "Help:Link/a/b", "Help:Link/a", "b", "a/b", "b")
    assert one(spark, text.rel2abs(lit("./x"), lit("a/b")), text.rel2abs(lit("../x"), lit("a/b")), text.rel2abs(lit("x/y"), lit("a")), text.rel2abs(lit("."), lit("a"))) == ("a/b/x", "a/x", "x/y", "a")
    assert one(spark, text.same(lit("+07"), lit("007")), text.same(lit("1d"), lit("1")), text.same(lit("1_0"), lit("10")), text.same(lit("a"), lit("A"))) == (True, False, True, False)
    assert one(spark, text.formatnum(lit("1234567")), text.formatnum(lit("1234.5")), text.formatnum(lit("x")), text.reverse_formatnum(lit("1,234"))) == ("1,234,567", "1,234.5", "x", "1234")
    assert one(spark, text.fs_escape(lit("a b/é~")), text.collection_id(lit("x"))) == ("a_b~47~~233~~~", one(spark, F.substring(F.sha2(lit("x"), 256), 1, 16))[0])
    got = one(spark, text.params(lit('a=1 B="x y" a=2 style="color:red"')), text.style(lit("Color: Red; width:1px; color:b")))
    assert got == ({"a": "2", "B": "x y", "style": "color:red"}, {"color": "b", "width": "1px"})
    for source, included, want in (("foo<includeonly>bar baz\n\n\nbla", False, "foo"), ("<noinclude sadf asdf asd>foo</noinclude>", True, ""), ("<noincludetypo>foo</noinclude>", True, "<noincludetypo>foo</noinclude>"), ("a<onlyinclude>b</onlyinclude>c", True, "b")):
        assert one(spark, text.preprocess(lit(source), included)) == (want,)
    assert one(spark, text.redact(F.array(lit("x"), lit("--password"), lit("p"), lit("--password"), lit("q")))) == (["x", "--password", "{OMITTED}", "--password", "{OMITTED}"],)


TITLES = [("de", "___user___:___schmir  __", 0, "Benutzer:Schmir"), ("de", "schmir", 10, "Vorlage:Schmir"), ("de", ":schmir", 10, "Schmir"), ("en", "image:x y", 0, "File:X y"), ("en", "no:thing", 0, "No:thing")]


@pytest.mark.parametrize("lang,title,ns,full", TITLES)
def test_titles(spark, lang, title, ns, full):
    assert one(spark, titles.full_name(F.lit(title), lang, ns)) == (full,)
    assert titles.plain_split(title, lang, ns)[2] == full


def test_redirects(spark):
    assert one(spark, titles.redirect_target(F.lit("#REDIRECT [[Data structure#Active data structures]]")), titles.redirect_target(F.lit(" #weiterleitung [[data structure|x]]"), "de"), titles.redirect_target(F.lit("text"))) == ("Data structure", "Data structure", None)


WHEN = dt.datetime(2008, 2, 9, 10, 55, 17)
TIMES = [("z", "39"), ("W", "06"), ("U", "1202554517"), ("xrY", "MMVIII"), ("g", "10"), ("D, d M Y", "Sat, 09 Feb 2008"), ("l jS", "Saturday 9S"), ('"Y" \\Y', "Y Y"), ("L t N w a A", "1 29 6 6 am AM"), ("r", "Sat, 09 Feb 2008 10:55:17 +0000"), ("c", "2008-02-09T10:55:17+00:00")]


@pytest.mark.parametrize("fmt,want", TIMES)
def test_times(spark, fmt, want):
    assert one(spark, times.format_time(fmt, F.lit("2008-02-09 10:55:17").cast("timestamp"))) == (want,)
    assert templates.strftime(fmt, WHEN) == want


def test_time_parsing(spark):
    clock = F.lit("2000-01-02 03:04:05").cast("timestamp")
    for s, want in (("09 Feb 2008 10:55:17", "2008-02-09 10:55"), ("1970-1-1 + 16 second", "1970-01-01 00:00"), ("1530", "2000-01-02 15:30"), ("nonsense", times.INVALID)):
        assert one(spark, times.time("Y-m-d H:i", F.lit(s), clock)) == (want,)


TEMPLATES = [
    ("{{#switch:||foo=good}}", "good", {}), ("{{ #switch: +07 | 7 = Yes | 007 = Bond | No }}", "Yes", {}), ("{{#switch: a| a | b |c=first|default}}", "first", {}), ("{{#switch:aaa|{{#if:1|aaa}}|b=fine}}", "fine", {}),
    ('{{ #ifeq: "+07" | "007" | 1 | 0 }}', "0", {}), ("{{LC:a=AB|CD}}", "a=ab", {}), ("{{t1|tnext}}", "text", {"t1": "{{{{{1}}}}}", "tnext": "text"}), ("{{ {{NZ}}expr: 1+1}}", "2", {"NZ": "#"}),
    ("<pre>A{{Pipe}}B</pre>", "<pre>A{{Pipe}}B</pre>", {"Pipe": "C"}), ("{{#iferror:{{#expr:1+Z}}|bad input|valid expression}}", "bad input", {}), ("foo\n{{#if: 1|#bar}}", "foo\n#bar", {}), ("{{#if: 1|#bar}}", "#bar", {}),
    ("foo {{tt}}", "foo \n{|", {"tt": "<noinclude></noinclude>{|"}), ("{{a}}", "{{{x}}}", {"a": "{{{x}}}"}), ("{{ibox2|birth_date=1960}}", "1960", {"ibox2": "{{{birth{{#if:{{{birthdate|}}}||_}}date}}}"}),
    ("abc<nowiki>{{x}}</nowiki>def", "abc{{x}}def", {}), ("foo\n<!-- bla -->\nbar", "foo\nbar", {}), ("{{loop}}", "", {"loop": "{{loop}}"}), ("{{missing}}", "", {}), ("{{PAGENAME}}", "Thispage", {}),
]


@pytest.mark.parametrize("source,want,db", TEMPLATES)
def test_templates(source, want, db):
    assert templates.expand(source, db) == want


def test_expansion_of_tables_by_broadcast_and_by_bundles(spark):
    spark.sparkContext.setCheckpointDir("/tmp/lexloom-test-checkpoints")
    pages = spark.createDataFrame([("1", "A", "{{a|x}} {{none}}"), ("2", "B", "{{ {{{q|b}}} }}"), ("3", "C", None)], "page_id string, title string, rawtext string")
    db = spark.createDataFrame([("Template:A", "[{{b|{{{1}}}}}]"), ("Template:B", "<{{{1|-}}}>")], "name string, body string")
    one_, two = (sorted((r.page_id, r.text) for r in templates.expand_pages(pages, db, broadcast_bytes=n).collect()) for n in (1 << 20, 0))
    assert one_ == two == [("1", "[<x>] "), ("2", "<->"), ("3", None)]


def test_styles(spark):
    c = [styles.colour(F.lit(s)) for s in ("rgb(255, 0,51)", "#00ff00", "#f00", "Navy", "nothing")]
    got = one(spark, *c)
    assert [tuple(round(v, 3) for v in x) if x else None for x in got] == [(1.0, 0.0, 0.2), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.502), None]
    assert one(spark, styles.points(F.lit("10px")), styles.points(F.lit("2em")), styles.points(F.lit("x")), styles.relative_font_size(F.lit("200%")), styles.relative_font_size(F.lit("xx-small"))) == (7.5, 19.2, 0.0, 2.0, 0.5)
