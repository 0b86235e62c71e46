"""Macro templates: parsing of braces, lazy evaluation, and expansion of whole tables of pages.

A page is parsed into a sequence of texts, variables and calls and evaluated from the outside in: only the branch that is taken and the
arguments that are read get evaluated. Everything that varies (clock, site, language) is a parameter.

:func:`expand_pages` brings templates to pages in one of two ways. While all templates together are small (a checked bound) they are
broadcast. Beyond it, the names that a page needs, directly or through other templates, are found by joins, and each page gets
a bundle of just these; names that only come up during evaluation are reported back and joined in another round.
"""

from __future__ import annotations

import calendar
import datetime as dt
import html
import re
import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import titles
from ..functions.expressions import expr, roman, truth
from ..functions.text import WIDEST
from ..session import dealt

RECURSION, LONGEST = 100, 256 * 1024
#: Templates are broadcast up to this many bytes in all.
BROADCAST_BYTES = 32 << 20
#: Tags whose inside isn't template text.
OPAQUE = ["nowiki", "math", "imagemap", "gallery", "source", "syntaxhighlight", "pre", "ref", "timeline", "poem", "pages", "hiero", "inputbox"]


# -- opaque tags ---------------------------------------------------------------------------------------------------
_TAGS = re.compile(r"(?P<comment>(?P<before>\n[ ]*)?<!--.*?-->(?P<after>[ ]*\n)?)|<(?P<name>" + "|".join(OPAQUE) + r")(?P<attrs>\s[^<>]*?)?(?:/>|(?<!/)>(?P<inner>.*?)</(?P=name)\s*>)", re.S | re.I)
_MARK = re.compile("\x7fTAG-(\\d+)\x7f")


@dataclass
class Tags:
    """Tags taken out of a text, under numbers in order of appearance."""

    found: list[dict] = field(default_factory=list)

    def take(self, text: str) -> str:
        def one(m: re.Match) -> str:
            if m["name"] is None:
                before, after = m["before"] or "", m["after"] or ""
                return "\n" if before and after else before + after
            name, inner = m["name"].lower(), m["inner"] or ""
            self.found.append({"tag": name, "attrs": (m["attrs"] or "").strip(), "inner": inner, "complete": inner if name == "nowiki" else m[0]})
            return f"\x7fTAG-{len(self.found) - 1}\x7f"

        return _TAGS.sub(one, text)

    def restore(self, text: str) -> str:
        return _MARK.sub(lambda m: self.found[int(m[1])]["complete"] if int(m[1]) < len(self.found) else m[0], text)


def include_filter(text: str, included: bool) -> str:
    if included:
        text = re.sub(r"(?is)<noinclude(?:\s[^<>]*)?>.*?(</noinclude>|\Z)", "", text)
        if "<onlyinclude>" in text:
            text = "".join(re.findall(r"(?is)<onlyinclude>(.*?)</onlyinclude>", text))
        return re.sub(r"(?i)</?includeonly(?:\s[^<>]*)?>", "", text)
    text = re.sub(r"(?is)<includeonly(?:\s[^<>]*)?>.*?(?:</includeonly>|\Z)", "", text)
    return re.sub(r"(?i)</?(onlyinclude|noinclude)(?:\s[^<>]*)?>", "", text)


# -- parsing -------------------------------------------------------------------------------------------------------
class _Equals:
    """Separates an argument's name from its value."""


EQUALS = _Equals()


@dataclass
class Variable:
    parts: list[list]


@dataclass
class Call:
    parts: list[list]


@dataclass
class _Open:
    count: int
    parts: list[list] = field(default_factory=lambda: [[]])
    links: int = 0
    named: bool = False

    def text(self) -> list:
        out: list = ["{" * self.count]
        for i, part in enumerate(self.parts):
            out += (["|"] if i else []) + ["=" if x is EQUALS else x for x in part]
        return out


_PIECE = re.compile(r"\{{2,}|\}{2,}|\[\[|\]\]|[|=]|[^{}\[\]|=]+|.", re.S)


def parse(text: str) -> list:
    """A sequence of texts, Variables and Calls. Runs of braces are matched from the inside: three and three make a variable, two and two a call."""
    root: list = []
    stack: list[_Open] = []

    def here() -> list:
        return stack[-1].parts[-1] if stack else root

    for token in _PIECE.findall(text):
        top = stack[-1] if stack else None
        if token.startswith("{{"):
            stack.append(_Open(len(token)))
        elif token.startswith("}}"):
            left = len(token)
            while left >= 2 and stack and stack[-1].count >= 2:
                top = stack[-1]
                size = 3 if min(top.count, left) >= 3 else 2
                node = (Variable if size == 3 else Call)(top.parts)
                left -= size
                top.count -= size
                if top.count >= 2:
                    top.parts, top.links, top.named = [[node]], 0, False
                else:
                    stack.pop()
                    here().extend(["{"] * top.count + [node])
            if left:
                here().append("}" * left)
        elif token == "[[" and top:
            top.links += 1
            here().append(token)
        elif token == "]]" and top:
            top.links = max(0, top.links - 1)
            here().append(token)
        elif token == "|" and top and not top.links:
            top.parts.append([])
            top.named = False
        elif token == "=" and top and not top.links and len(top.parts) > 1 and not top.named:
            top.named = True
            here().append(EQUALS)
        else:
            here().append(token)
    while stack:
        rest = stack.pop().text()
        here().extend(rest)
    return root


def static_names(text: str) -> list[str]:
    """Names of templates that a text calls by plain names, in order of first use."""
    out: dict[str, None] = {}

    def walk(parts) -> None:
        for x in parts:
            if isinstance(x, Call):
                first = x.parts[0]
                if all(isinstance(t, str) for t in first):
                    name = "".join(first).strip()
                    if name and not name.startswith("#") and function_of(name)[0] is None and not _bad_name(name):
                        out[name] = None
            if isinstance(x, Call | Variable):
                for p in x.parts:
                    walk(p)

    walk(parse(include_filter(Tags().take(text), True)))
    return list(out)


def _bad_name(name: str) -> bool:
    return not name or name.startswith("[[") or "|" in name or "\n" in name.strip()


# -- evaluation ----------------------------------------------------------------------------------------------------
@dataclass
class Site:
    """What pages can ask about."""

    lang: str = "en"
    name: str = ""
    server: str = "http://en.wikipedia.org"
    clock: dt.datetime = dt.datetime(2008, 2, 9, 10, 55, 17)
    exists: frozenset[str] = frozenset()


class Arguments:
    """Arguments of a call, evaluated when they are read. Named ones are trimmed, positional ones aren't."""

    def __init__(self, parts: list[list], outer: Arguments | None, engine: Expander):
        self.engine, self.outer = engine, outer
        self.lazy: dict[str, tuple[bool, list]] = {}
        self.ready: dict[str, str] = {}
        self.ordered = parts
        n = 0
        for part in parts:
            if EQUALS in part:
                cut = part.index(EQUALS)
                self.lazy[engine.run(part[:cut], outer).strip()] = True, part[cut + 1 :]
            else:
                n += 1
                self.lazy[str(n)] = False, part

    def get(self, name: str) -> str | None:
        if name not in self.ready and name in self.lazy:
            trim, part = self.lazy[name]
            value = self.engine.run(part, self.outer)[:LONGEST]
            self.ready[name] = value.strip() if trim else value
        return self.ready.get(name)


class Expander:
    """Expands one page. ``lookup`` gives the text of a template by its full name, or None."""

    def __init__(self, pagename: str, lookup: Callable[[str], str | None], site: Site | None = None):
        self.pagename, self.lookup, self.site = pagename, lookup, site or Site()
        self.tags = Tags()
        self.missing: dict[str, None] = {}
        self.parsed: dict[str, list | None] = {}
        self.depth = 0
        self.title: str | None = None

    def expand(self, text: str, keep_tags: bool = False) -> str:
        out = self.run(parse(self.tags.take(include_filter(text, False))), None, "\n")
        return out if keep_tags else self.tags.restore(out)

    def run(self, parts: list, args: Arguments | None, before: str = "") -> str:
        out: list[str] = []
        last = before
        for x in parts:
            if isinstance(x, str):
                text = x
            elif x is EQUALS:
                text = "="
            else:
                text = self.variable(x, args) if isinstance(x, Variable) else self.call(x, args)
                if isinstance(x, Call) and text.startswith(("*", "#", ":", ";", "{|")) and not last.endswith("\n"):
                    text = "\n" + text
            if text:
                out.append(text)
                last = text
        return "".join(out)

    def variable(self, x: Variable, args: Arguments | None) -> str:
        name = self.run(x.parts[0], args).strip()
        if len(name) > LONGEST:
            return '<strong class="error">name too long</strong>'
        value = args.get(name) if args else None
        if value is not None:
            return value
        return self.run(x.parts[1], args) if len(x.parts) > 1 else "{{{" + name + "}}}"

    def template(self, name: str) -> list | None:
        if _bad_name(name):
            return None
        full = titles.plain_split(self.pagename + name, self.site.lang)[2] if name.startswith("/") else titles.plain_split(name, self.site.lang, 10)[2]
        if full not in self.parsed:
            raw = self.lookup(full)
            if raw is None:
                self.missing[full] = None
            self.parsed[full] = None if raw is None else parse(self.tags.take(include_filter(raw, True)))
        return self.parsed[full]

    def call(self, x: Call, args: Arguments | None) -> str:
        self.depth += 1
        try:
            if self.depth > RECURSION:
                return ""
            name = self.run(x.parts[0], args).strip()
            if name.lower().startswith(("safesubst:",)):
                name = name[10:].strip()
            apply, rest = function_of(name)
            if apply is not None:
                return apply(self, rest, x.parts[1:], args)
            body = self.template(name)
            return "" if body is None else self.run(body, Arguments(x.parts[1:], args, self))
        finally:
            self.depth -= 1


def function_of(name: str):
    """(function, text behind the colon) if a call's name is a function or a word, else (None, '')."""
    head, colon, rest = name.partition(":")
    key = head.strip().lower()
    if colon and key in FUNCTIONS:
        return FUNCTIONS[key], rest
    if not colon and name.strip().upper() in WORDS:
        return WORDS[name.strip().upper()], None
    if colon and key.upper() in WORDS:
        return WORDS[key.upper()], rest
    return None, ""


FUNCTIONS: dict[str, Callable] = {}
WORDS: dict[str, Callable] = {}


def function(*names: str):
    """Registers a function of the language; its names are matched in lower case."""

    def add(f):
        for n in names:
            if n in FUNCTIONS:
                raise ValueError(f"{n} is registered already")
            FUNCTIONS[n] = f
        return f

    return add


def _simple(*names: str):
    """Registers a function over evaluated, trimmed arguments."""

    def add(f):
        function(*names)(lambda e, rest, parts, args: f(e, [rest.strip(), *(_value(e, p, args).strip() for p in parts)]))
        return f

    return add


def _value(e: Expander, part: list, args) -> str:
    return e.run(part, args)


def _at(values: list[str], i: int) -> str:
    return values[i] if i < len(values) else ""


def _numeric(text: str):
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return None


def _same(a: str, b: str) -> bool:
    x, y = _numeric(a), _numeric(b)
    return a == b or (x is not None and y is not None and x == y)


def _branch(e, parts, args, i) -> str:
    return _value(e, parts[i], args).strip() if i < len(parts) else ""


@function("#if")
def _if(e, rest, parts, args):
    return _branch(e, parts, args, 0 if rest.replace("", "").strip() else 1)


@function("#ifeq")
def _ifeq(e, rest, parts, args):
    other = _branch(e, parts, args, 0)
    return _branch(e, parts, args, 1 if _same(rest.strip(), other) else 2)


@function("#ifexpr")
def _ifexpr(e, rest, parts, args):
    value = truth(rest)
    return value if isinstance(value, str) and value else _branch(e, parts, args, 0 if value else 1)


@function("#ifexist")
def _ifexist(e, rest, parts, args):
    name = titles.plain_split(rest.strip(), e.site.lang)[2] if rest.strip() else ""
    return _branch(e, parts, args, 0 if name and (name in e.site.exists or e.lookup(name) is not None) else 1)


@function("#iferror")
def _iferror(e, rest, parts, args):
    if re.search(r'(?i)<(div|span|p|strong)\s[^<>]*class="error"[^<>]*>', rest):
        return _branch(e, parts, args, 0)
    return _branch(e, parts, args, 1) if len(parts) > 1 else rest.strip()


@function("#switch")
def _switch(e, rest, parts, args):
    """Keys are looked at in order; a key without a value takes the next one's; ``#default``, else the last bare value, is the rest."""
    value, default, waiting, bare = rest.strip(), None, False, None
    for part in parts:
        if EQUALS in part:
            cut = part.index(EQUALS)
            key = e.run(part[:cut], args).strip()
            if waiting or _same(key, value):
                return e.run(part[cut + 1 :], args).strip()
            if key == "#default":
                default = part[cut + 1 :]
            bare = None
        else:
            bare = part
            waiting = waiting or _same(e.run(part, args).strip(), value)
    if bare is not None:
        return e.run(bare, args).strip()
    return e.run(default, args).strip() if default is not None else ""


@_simple("#expr")
def _expr(e, v):
    return expr(v[0])


@_simple("#titleparts")
def _titleparts(e, v):
    n, start = _numeric(_at(v, 1)), _numeric(_at(v, 2))
    n, start = n if isinstance(n, int) else 0, start if isinstance(start, int) else 1
    parts = v[0].split("/")[start - 1 if start > 0 else start :]
    return "/".join(parts[:n] if n else parts)


@_simple("#rel2abs")
def _rel2abs(e, v):
    path, base = v[0].rstrip("/"), _at(v, 1) or e.pagename
    if path in ("", "."):
        return base
    stack: list[str] = []
    for p in f"{base if path.startswith(('/', './', '../')) else ''}/{path}".split("/"):
        if p == "..":
            del stack[-1:]
        elif p not in ("", "."):
            stack.append(p)
    return "/".join(stack)


@function("#tag")
def _tag(e, rest, parts, args):
    attributes = "".join(f" {e.run(p[: p.index(EQUALS)], args)}={quoteattr(e.run(p[p.index(EQUALS) + 1 :], args))}" for p in parts[1:] if EQUALS in p)
    inner = e.run(["=" if x is EQUALS else x for x in parts[0]], args) if parts else ""
    return e.tags.take(f"<{rest.strip()}{attributes}>{inner}</{rest.strip()}>")


_simple("lc")(lambda e, v: v[0].lower())
_simple("uc")(lambda e, v: v[0].upper())
_simple("lcfirst")(lambda e, v: v[0][:1].lower() + v[0][1:])
_simple("ucfirst")(lambda e, v: v[0][:1].upper() + v[0][1:])
_simple("urlencode")(lambda e, v: urllib.parse.quote_plus(v[0]))
_simple("anchorencode")(lambda e, v: urllib.parse.quote_plus(v[0], ":").replace("%", ".").replace("+", "_"))
_simple("localurl")(lambda e, v: "/wiki/" + v[0])
_simple("localurle")(lambda e, v: urllib.parse.quote("/wiki/" + v[0]))
_simple("fullurl")(lambda e, v: f"{e.site.server}/wiki/{urllib.parse.quote_plus(v[0].capitalize().replace(' ', '_'))}" + (f"?{v[1]}" if len(v) > 1 else ""))
_simple("#language")(lambda e, v: v[0])
_simple("defaultsort")(lambda e, v: "")
_simple("ns")(lambda e, v: titles.NAMESPACES.get(e.site.lang, titles.NAMESPACES["en"]).get(_numeric(v[0]), "") if isinstance(_numeric(v[0]), int) else "")
function("subst")(lambda e, rest, parts, args: "{{subst:" + "|".join([rest, *(e.run(["=" if x is EQUALS else x for x in p], args) for p in parts)]) + "}}")


@_simple("displaytitle")
def _displaytitle(e, v):
    e.title = v[0]
    return ""


def _fill(text: str, width: str, fill: str) -> str:
    n = _numeric(width)
    missing = min(n, WIDEST) - len(text) if isinstance(n, int) else 0
    return (fill * (missing // len(fill) + 1))[:missing] if missing > 0 else ""


_simple("padleft")(lambda e, v: _fill(v[0], _at(v, 1), _at(v, 2) or "0") + v[0])
_simple("padright")(lambda e, v: v[0] + _fill(v[0], _at(v, 1), _at(v, 2) or "0"))


@_simple("formatnum")
def _formatnum(e, v):
    if _at(v, 1) in ("r", "R"):
        plain = v[0].replace(",", "")
        return str(_numeric(plain)) if _numeric(plain) is not None else v[0]
    n = _numeric(v[0])
    if n is None:
        return v[0]
    return f"{n:,}" if isinstance(n, int) else f"{float(f'{n:g}'):,g}" if "e" not in f"{n:g}" else f"{n:g}"


def strftime(fmt: str, t: dt.datetime) -> str:
    """``#time`` formats for one date."""
    codes = {
        "Y": str(t.year), "y": f"{t.year % 100:02d}", "n": str(t.month), "m": f"{t.month:02d}", "M": f"{t:%b}", "F": f"{t:%B}", "W": f"{t.isocalendar()[1]:02d}", "j": str(t.day), "d": f"{t.day:02d}",
        "z": str(t.timetuple().tm_yday - 1), "D": f"{t:%a}", "l": f"{t:%A}", "N": str(t.isoweekday()), "w": str(t.isoweekday() % 7), "a": "am" if t.hour < 12 else "pm", "A": "AM" if t.hour < 12 else "PM",
        "g": str((t.hour + 11) % 12 + 1), "h": f"{(t.hour + 11) % 12 + 1:02d}", "G": str(t.hour), "H": f"{t.hour:02d}", "i": f"{t.minute:02d}", "s": f"{t.second:02d}",
        "U": str(int((t - dt.datetime(1970, 1, 1)).total_seconds())), "L": str(int(t.year % 4 == 0 and (t.year % 100 != 0 or t.year % 400 == 0))),
        "c": f"{t:%Y-%m-%dT%H:%M:%S}+00:00", "r": f"{t:%a, %d %b %Y %H:%M:%S} +0000", "t": str(((t.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)).day),
    }
    out, as_roman = [], False
    for piece in re.findall(r'"[^"]*"|xr|\\.|.', fmt, re.S):
        if piece == "xr":
            as_roman = True
        elif piece in codes:
            out.append(roman(int(codes[piece])) if as_roman and codes[piece].isdigit() else codes[piece])
            as_roman = False
        else:
            out.append(piece[1] if len(piece) == 2 and piece[0] == "\\" else piece[1:-1] if len(piece) >= 2 and piece[0] == '"' else piece)
    return "".join(out).strip()


_DATES = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d %b %Y %H:%M:%S", "%d %b %Y %H:%M", "%d %b %Y", "%d %B %Y %H:%M:%S", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%B %d %Y", "%Y/%m/%d", "%m/%d/%Y", "%d.%m.%Y", "%Y%m%d%H%M%S", "%Y%m%d", "%B %Y", "%b %Y")
_UNITS = {"second": "seconds", "minute": "minutes", "hour": "hours", "day": "days", "week": "weeks"}


def parse_date(text: str, clock: dt.datetime) -> dt.datetime | None:
    text = text.strip()
    if re.fullmatch(r"\d{4}", text) and int(text[:2]) < 24 and int(text[2:]) < 60:
        return clock.replace(hour=int(text[:2]), minute=int(text[2:]), second=0)
    tail = re.search(r"\s*([+-])\s*(\d+)\s*(second|minute|hour|day|week|month|year)s?$", text)
    bare = text[: tail.start()].strip() if tail else text
    found = clock if bare in ("", "now") else None
    for fmt in _DATES:
        if found is None:
            try:
                found = dt.datetime.strptime(bare, fmt)
            except ValueError:
                continue
    if found is None or not tail:
        return found
    n = int(tail[2][:12]) * (-1 if tail[1] == "-" else 1)
    try:
        if tail[3] in _UNITS:
            return found + dt.timedelta(**{_UNITS[tail[3]]: n})
        months = found.year * 12 + found.month - 1 + n * (12 if tail[3] == "year" else 1)
        year, month = months // 12, months % 12 + 1
        return found.replace(year=year, month=month, day=min(found.day, calendar.monthrange(year, month)[1]))  # the last day of a shorter month
    except (OverflowError, ValueError, IndexError):  # beyond the years 1 to 9999
        return None


@_simple("#time")
def _time(e, v):
    date = parse_date(_at(v, 1), e.site.clock) if _at(v, 1) else e.site.clock
    return '<strong class="error">Error: invalid time</strong>' if date is None else strftime(v[0], date)


def _word(*names: str):
    def add(f):
        for n in names:
            WORDS[n] = lambda e, rest, parts, args, f=f: f(e, e.pagename if rest is None or not rest.strip() else rest.strip())
        return f

    return add


for _name, _fmt in {"DAY": "j", "DAY2": "d", "DAYNAME": "l", "DOW": "w", "MONTH": "m", "MONTHABBREV": "M", "MONTHNAME": "F", "TIME": "H:i", "WEEK": "W", "YEAR": "Y", "TIMESTAMP": "YmdHis"}.items():
    for _prefix in ("CURRENT", "LOCAL"):
        _word(_prefix + _name)(lambda e, page, fmt=_fmt: strftime(fmt, e.site.clock))
for _name in ("NUMBEROFARTICLES", "NUMBEROFPAGES", "NUMBEROFFILES", "NUMBEROFUSERS"):
    _word(_name)(lambda e, page: "0")
_word("CURRENTVERSION")(lambda e, page: "1.7alpha")
_word("REVISIONID", "!TOC")(lambda e, page: "")
_word("SITENAME")(lambda e, page: e.site.name)
_word("SERVER")(lambda e, page: e.site.server)
_word("SERVERNAME")(lambda e, page: urllib.parse.urlparse(e.site.server).netloc)


def _encoded(name: str) -> str:
    return urllib.parse.quote(name.replace(" ", "_"), "/:")


def _in_ns(e: Expander, page: str, move: Callable[[int], int]) -> str:
    ns, partial, _ = titles.plain_split(page, e.site.lang)
    name = titles.NAMESPACES.get(e.site.lang, titles.NAMESPACES["en"]).get(move(ns) if ns >= 0 else ns, "")
    return f"{name}:{partial}" if name else partial


def _ns_word(e: Expander, page: str, move: Callable[[int], int]) -> str:
    ns = titles.plain_split(page, e.site.lang)[0]
    return titles.NAMESPACES.get(e.site.lang, titles.NAMESPACES["en"]).get(move(ns) if ns >= 0 else ns, "")


_PAGE_WORDS = {
    "PAGENAME": lambda e, p: titles.plain_split(p, e.site.lang)[1], "FULLPAGENAME": lambda e, p: titles.plain_split(p, e.site.lang)[2],
    "BASEPAGENAME": lambda e, p: titles.plain_split(p, e.site.lang)[1].rpartition("/")[0] or titles.plain_split(p, e.site.lang)[1],
    "SUBPAGENAME": lambda e, p: titles.plain_split(p, e.site.lang)[1].rpartition("/")[2],
    "NAMESPACE": lambda e, p: _ns_word(e, p, lambda n: n), "TALKSPACE": lambda e, p: _ns_word(e, p, lambda n: n | 1),
    "SUBJECTSPACE": lambda e, p: _ns_word(e, p, lambda n: n & ~1), "ARTICLESPACE": lambda e, p: _ns_word(e, p, lambda n: n & ~1),
    "TALKPAGENAME": lambda e, p: _in_ns(e, p, lambda n: n | 1), "SUBJECTPAGENAME": lambda e, p: _in_ns(e, p, lambda n: n & ~1), "ARTICLEPAGENAME": lambda e, p: _in_ns(e, p, lambda n: n & ~1),
}
for _name, _f in _PAGE_WORDS.items():
    _word(_name)(_f)
    _word(_name + "E")(lambda e, page, f=_f: _encoded(f(e, page)))


def expand(text: str, templates: dict[str, str] | None = None, pagename: str = "thispage", site: Site | None = None) -> str:
    """Expands one text; template names are normalised as titles."""
    site = site or Site()
    named = {titles.plain_split(k, site.lang, 10)[2]: v for k, v in (templates or {}).items()}
    return Expander(pagename, named.get, site).expand(text)


# -- tables --------------------------------------------------------------------------------------------------------
_OUT = "page_id string, title string, text string, missing array<string>, displaytitle string"


def _rows(site: Site, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = shared.value if shared is not None else {k: v for k, v in (row["bundle"] or [])}
                e = Expander(row["title"] or "", own.get, site)
                text = row["rawtext"]
                try:
                    made = None if text is None else e.expand(text)
                except RecursionError:
                    made = '<strong class="error">expansion too deep</strong>'
                except (ValueError, LookupError, OverflowError, MemoryError, TypeError, AttributeError) as error:  # one page, not the table
                    made = f'<strong class="error">{type(error).__name__}</strong>'
                out.append({"page_id": row["page_id"], "title": row["title"], "text": made, "missing": list(e.missing), "displaytitle": e.title})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.string()), ("title", pa.string()), ("text", pa.string()), ("missing", pa.list_(pa.string())), ("displaytitle", pa.string())]))

    return run


def _names(site: Site):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n in static_names(text or ""):
                    keys.append(key)
                    names.append(titles.plain_split(n, site.lang, 10)[2])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string())], ["source", "template"])

    return run


def edges(texts: DataFrame, site: Site | None = None) -> DataFrame:
    """(source, template): the static calls of a table (key, text)."""
    return texts.mapInArrow(_names(site or Site()), "source string, template string").distinct()


def closure(pages: DataFrame, templates: DataFrame, site: Site | None = None) -> DataFrame:
    """(page_id, template): everything a page may call, directly or through templates."""
    direct = edges(pages.select("page_id", "rawtext"), site).select(F.col("source").alias("page_id"), "template")
    between = edges(templates.select("name", "body"), site).select(F.col("source").alias("caller"), F.col("template").alias("called"))
    found = fresh = direct
    while True:  # ends: a page can call each template once at most
        fresh = fresh.join(between, F.col("template") == F.col("caller")).select("page_id", F.col("called").alias("template")).distinct().join(found, ["page_id", "template"], "left_anti").checkpoint()
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found


def expand_pages(pages: DataFrame, templates: DataFrame, site: Site | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, title, text, missing, displaytitle for (page_id, title, rawtext), with templates (name: the full name, body)."""
    site, spark = site or Site(), pages.sparkSession
    pages = pages.select(F.col("page_id").cast("string").alias("page_id"), "title", "rawtext")
    size = templates.agg(F.sum(F.octet_length("body") + F.octet_length("name"))).first()[0] or 0
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r["name"]: r["body"] for r in templates.select("name", "body").collect()})
        return dealt(pages).mapInArrow(_rows(site, shared), _OUT)
    need = closure(pages, templates, site)
    while True:  # ends: each round but the last adds templates that exist
        bundles = need.join(templates.select(F.col("name").alias("template"), "body"), "template").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("template", "body"))).alias("bundle"))
        made = pages.join(bundles, "page_id", "left").mapInArrow(_rows(site, None), _OUT).checkpoint()
        more = made.select("page_id", F.explode("missing").alias("template")).join(templates.select(F.col("name").alias("template")), "template", "left_semi").select("page_id", "template")
        if more.isEmpty():
            return made
        need = need.unionByName(more).distinct().checkpoint()


def call_arguments(text: str, name: str) -> dict[str, str] | None:
    """Arguments of the first call of a template in a text, by name or position; null if it isn't called."""
    want = titles.plain_split(name, "en", 10)[2]
    e = Expander("", lambda n: None)

    def walk(parts):
        for x in parts:
            if isinstance(x, Call | Variable):
                if isinstance(x, Call) and all(isinstance(t, str) for t in x.parts[0]) and titles.plain_split("".join(x.parts[0]).strip(), "en", 10)[2] == want:
                    return x
                for p in x.parts:
                    if (hit := walk(p)) is not None:
                        return hit
        return None

    hit = walk(parse(e.tags.take(text)))
    if hit is None:
        return None
    args = Arguments(hit.parts[1:], None, e)
    return {k: (args.get(k) or "").strip() for k in args.lazy}


def unescape(text: str) -> str:
    """Entities with a semicolon: numbers and known names; others stay."""
    return re.sub(r"&(#\d+|#[xX][0-9a-fA-F]+|\w+);", lambda m: html.unescape(m[0]), text)
