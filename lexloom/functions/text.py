"""String functions of the template language as native columns (no Python in the plan unless a docstring says so)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    """A column by name, or the column itself."""
    return F.col(x) if isinstance(x, str) else x


def lc(s):
    return F.lower(col(s))


def uc(s):
    return F.upper(col(s))


def lcfirst(s):
    """Only the first character changes."""
    s = col(s)
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def ucfirst(s):
    s = col(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


#: No text is padded beyond this; a width of any size has a result.
WIDEST = 256 * 1024


def _width(width) -> Column:
    text = F.trim(col(width).cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), F.least(text.try_cast("decimal(38,0)"), F.lit(WIDEST)).cast("int"))


def padleft(s, width, fill="0"):
    """Fills in front up to a width, cycling through the fill; never cuts; a width that is no number changes nothing."""
    s, w = col(s), _width(width)
    fill = F.when(F.lit(fill) == "", F.lit("0")).otherwise(F.lit(fill))
    return F.when(w.isNull() | (F.length(s) >= w), s).otherwise(F.lpad(s, w, fill))


def padright(s, width, fill="0"):
    s, w = col(s), _width(width)
    fill = F.when(F.lit(fill) == "", F.lit("0")).otherwise(F.lit(fill))
    return F.when(w.isNull() | (F.length(s) >= w), s).otherwise(F.rpad(s, w, fill))


def urlencode(s):
    """Form encoding: spaces as +, every other character than letters, digits and ``_.-~`` as %XX."""
    return F.replace(F.replace(F.url_encode(col(s)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def quote(s, safe: str = "/"):
    """Path encoding: spaces as %20; the safe characters stay."""
    out = F.replace(urlencode(s), F.lit("+"), F.lit("%20"))
    for c in safe:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def localurl(s):
    return F.concat(F.lit("/wiki/"), col(s))


def localurle(s):
    return quote(localurl(s))


def fullurl(s, base, query=None):
    """The first letter is raised and all others lowered, spaces become underscores."""
    s = col(s)
    name = F.replace(F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30))), F.lit(" "), F.lit("_"))
    url = F.concat(F.lit(base), F.lit("/"), urlencode(name))
    return url if query is None else F.concat(url, F.lit("?"), col(query))


def servername(url):
    """Network location of a URL, port included."""
    return F.try_parse_url(col(url), F.lit("AUTHORITY"))


def anchorencode(s):
    return F.replace(F.replace(F.replace(urlencode(s), F.lit("%3A"), F.lit(":")), F.lit("%"), F.lit(".")), F.lit("+"), F.lit("_"))


def titleparts(title, count=0, start=1):
    """Parts of a title between slashes: ``start`` counts from 1 or from the end, ``count`` 0 takes all, negative leaves some at the end."""
    parts = F.split(col(title), "/")
    n = F.size(parts)
    first = start - 1 if start > 0 else start
    at = F.lit(first) if first >= 0 else F.greatest(F.lit(0), n + first)
    rest = F.greatest(F.lit(0), n - at)
    take = rest if count == 0 else F.least(rest, F.lit(count)) if count > 0 else F.greatest(F.lit(0), rest + count)
    return F.array_join(F.slice(parts, at + 1, take), "/")


def rel2abs(path, base):
    """Resolves ``./x`` and ``../x`` (and ``/x``) against a page name; other paths stand for themselves."""
    path, base = F.regexp_replace(col(path), "/+$", ""), col(base)
    relative = path.rlike(r"^(/|\./|\.\./)")
    whole = F.concat_ws("/", F.when(relative, base).otherwise(F.lit("")), path)
    stack = F.aggregate(
        F.split(whole, "/"), F.array().cast("array<string>"),
        lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p)),
    )
    return F.when(path.isin("", "."), base).otherwise(F.array_join(stack, "/"))


def basepagename(title):
    """Without the last part behind a slash."""
    title = col(title)
    return F.when(F.contains(title, F.lit("/")), F.regexp_replace(title, "/[^/]*$", "")).otherwise(title)


def subpagename(title):
    return F.substring_index(col(title), "/", -1)


def escaped_name(title):
    """The encoded form of page-name words: underscores for spaces."""
    return quote(F.replace(col(title), F.lit(" "), F.lit("_")), "/:")


def fs_escape(s):
    """A name that is safe in a path: ~n~ for the code point of a character outside ASCII or one of ``/ \\``, ~~ for ~, underscores for spaces."""
    s = col(s)
    chars = F.transform(F.split(s, ""), lambda c: F.when(c == "~", F.lit("~~")).when(c.rlike(r"[^\x00-\x7F]|[/\\]"), F.concat(F.lit("~"), F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10), F.lit("~"))).otherwise(c))
    odd = s.rlike(r"[^\x00-\x7F]|[~/\\]")
    text = F.when(odd, F.array_join(chars, "")).otherwise(s)
    return F.regexp_replace(F.replace(F.trim(text), F.lit(" "), F.lit("_")), r"[^a-zA-Z0-9_.~-]", "")


def remove_nowiki(s):
    return F.regexp_replace(col(s), "(?i)</?nowiki>", "")


def split_tag(s):
    """(name, rest): the first word of a tag's inside and what follows."""
    s = F.trim(col(s))
    return F.struct(F.lower(F.regexp_extract(s, r"^(\S+)", 1)).alias("name"), F.regexp_extract(s, r"^\S+\s+([\s\S]*)$", 1).alias("rest"))


_PARAM = r"(\w+)\s*=\s*(\"[^\"]*\"|'[^']*'|[\w%:#]+)"


def params(s):
    """Attributes ``name=value`` as a map; the last of equal names counts. Values may be quoted."""
    s = col(s)
    names, values = F.regexp_extract_all(s, F.lit(_PARAM), F.lit(1)), F.regexp_extract_all(s, F.lit(_PARAM), F.lit(2))
    bare = F.transform(values, lambda v: F.when(v.rlike("^[\"']"), F.regexp_replace(v, "^[\"']|[\"']$", "")).otherwise(v))
    return _last_wins(F.arrays_zip(names.alias("k"), bare.alias("v")))


def _last_wins(pairs):
    """A map of (first field, second field) whatever the session's policy on repeated keys is."""
    entries = F.transform(pairs, lambda p: F.struct(p[F.lit("k")].alias("k"), p[F.lit("v")].alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def style(s):
    """A style attribute as a map with lower-case names."""
    parts = F.filter(F.split(col(s), ";"), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def clamped(attribute):
    """colspan or rowspan as a number of at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.trim(col(attribute)).try_cast("int"), F.lit(1)))


def preprocess(s, included: bool):
    """What a page gives when it is transcluded, or shown itself. ``<onlyinclude>`` parts win when transcluded."""
    s = col(s)
    if included:
        out = F.regexp_replace(s, r"(?is)<noinclude(?:\s[^<>]*)?>.*?(</noinclude>|\z)", "")
        only = F.regexp_extract_all(out, F.lit(r"(?is)<onlyinclude>(.*?)</onlyinclude>"), F.lit(1))
        return F.when(F.contains(out, F.lit("<onlyinclude>")), F.array_join(only, "")).otherwise(out)
    out = F.regexp_replace(s, r"(?is)<includeonly(?:\s[^<>]*)?>.*?(?:</includeonly>|\z)", "")
    return F.regexp_replace(out, r"(?is)</?(onlyinclude|noinclude)(?:\s[^<>]*)?>", "")


def implicit_newline(s):
    """Expanded text that begins like a list, table or definition starts on a line of its own."""
    s = col(s)
    return F.when(s.rlike(r"^([*#:;]|\{\|)"), F.concat(F.lit("\n"), s)).otherwise(s)


def if_(condition, yes, no):
    """Empty after trimming (U+EBAD counts as space) is false; the result is trimmed."""
    return F.trim(F.when(F.trim(F.replace(col(condition), F.lit(""), F.lit(""))) != "", col(yes)).otherwise(col(no)))


_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"


def number(s):
    """The number that a text stands for, null if none; 1_0 is 10, and 1d or 0x1 are no numbers."""
    s = col(s)
    return F.when(s.rlike(_NUMBER), F.replace(F.trim(s), F.lit("_"), F.lit("")).try_cast("double"))


def same(a, b):
    """Equality of the comparing functions: equal texts, or equal numbers."""
    a, b = col(a), col(b)
    return (a == b) | F.coalesce(number(a) == number(b), F.lit(False))


def ifeq(a, b, yes, no):
    return F.when(same(F.trim(col(a)), F.trim(col(b))), col(yes)).otherwise(col(no))


def iferror(value, bad, good=None):
    value = col(value)
    return F.when(value.rlike(r"(?i)<(div|span|p|strong)\s[^<>]*class=\"error\"[^<>]*>"), col(bad)).otherwise(value if good is None else col(good))


def switch(value, cases: list[tuple[str, str | None]], default: str = ""):
    """Literal ``#switch``: the first key that equals the value counts; a key without a result takes the next result."""
    value, out = F.trim(col(value)), None
    result: str | None = default
    chain: list[tuple[str, str]] = []
    for key, own in reversed(cases):
        result = own if own is not None else result
        chain.append((key, result or ""))
    for key, text in reversed(chain):
        test = same(value, F.lit(key))
        out = F.when(test, F.lit(text)) if out is None else out.when(test, F.lit(text))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def formatnum(s, grouping: str = ",", point: str = "."):
    """Groups the digits of whole numbers; others have up to six significant digits; text that is no number stays."""
    s = col(s)
    whole = F.trim(s).rlike(r"^[+-]?\d+$")
    plain = F.format_number(F.trim(s).try_cast("decimal(38,0)"), 0)
    value = number(s)
    general = _general(value)
    head = F.format_number(F.substring_index(general, ".", 1).try_cast("decimal(38,0)"), 0)
    sign = F.when(general.startswith("-") & ~head.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    tail = F.when(F.contains(general, F.lit(".")), F.concat(F.lit("."), F.substring_index(general, ".", -1))).otherwise(F.lit(""))
    grouped = F.when(whole, plain).when(value.isNull(), F.lit(None)).when(F.contains(general, F.lit("e")), general).otherwise(F.concat(sign, head, tail))
    swapped = F.translate(grouped, ",.", grouping + point) if (grouping, point) != (",", ".") else grouped
    return F.coalesce(swapped, s)


def _general(value):
    """%g: six significant digits, no trailing zeros, exponents outside 1e-4 to 1e6."""
    exponent = F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(value)) + 1e-12).cast("int"))
    fixed = F.when(exponent >= 5, F.printf(F.lit("%.0f"), value))
    for e, digits in ((4, 1), (3, 2), (2, 3), (1, 4), (0, 5), (-1, 6), (-2, 7), (-3, 8), (-4, 9)):
        fixed = fixed.when(exponent == e, F.printf(F.lit(f"%.{digits}f"), value))
    fixed = F.when(F.contains(fixed, F.lit(".")), F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")).otherwise(fixed)
    return F.when((exponent < -4) | (exponent >= 6), F.regexp_replace(F.printf(F.lit("%.5e"), value), r"\.?0*e", "e")).otherwise(fixed)


def reverse_formatnum(s, grouping: str = ",", point: str = "."):
    s = col(s)
    plain = F.replace(F.replace(s, F.lit(grouping), F.lit("")), F.lit(point), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("decimal(38,0)").cast("string")).otherwise(F.coalesce(number(plain).cast("string"), s))


def authors_text(authors):
    """Names as text: no anonymous edits are left out, others are counted in words."""
    kept = F.filter(col(authors), lambda a: a != "ANONIPEDITS:0")
    return F.array_join(F.transform(kept, lambda a: F.regexp_replace(a, r"^ANONIPEDITS:(\d+)$", "$1 anonymous contributors")), ", ")


def rot13(s):
    low = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(col(s), low + low.upper(), low[13:] + low[:13] + (low[13:] + low[:13]).upper())


def mapframe_id(height, width, lat, lon, zoom):
    return F.sha1(F.concat_ws("x", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in (height, width, lat, lon, zoom)]))


def collection_id(*parts):
    """The first 16 hexadecimal digits of a hash over all parts."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def is_collection_id(s):
    return col(s).rlike("^[a-f0-9]{16}$")


def article_url(base, title, revision=None, script_extension: str = ".php"):
    """index.php?title=..., or ?oldid=... for a revision."""
    index = F.concat(F.lit(base), F.lit("index"), F.lit(script_extension))
    named = F.concat(index, F.lit("?title="), quote(F.replace(col(title), F.lit(" "), F.lit("_")), ":/@"))
    if revision is None:
        return named
    return F.when(col(revision).isNotNull(), F.concat(index, F.lit("?oldid="), col(revision).cast("string"))).otherwise(named)


def suggest_filename(*names):
    """The first name that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(col(n)), F.lit("")) for n in names], F.lit("collection"))


def redact(args, option: str = "--password"):
    """Replaces what follows an option in an argument list, wherever it occurs."""
    args = col(args)
    return F.transform(args, lambda a, i: F.when((i > 0) & (F.try_element_at(args, i) == option), F.lit("{OMITTED}")).otherwise(a))


def visible_length(s):
    """Length without tags."""
    return F.length(F.regexp_replace(col(s), "<[^>]*>", ""))


def good_base_url(url):
    """False for local hosts and private networks."""
    host = F.try_parse_url(col(url), F.lit("HOST"))
    return ~F.coalesce((host == "localhost") | host.startswith("127.0.") | host.startswith("192.168."), F.lit(False))


def safe_url(url):
    """The URL with its path encoded anew, null if it has no scheme, no host or white space."""
    url = col(url)
    scheme, host, path = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("AUTHORITY")), F.try_parse_url(url, F.lit("PATH"))
    query, ref = F.try_parse_url(url, F.lit("QUERY")), F.try_parse_url(url, F.lit("REF"))
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    tail = F.concat(F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(F.lit("")), F.when(ref.isNotNull(), F.concat(F.lit("#"), ref)).otherwise(F.lit("")))
    return F.when(scheme.isNotNull() & host.isNotNull() & ~url.rlike(r"\s"), F.concat(scheme, F.lit("://"), host, quote(F.coalesce(decoded, path), "/"), tail))


def api_candidates(url):
    """Places where a wiki's api.php may be, by the URL of one of its articles."""
    url = col(url)
    root = F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "[^/]*$", "")
    return F.array_distinct(F.array(F.concat(root, path, F.lit("api.php")), F.concat(root, F.lit("/w/api.php")), F.concat(root, F.lit("/wiki/api.php")), F.concat(root, F.lit("/api.php"))))
