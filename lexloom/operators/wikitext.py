"""Wiki markup to node tables: one recursive descent over lines, then over each line's inline markup.

A document becomes rows in pre-order: ``node_id`` (its pre-order number), ``parent``, ``post`` (the last number below it), ``depth``, ``ord`` (place among
its siblings), ``class``, ``caption`` (text, title or target), ``tag``, ``attrs``, ``level``, ``target``, ``ns``. Ancestors and descendants are then interval conditions
within a document. Parsing never fails: what isn't closed closes at the end of its block, what isn't markup is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import titles
from ..functions.markup import ALLOWED, EMPTY
from ..session import dealt
from .templates import Tags, unescape

#: Documents deeper than this are cut to text there.
DEEPEST = 80

#: Classes of tags.
TAG_CLASSES = {"b": "Strong", "strong": "Strong", "i": "Emphasized", "em": "Emphasized", "u": "Underline", "s": "Strike", "strike": "Strike", "sub": "Sub", "sup": "Sup", "small": "Small", "big": "Big", "cite": "Cite", "var": "Var", "code": "Code", "tt": "Teletyped", "kbd": "Teletyped", "br": "BreakingReturn", "hr": "HorizontalRule", "ref": "Reference", "references": "ReferenceList", "gallery": "Gallery", "center": "Center", "div": "Div", "span": "Span", "font": "Font", "del": "Deleted", "ins": "Inserted", "abbr": "Abbreviation", "ruby": "Ruby", "blockquote": "Blockquote", "p": "Paragraph", "ul": "ItemList", "ol": "ItemList", "li": "Item", "dl": "DefinitionList", "dt": "DefinitionTerm", "dd": "DefinitionDescription", "table": "Table", "tr": "Row", "td": "Cell", "th": "Cell", "caption": "TableCaption", "pre": "PreFormatted", "source": "Source", "syntaxhighlight": "Source", "math": "Math", "timeline": "Timeline", "imagemap": "ImageMap", "poem": "Poem", "index": "Index"}
BLOCKS = {"Paragraph", "Section", "ItemList", "Item", "DefinitionList", "DefinitionTerm", "DefinitionDescription", "Table", "Row", "Cell", "TableCaption", "PreFormatted", "Blockquote", "Center", "Div", "Gallery", "ReferenceList", "HorizontalRule", "Source", "Timeline", "Indented"}


@dataclass
class Node:
    cls: str
    caption: str = ""
    tag: str | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    level: int | None = None
    target: str | None = None
    ns: int | None = None
    children: list[Node] = field(default_factory=list)

    def text(self) -> str:
        return "".join(n.caption for n in self.walk() if n.cls == "Text")

    def walk(self) -> Iterator[Node]:
        """Itself and all nodes below, in pre-order; without recursion, so that no tree is too deep."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += node.children[::-1]

    def find(self, cls: str) -> list[Node]:
        return [n for n in self.walk() if n.cls == cls]


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): v[1:-1] if v[:1] in "\"'" else v for k, v in re.findall(r"(\w+)\s*=\s*(\"[^\"]*\"|'[^']*'|[\w%:#]+)", text or "")}


#: Ways to read a run of apostrophes: how many stay text, and what the rest toggles. Runs over 5 are one of 5 with more text.
_READINGS = {2: [(0, "i")], 3: [(0, "b"), (1, "i")], 4: [(1, "b"), (2, "i")], 5: [(0, "bi"), (2, "b"), (3, "i")]}


def bold_italic(counts: list[int]) -> list[tuple[int, str]]:
    """For the runs of apostrophes of a line: (apostrophes that stay text, what the rest toggles: i, b, bi).

    The readings with the least sum of text apostrophes and styles still open at the end, the first found among equals. That sum follows from
    what is open, so the best way to each of the four states is all that has to be kept from run to run."""
    best: dict[str, tuple[int, tuple]] = {"": (0, ())}
    for n in counts:
        more, after = max(0, n - 5), {}
        for state, (cost, way) in best.items():
            for text, toggles in _READINGS[min(n, 5)]:
                now = "".join(k for k in "bi" if (k in state) != (k in toggles))
                if now not in after or cost + text + more < after[now][0]:
                    after[now] = (cost + text + more, (way, (text + more, toggles)))
        best = after
    way = min(best.items(), key=lambda x: x[1][0] + len(x[0]))[1][1] if best else ()
    out = []
    while way:
        way, step = way
        out.append(step)
    return out[::-1]


@F.arrow_udf(LongType())
def least_sum(runs: pa.Array) -> pa.Array:
    """Text apostrophes and styles left open in the best reading of runs of apostrophes (arrays of lengths)."""
    out = []
    for counts in runs.to_pylist():
        ways = bold_italic(counts or [])
        toggled = "".join(kind for _, kind in ways)
        out.append(sum(n for n, _ in ways) + toggled.count("b") % 2 + toggled.count("i") % 2)
    return pa.array(out, pa.int64())


_INLINE = re.compile(r"(?P<link>\[\[)|(?P<url>\[(?:https?://|ftp://|irc://|news:|mailto:|//)[^\s\]]+)|(?P<bare>\b(?:https?|ftp)://[^\s\[\]<>\"|{}\x7f]+)|(?P<quote>'{2,})|(?P<mark>\x7fTAG-\d+\x7f)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>(?:\s[^<>]*?)?)(?P<end>/?)>")


def list_orphans(root: Node) -> None:
    """Runs of list items that stand in no list get one."""
    for n in list(root.walk()):
        if n.tag in ("ul", "ol") or not any(c.tag == "li" and c.cls == "Item" for c in n.children):
            continue
        out: list[Node] = []
        for c in n.children:
            own = c.tag == "li" and c.cls == "Item"
            blank = c.cls == "Text" and not c.caption.strip()
            if own or (blank and out and out[-1].attrs.get("orphans")):
                if not (out and out[-1].attrs.get("orphans")):
                    out.append(Node("ItemList", tag="ul", attrs={"orphans": "true"}))
                out[-1].children += [c] if own else []
            else:
                out.append(c)
        n.children = out
    for n in root.walk():
        n.attrs.pop("orphans", None)


class Parser:
    def __init__(self, lang: str = "en"):
        self.lang = lang
        self.tags = Tags()

    # -- inline ----------------------------------------------------------------------------------------------
    def inline(self, text: str, depth: int = 0) -> list[Node]:
        if depth > DEEPEST:
            return [Node("Text", text)]
        root = Node("Node")
        stack = [root]
        ends = self._ends(text)
        runs = iter(bold_italic(self._runs(text, ends)))
        at = 0

        def add(node: Node) -> None:
            stack[-1].children.append(node)

        def say(t: str) -> None:
            if t:
                kids = stack[-1].children
                if kids and kids[-1].cls == "Text":
                    kids[-1].caption += unescape(t)
                else:
                    add(Node("Text", unescape(t)))

        def toggle(name: str) -> None:
            if any(n.tag == name and n.level == -1 for n in stack):
                over = []
                while True:
                    n = stack.pop()
                    if n.tag == name and n.level == -1:
                        break
                    over.append(n)
                for n in reversed(over):  # what was opened inside goes on behind
                    again = Node(n.cls, n.caption, n.tag, n.attrs, n.level)
                    add(again)
                    stack.append(again)
            else:
                node = Node("Emphasized" if name == "''" else "Strong", name, name, level=-1)
                add(node)
                stack.append(node)

        while m := _INLINE.search(text, at):
            say(text[at : m.start()])
            at = m.end()
            if m["link"]:
                end = ends.get(at, -1)
                inner = text[at:end] if end >= 0 else ""
                if end < 0 or not inner.strip() or "\n" in inner.split("|", 1)[0]:
                    say("[[")
                else:
                    at = end + 2
                    add(self.link(inner, depth + 1))
            elif m["url"]:
                stop = text.find("]", at)
                if stop < 0 or "\n" in text[at:stop]:
                    say(m["url"])
                else:
                    node = Node("NamedURL", m["url"][1:], target=m["url"][1:])
                    node.children = self.inline(text[at:stop].strip(), depth + 1) if text[at:stop].strip() else []
                    add(node)
                    at = stop + 1
            elif m["bare"]:
                url = m["bare"].rstrip(".,;:!?)'")
                at -= len(m["bare"]) - len(url)
                add(Node("URL", url, target=url))
            elif m["quote"]:
                extra, kind = next(runs)
                say("'" * extra)
                for k in ("b", "i") if kind == "bi" and not any(n.tag == "''" for n in stack) else ("i", "b"):
                    if k in kind:
                        toggle("''" if k == "i" else "'''")
            elif m["mark"]:
                add(self.opaque(self.tags.found[int(m["mark"][5:-1])], depth + 1))
            else:
                name = m["tag"].lower()
                if name not in ALLOWED and name not in EMPTY:
                    say(m[0])
                elif m["close"]:
                    if any(n.tag == name for n in stack[1:]):
                        while stack.pop().tag != name:
                            pass
                else:
                    node = Node(TAG_CLASSES.get(name, "TagNode"), "", name, attributes(m["attrs"]))
                    if name in ("ol",):
                        node.attrs["numbered"] = "true"
                    if name == "li" and any(n.tag == "li" for n in stack) and stack[-1].tag == "li":
                        stack.pop()
                    add(node)
                    if not m["end"] and name not in EMPTY and len(stack) < DEEPEST:  # a tag beyond stays without content of its own
                        stack.append(node)
        say(text[at:])
        for n in root.walk():
            if n.level == -1:
                n.level = None
        list_orphans(root)
        return root.children

    def _runs(self, text: str, ends: dict[int, int]) -> list[int]:
        """Lengths of the runs of apostrophes outside links."""
        out, at = [], 0
        while m := _INLINE.search(text, at):
            at = m.end()
            if m["quote"]:
                out.append(len(m["quote"]))
            elif m["link"]:
                end = ends.get(at, -1)
                inner = text[at:end] if end >= 0 else ""
                if end >= 0 and inner.strip() and "\n" not in inner.split("|", 1)[0]:
                    at = end + 2
            elif m["url"]:
                stop = text.find("]", at)
                if stop >= 0 and "\n" not in text[at:stop]:
                    at = stop + 1
        return out

    @staticmethod
    def _ends(text: str) -> dict[int, int]:
        """For the inside of each link of a text where it ends; all brackets are matched at once."""
        ends, open_ = {}, []
        for m in re.finditer(r"\[\[|\]\]", text):
            if m[0] == "[[":
                open_.append(m.end())
            elif open_:
                ends[open_.pop()] = m.start()
        return ends

    def link(self, inner: str, depth: int) -> Node:
        target, bar, label = inner.partition("|")
        target = target.strip()
        colon = target.startswith(":")
        ns, _, full = titles.plain_split(target, self.lang)
        if re.match(r"https?://", target):
            return Node("NamedURL", target, target=target, children=self.inline(label or target, depth))
        cls = "ArticleLink" if ns == 0 else "ImageLink" if ns == 6 and not colon else "CategoryLink" if ns == 14 else "NamespaceLink" if ns > 0 else "SpecialLink"
        if cls == "CategoryLink" and colon:
            cls = "SpecialLink"
        if ns == 0 and ":" in target and not colon and re.match(r"[a-z]{2,3}(-[a-z]+)?:", target):
            cls = "LangLink"
        node = Node(cls, full, None, {"colon": "true"} if colon else {}, None, full, ns)
        if cls == "ImageLink":
            options = [p.strip() for p in label.split("|")] if bar else []
            for o in options:
                size = re.fullmatch(r"(\d*)(?:x(\d+))?\s*px", o)
                if size:
                    node.attrs |= {k: v for k, v in (("width", size[1]), ("height", size[2])) if v}
                elif o in ("thumb", "thumbnail", "frame", "framed", "frameless", "border", "left", "right", "center", "none", "upright"):
                    node.attrs[o] = "true"
                elif "=" in o and o.split("=")[0] in ("alt", "link", "upright"):
                    node.attrs[o.split("=")[0]] = o.split("=", 1)[1]
                else:
                    node.children = self.inline(o, depth)
        elif label:
            node.children = self.inline(label, depth)
        return node

    def opaque(self, found: dict, depth: int) -> Node:
        name, inner = found["tag"], found["inner"]
        attrs = attributes(found["attrs"])
        if name == "nowiki":
            return Node("Text", unescape(inner))
        node = Node(TAG_CLASSES.get(name, "TagNode"), "" if name in ("ref", "poem", "gallery") else inner, name, attrs)
        if name == "ref":
            node.children = self.inline(inner.strip(), depth)
        elif name == "poem":
            for i, line in enumerate(inner.strip("\n").split("\n")):
                node.children += ([Node("BreakingReturn", tag="br")] if i else []) + self.inline(line, depth)
        elif name == "gallery":
            for line in inner.split("\n"):
                if line.strip():
                    got = self.link(line.strip(), depth)
                    node.children.append(got if got.cls == "ImageLink" else Node("Text", line.strip()))
        elif name == "imagemap":
            node.attrs["entries"] = str(len(image_map(inner)))
        elif name == "pre":
            node.children = [Node("Text", unescape(inner))]
        return node

    # -- blocks ----------------------------------------------------------------------------------------------
    def parse(self, text: str) -> Node:
        root = Node("Article")
        self._nest(root, self._split_blocks(self.tags.take(text)), 0)
        return root

    def _nest(self, root: Node, blocks: Iterator[tuple[str, object]], depth: int) -> None:
        """Puts blocks into the sections that they follow, and sections into larger ones."""
        sections: list[Node] = [root]
        for kind, payload in blocks:
            if kind == "section":
                level, title = payload
                while len(sections) > 1 and (sections[-1].level or 0) >= level:
                    sections.pop()
                node = Node("Section", title, level=level)
                node.children.append(Node("Node", "caption", children=self.inline(title, depth)))
                sections[-1].children.append(node)
                sections.append(node)
            else:
                sections[-1].children += payload

    def _split_blocks(self, text: str, depth: int = 0) -> Iterator[tuple[str, object]]:
        lines = text.split("\n")
        i = 0
        while i < len(lines):
            line = lines[i]
            heading = re.fullmatch(r"(=+)(.+?)(=+)\s*", line) if line.startswith("=") else None
            if heading:
                level = min(len(heading[1]), len(heading[3]), 6)
                body = line.rstrip()
                yield "section", (level, body[level : len(body) - level].strip())
                i += 1
            elif re.match(r"\s*:*\{\|", line) and depth < 12:
                j = self._table_end(lines, i)
                yield "block", [self.table(lines[i:j], depth)]
                i = j
            elif line[:1] in ("*", "#", ":", ";") and line:
                j = i
                while j < len(lines) and lines[j][:1] in ("*", "#", ":", ";") and lines[j]:
                    j += 1
                yield "block", self.items([re.match(r"([*#:;]{1,%d})[*#:;]*\s*(.*)" % (DEEPEST // 4), x, re.S).groups() for x in lines[i:j]], 0)
                i = j
            elif line.startswith("----"):
                yield "block", [Node("HorizontalRule", tag="hr")]
                rest = line.lstrip("-")
                i += 1
                if rest.strip():
                    lines.insert(i, rest)
            elif line.startswith(" ") and line.strip() and not re.match(r"\s*<", line):
                j = i
                while j < len(lines) and lines[j].startswith(" ") and lines[j].strip():
                    j += 1
                yield "block", [Node("PreFormatted", children=self.inline("\n".join(x[1:] for x in lines[i:j])))]
                i = j
            elif not line.strip():
                i += 1
            else:
                j = i
                while j < len(lines) and lines[j].strip() and not (j > i and (re.match(r"(=+.*=+\s*$|[*#:;]|----|\s*:*\{\|)", lines[j]))):
                    j += 1
                nodes = self.inline("\n".join(lines[i:j]))
                block = all(n.cls in BLOCKS or (n.cls == "Text" and not n.caption.strip()) for n in nodes) and nodes
                yield "block", nodes if block else [Node("Paragraph", children=nodes)]
                i = j

    def blocks(self, text: str, depth: int) -> list[Node]:
        root = Node("Node")
        self._nest(root, self._split_blocks(text, depth), depth)
        return root.children

    def items(self, rows: list[tuple[str, str]], at: int) -> list[Node]:
        """Nested lists out of (prefix, text); ``at`` is how much of the prefixes the surrounding lists have used."""
        out: list[Node] = []
        i = 0
        while i < len(rows):
            mark = rows[i][0][at]
            group = "dl" if mark in ";:" else mark
            j = i
            while j < len(rows) and len(rows[j][0]) > at and ("dl" if rows[j][0][at] in ";:" else rows[j][0][at]) == group:
                j += 1
            node = Node("DefinitionList" if group == "dl" else "ItemList", tag={"*": "ul", "#": "ol"}.get(group, "dl"), attrs={"numbered": "true"} if group == "#" else {})
            k = i
            while k < j:
                prefix, text = rows[k]
                own = Node("Item" if group != "dl" else "DefinitionTerm" if prefix[at] == ";" else "DefinitionDescription", tag="li" if group != "dl" else "dt" if prefix[at] == ";" else "dd")
                if len(prefix) == at + 1:
                    term, colon, rest = self._term(text) if own.cls == "DefinitionTerm" else (text, "", "")
                    own.children = self.inline(term)
                    k += 1
                    node.children.append(own)
                    if colon:
                        own = Node("DefinitionDescription", tag="dd", children=self.inline(rest.strip()))
                        node.children.append(own)
                else:
                    node.children.append(own)
                deeper = k
                while deeper < j and len(rows[deeper][0]) > at + 1:
                    deeper += 1
                if deeper > k:
                    own.children += self.items(rows[k:deeper], at + 1)
                    k = deeper
            out.append(node)
            i = j
        return out

    @staticmethod
    def _term(text: str) -> tuple[str, str, str]:
        depth = 0
        for m in re.finditer(r"\[\[|\]\]|\[|\]|://|:", text):
            depth += {"[[": 1, "]]": -1, "[": 1, "]": -1}.get(m[0], 0)
            if m[0] == ":" and depth <= 0:
                return text[: m.start()].strip(), ":", text[m.end() :]
        return text, "", ""

    @staticmethod
    def _table_end(lines: list[str], i: int) -> int:
        depth = 0
        for j in range(i, len(lines)):
            if re.match(r"\s*:*\{\|", lines[j]):
                depth += 1
            elif re.match(r"\s*\|\}", lines[j]):
                depth -= 1
                if not depth:
                    return j + 1
        return len(lines)

    def table(self, lines: list[str], depth: int) -> Node:
        table = Node("Table", tag="table", attrs=attributes(re.sub(r"^\s*:*\{\|", "", lines[0])))
        row: Node | None = None
        cell: list[str] | None = None
        own: Node | None = None

        def close() -> None:
            nonlocal cell, own
            if own is not None and cell is not None:
                text = "\n".join(cell)
                own.children = self.blocks(text, depth + 1) if "\n" in text.strip() or re.match(r"\s*(\{\||[*#:;])", text) else self.inline(text.strip())
            cell = own = None

        i, stop = 1, len(lines) - (1 if re.match(r"\s*\|\}", lines[-1]) else 0)
        while i < stop:
            line = lines[i]
            bare = line.strip()
            if re.match(r"\s*:*\{\|", line):
                j = self._table_end(lines, i)
                if cell is not None:
                    cell += lines[i:j]
                i = j
                continue
            if bare.startswith("|-"):
                close()
                row = Node("Row", tag="tr", attrs=attributes(bare[2:]))
                table.children.append(row)
            elif bare.startswith("|+"):
                close()
                own = Node("TableCaption", tag="caption")
                table.children.append(own)
                cell = [bare[2:].strip()]
            elif bare.startswith(("|", "!")) and not bare.startswith("|}"):
                close()
                if row is None:
                    row = Node("Row", tag="tr")
                    table.children.append(row)
                head = bare[0] == "!"
                for part in re.split(r"\|\||!!" if head else r"\|\|", bare[1:]):
                    close()
                    modifier = re.match(r"([^|\[\]{}]*)\|(?!\|)(.*)", part, re.S)
                    own = Node("Cell", tag="th" if head else "td", attrs=attributes(modifier[1]) if modifier else {})
                    row.children.append(own)
                    cell = [modifier[2] if modifier else part]
            elif cell is not None:
                cell.append(line)
            i += 1
        close()
        table.children = [c for c in table.children if c.cls != "Row" or c.children]
        return table


def image_map(text: str) -> list[tuple[str, str, list[int]]]:
    """Entries of an image map: (kind, caption, coordinates); blank lines and comments are none."""
    out = []
    for line in text.strip().split("\n")[1:]:
        m = re.match(r"\s*(poly|rect|circle|default|desc)\b\s*([\d\s]*)(.*)", line)
        if m:
            out.append((m[1], m[3].strip(), [int(x) for x in m[2].split()]))
    return out


def parse(text: str, lang: str = "en") -> Node:
    return Parser(lang).parse(text.replace("\uebad", ""))


def parsed(text: str, lang: str = "en", cleaner=None) -> Node:
    """A text's tree whatever it holds: where parsing or cleaning fails, the text as it is, and why in the root's attributes."""
    try:
        tree = parse(text, lang)
        if cleaner is not None:
            cleaner(tree)
        return tree
    except (RecursionError, ValueError, LookupError, AttributeError, OverflowError, TypeError) as error:
        return Node("Article", attrs={"failed": f"{type(error).__name__}: {error}"[:200]}, children=[Node("Text", text)])


def numbered(root: Node) -> list[dict]:
    """Rows of a tree in pre-order."""
    rows: list[dict] = []
    stack: list[tuple[Node, int, int, int]] = [(root, -1, 0, 0)]
    while stack:
        node, parent, depth, place = stack.pop()
        number = len(rows)
        rows.append({"node_id": number, "parent": None if parent < 0 else parent, "post": number, "depth": depth, "ord": place, "class": node.cls, "caption": node.caption, "tag": node.tag, "attrs": list(node.attrs.items()), "level": node.level, "target": node.target, "ns": node.ns})
        stack += [(c, number, depth + 1, k) for k, c in reversed(list(enumerate(node.children)))]
    for row in reversed(rows):
        if row["parent"] is not None:
            rows[row["parent"]]["post"] = max(rows[row["parent"]]["post"], row["post"])
    return rows


NODES = "doc_id string, node_id int, parent int, post int, depth int, ord int, class string, caption string, tag string, attrs map<string,string>, level int, target string, ns int"
_ARROW = pa.schema([("doc_id", pa.string()), *((n, pa.int32()) for n in ("node_id", "parent", "post", "depth", "ord")), ("class", pa.string()), ("caption", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("level", pa.int32()), ("target", pa.string()), ("ns", pa.int32())])


def parse_pages(pages: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "en", cleaner=None, columns: list[str] | None = None) -> DataFrame:
    """Node rows of a table of texts; ``cleaner`` may change each tree before it is numbered, ``columns`` names those wanted besides the key.

    Parsing costs far more than reading, so a table of few partitions is dealt out first. A text that can't be parsed is one
    text below a root that says why (attribute ``failed``)."""
    wanted = _ARROW.names if columns is None else ["doc_id", *columns]
    schema = pa.schema([_ARROW.field(n) for n in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in wanted}
        for batch in batches:
            for key_, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = numbered(parsed(raw or "", lang, cleaner))
                held["doc_id"] += [key_] * len(rows)
                for n in wanted[1:] if wanted[0] == "doc_id" else wanted:
                    held[n] += [r[n] for r in rows]
                if len(held["doc_id"]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[n], schema.field(n).type) for n in wanted], schema=schema)
                    held = {n: [] for n in wanted}
        yield pa.RecordBatch.from_arrays([pa.array(held[n], schema.field(n).type) for n in wanted], schema=schema)

    rows = pages.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    types = dict(c.split(" ", 1) for c in NODES.split(", "))
    return dealt(rows).mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in wanted))
