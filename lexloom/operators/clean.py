"""Cleaning of document trees: an ordered list of steps over one tree, applied to whole tables by the parser's Arrow stage.

Every step is a function of the tree; :func:`cleaner` runs those of ``STEPS`` in order, some of them again later, as later steps make room for
earlier ones. A step that fails leaves its tree as it is and is noted in the root's attributes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt
from .wikitext import BLOCKS, Node, parsed

#: Classes that may be without children, class names that aren't shown, headings that aren't kept.
CHILDLESS_OK = {"Text", "BreakingReturn", "HorizontalRule", "ImageLink", "ArticleLink", "NamespaceLink", "SpecialLink", "CategoryLink", "LangLink", "URL", "NamedURL", "Cell", "Math", "Timeline", "Source", "ImageMap", "Reference", "ReferenceList", "TagNode", "Article", "Node"}
NO_DISPLAY = {"noprint", "metadata", "navbox", "dablink", "hatnote", "editlink", "portal", "sisterproject", "NavFrame"}
SEE_ALSO = {"see also", "siehe auch", "voir aussi", "véase también"}
FORBIDDEN = {"ItemList": {"Paragraph"}, "Table": {"Paragraph"}, "Section": {"Paragraph", "Item"}, "PreFormatted": {"Paragraph"}, "Paragraph": {"Paragraph"}, "Div": {"Paragraph"}}
STYLES = {"Strong", "Emphasized", "Underline", "Strike", "Sub", "Sup", "Small", "Big", "Cite", "Var", "Teletyped", "Font", "Span"}
INVALID_FILES = (".ogg", ".oga", ".ogv", ".webm", ".mid")


def _map(node: Node, change: Callable[[Node, Node], list[Node] | None]) -> None:
    """Replaces children from below; ``change(node, parent)`` gives the replacement or None."""
    for parent in reversed(list(node.walk())):  # a node comes behind its ancestors in pre-order
        out: list[Node] = []
        for child in parent.children:
            new = change(child, parent)
            out += [child] if new is None else new
        parent.children = out


def _classes(n: Node) -> set[str]:
    return set(n.attrs.get("class", "").split())


def _style(n: Node) -> dict[str, str]:
    pairs = (p.split(":", 1) for p in n.attrs.get("style", "").split(";") if ":" in p)
    return {k.strip().lower(): v.strip().lower() for k, v in pairs}


def lower_attributes(root):
    for n in root.walk():
        n.attrs = {**{k.lower(): v for k, v in n.attrs.items()}, **n.attrs}


def mark_infoboxes(root):
    boxes = [n for n in root.walk() if n.cls == "Table" and (_classes(n) & {"infobox", "taxobox"} or n.attrs.get("id") in ("infobox", "taxobox"))]
    if not boxes:
        before = 0
        for n in root.walk():
            if n.cls == "Text":
                before += len(n.caption.strip())
            elif n.cls == "Table":
                boxes = [n] if before <= 200 else []
                break
    for n in boxes:
        n.attrs["isInfobox"] = "true"


def remove_edit_links(root):
    _map(root, lambda n, p: [] if n.cls == "NamedURL" and (n.target or "").endswith("?action=edit") else None)


def remove_empty_texts(root):
    def change(n, p):
        if n.cls != "Text" or n.caption.strip() or p.cls == "PreFormatted":
            return None
        i = next(k for k, c in enumerate(p.children) if c is n)
        around = [p.children[k].cls in BLOCKS for k in (i - 1, i + 1) if 0 <= k < len(p.children)]
        return [] if not n.caption or (around and all(around)) else None

    _map(root, change)


def remove_invisible_links(root):
    _map(root, lambda n, p: [] if n.cls in ("CategoryLink", "LangLink") and "colon" not in n.attrs else None)


def clean_section_captions(root):
    for n in root.find("Section"):
        if n.children and n.children[0].cls == "Node":
            _map(n.children[0], lambda c, p: c.children if c.cls in BLOCKS else None)
            if not n.children[0].children:
                n.children[0].children = [Node("BreakingReturn", tag="br")]


def remove_childless(root):
    _map(root, lambda n, p: [] if not n.children and n.cls not in CHILDLESS_OK else None)


def remove_no_print(root):
    def change(n, p):
        style = _style(n)
        if _classes(n) & NO_DISPLAY or style.get("display") == "none" or style.get("visibility") == "hidden":
            return [r for r in n.find("Reference") if r.attrs.get("name")]
        return None

    _map(root, change)


def unwrap_list_paragraphs(root):
    _map(root, lambda n, p: n.children if n.cls == "Paragraph" and n.children and all(c.cls == "ItemList" for c in n.children) else None)


def remove_invalid_files(root):
    _map(root, lambda n, p: [] if n.cls == "ImageLink" and (n.target or "").lower().endswith(INVALID_FILES) else None)


def simplify_blocks(root):
    _map(root, lambda n, p: n.children if n.cls == "Paragraph" and len(n.children) == 1 and n.children[0].cls in BLOCKS else None)


def remove_absolute(root):
    def inside(n, positioned):
        for c in list(n.children):
            mine = _style(c).get("position") in ("absolute", "relative")
            if mine and positioned:
                n.children = [x for x in n.children if x is not c]
            else:
                inside(c, positioned or mine)

    inside(root, False)


def remove_scrolling(root):
    def change(n, p):
        style = _style(n)
        if style.get("overflow") == "auto" or style.get("overflow-y") == "auto":
            height = "".join(ch for ch in style.get("height", "") if ch.isdigit() or ch == ".")
            if height and float(height) * (0.75 if "px" in style["height"] else 9.6 if "em" in style["height"] else 1) > 100:
                return n.children
        return None

    _map(root, change)


def _outermost(root, cls):
    out, stack = [], [(root, None)]
    while stack:
        n, p = stack.pop()
        if n.cls == cls:
            out.append((n, p))
        else:
            stack += [(c, n) for c in n.children]
    return out


def move_galleries(root):
    for table, parent in _outermost(root, "Table"):
        found = table.find("Gallery")
        if found and parent is not None:
            _map(table, lambda n, p: [] if n.cls == "Gallery" else None)
            at = next(k for k, c in enumerate(parent.children) if c is table)
            parent.children[at + 1 : at + 1] = found


def remove_train_templates(root):
    _map(root, lambda n, p: [] if n.cls == "Table" and any((i.target or "").startswith("File:BSicon") for i in n.find("ImageLink")) else None)


def fix_nesting(root):
    """A block that may not stand in a paragraph cuts it: what comes before and behind become paragraphs of their own."""

    def change(n, p):
        if n.cls != "Paragraph" or not any(c.cls in FORBIDDEN and "Paragraph" in FORBIDDEN[c.cls] for c in n.children):
            return None
        out, run = [], []
        for c in n.children:
            if c.cls in FORBIDDEN and "Paragraph" in FORBIDDEN[c.cls]:
                out += [Node("Paragraph", children=run)] if run else []
                out.append(c)
                run = []
            else:
                run.append(c)
        return out + ([Node("Paragraph", children=run)] if run else [])

    _map(root, change)


def unwrap_critical_tables(root):
    _map(root, lambda n, p: [Node("Div", children=c.children) for r in n.children for c in r.children] if n.cls == "Table" and "navbox" in _classes(n) else None)


def remove_textless_styles(root):
    _map(root, lambda n, p: ([c for c in n.children if c.cls != "Text"]) if n.cls in STYLES and not n.text().strip() else None)


def remove_broken_children(root):
    _map(root, lambda n, p: [] if n.cls == "Table" and p.cls == "ImageLink" else None)
    for n in root.find("PreFormatted"):
        _map(n, lambda c, p: c.children if c.cls in ("Paragraph", "Div", "ItemList", "Item", "Table", "Row", "Cell") else None)


def _span(cell, name="colspan"):
    v = cell.attrs.get(name, "1").strip()
    return max(1, int(v)) if v.isdigit() else 1


def fix_colspans(root):
    for t in root.find("Table"):
        rows = [r for r in t.children if r.cls == "Row"]
        widths = [sum(_span(c) for c in r.children) for r in rows if len(r.children) > 1]
        most = max(widths, default=1)
        for r in rows:
            if len(r.children) == 1 and _span(r.children[0]) > most:
                r.children[0].attrs["colspan"] = str(most)
        if len(rows) == 1:
            while rows[0].children and not rows[0].children[-1].text().strip() and not rows[0].children[-1].find("ImageLink"):
                rows[0].children.pop()


def remove_trailing_rows(root):
    for t in root.find("Table"):
        while t.children and t.children[-1].cls == "Row" and not t.children[-1].text().strip() and not t.children[-1].find("ImageLink"):
            t.children.pop()


def split_list_rows(root, most: int = 5):
    for t in root.find("Table"):
        out = []
        for r in t.children:
            lists = [c.children[0] for c in r.children if c.cls == "Cell" and len(c.children) == 1 and c.children[0].cls == "ItemList"]
            if r.cls == "Row" and lists and len(lists) == len(r.children) and max(len(x.children) for x in lists) > most:
                for k in range(max(len(x.children) for x in lists)):
                    out.append(Node("Row", tag="tr", attrs=r.attrs, children=[Node("Cell", tag="td", attrs=c.attrs, children=[Node("ItemList", tag=x.tag, attrs=x.attrs, children=x.children[k : k + 1])] if k < len(x.children) else []) for c, x in zip(r.children, lists, strict=True)]))
            else:
                out.append(r)
        t.children = out


def single_column_tables(root, rows: int = 30, characters: int = 2000):
    def change(n, p):
        body = [r for r in n.children if r.cls == "Row"]
        if n.cls == "Table" and body and all(len(r.children) == 1 for r in body) and (len(body) > rows or len(n.text()) > characters):
            return [Node("Div", children=r.children[0].children) for r in body]
        return None

    _map(root, change)


def tables_to_columns(root, height: int = 5000):
    """Tables with very tall cells, and those of pages' fronts, are written column by column."""

    def change(n, p):
        body = [r for r in n.children if r.cls == "Row"]
        if n.cls == "Table" and body and ("mp-upper" == n.attrs.get("id") or any(len(c.text()) > height for r in body for c in r.children)):
            width = max(len(r.children) for r in body)
            return [Node("Div", children=r.children[k].children) for k in range(width) for r in body if k < len(r.children)]
        return None

    _map(root, change)


def linearize_wide(root, columns: int = 15):
    def change(n, p):
        width = max((sum(_span(c) for c in r.children) for r in n.children if r.cls == "Row"), default=0)
        if n.cls == "Table" and p.cls == "Cell" and width > columns:
            return [Node("Div", children=c.children) for r in n.children for c in r.children]
        return None

    _map(root, change)


def remove_breaks(root):
    for n in root.walk():
        if n.cls in BLOCKS or n.cls == "Article":
            kids = n.children
            while kids and kids[0].cls == "BreakingReturn":
                kids.pop(0)
            while kids and kids[-1].cls == "BreakingReturn":
                kids.pop()
            n.children = [c for k, c in enumerate(kids) if not (c.cls == "BreakingReturn" and k and (kids[k - 1].cls == "BreakingReturn" or kids[k - 1].cls in BLOCKS))]


def remove_empty_reference_lists(root):
    if not root.find("Reference"):
        _map(root, lambda n, p: [] if n.cls == "ReferenceList" else None)
        _map(root, lambda n, p: [] if n.cls == "Section" and len(n.children) <= 1 and not n.children[1:] and n.caption.lower() in ("references", "einzelnachweise", "notes") else None)


def swap_nodes(root):
    def change(n, p):
        if n.cls in ("Underline", "Emphasized") and len(n.children) == 1 and n.children[0].cls == "Center":
            center = n.children[0]
            n.children = center.children
            center.children = [n]
            return [center]
        return None

    _map(root, change)


def remove_big_sections_from_cells(root, characters: int = 2000):
    for c in root.find("Cell"):
        _map(c, lambda n, p: n.children[1:] if n.cls == "Section" and len(n.text()) > characters else None)


def unwrap_container_tables(root):
    """A table whose only content is another table gives way to it."""

    def change(n, p):
        if n.cls == "Table":
            content = [x for r in n.children for c in r.children for x in c.children if not (x.cls == "Text" and not x.caption.strip())]
            if len(content) == 1 and content[0].cls == "Table":
                return [content[0]]
        return None

    _map(root, change)


def split_big_cells(root, characters: int = 3000):
    for t in root.find("Table"):
        out = []
        for r in t.children:
            if r.cls == "Row" and len(r.children) == 1 and len(r.children[0].children) > 1 and len(r.children[0].text()) > characters:
                cell = r.children[0]
                out += [Node("Row", tag="tr", attrs=r.attrs, children=[Node("Cell", tag=cell.tag, attrs=cell.attrs, children=[x])]) for x in cell.children]
            else:
                out.append(r)
        t.children = out


def limit_captions(root, characters: int = 500):
    for n in root.find("ImageLink"):
        if len(n.text()) > characters:
            _map(n, lambda c, p: [] if c.cls == "BreakingReturn" else None)


def remove_repeated_links(root):
    for r in root.find("Reference"):
        seen: set[str] = set()

        def change(n, p, seen=seen):
            if n.cls in ("NamedURL", "URL"):
                if n.caption in seen:
                    return []
                seen.add(n.caption)
            return None

        _map(r, change)


def fix_lists(root):
    for n in root.find("ItemList"):
        n.children = [c if c.cls == "Item" else Node("Item", tag="li", children=[c]) for c in n.children if not (c.cls == "Text" and not c.caption.strip())]


def fix_sub_sup(root, characters: int = 200):
    _map(root, lambda n, p: n.children if n.cls in ("Sub", "Sup") and len(n.text()) > characters else None)


def unwrap_leading_paragraphs(root):
    for n in root.walk():
        if n.cls in ("Item", "Reference") and n.children and n.children[0].cls == "Paragraph":
            n.children[0:1] = n.children[0].children


def fold_newlines(root):
    def inside(n):
        for c in n.children:
            if c.cls == "Text":
                c.caption = c.caption.replace("\n", " ")
            elif c.cls not in ("PreFormatted", "Source"):
                inside(c)

    inside(root)


def remove_see_also(root):
    _map(root, lambda n, p: [] if n.cls == "Section" and n.caption.strip().lower() in SEE_ALSO else None)


def build_definition_lists(root):
    for n in root.walk():
        if n.cls == "DefinitionList":
            continue
        out: list[Node] = []
        for c in n.children:
            if c.cls in ("DefinitionTerm", "DefinitionDescription"):
                if not (out and out[-1].cls == "DefinitionList" and out[-1].level == -2):
                    out.append(Node("DefinitionList", tag="dl", level=-2))
                out[-1].children.append(c)
            else:
                out.append(c)
        n.children = out
    for n in root.find("DefinitionList"):
        n.level = None


def restrict_children(root):
    for n in root.find("Gallery"):
        n.children = [c for c in n.children if c.cls == "ImageLink"]


def fix_references(root):
    """Empty references to a name take what its first full one says; those of a character or less go."""
    full: dict[str, Node] = {}
    for r in root.find("Reference"):
        name = r.attrs.get("name")
        if name and r.text().strip():
            full.setdefault(name, r)
    for r in root.find("Reference"):
        name = r.attrs.get("name")
        if name and not r.text().strip() and name in full:
            r.children = [Node(c.cls, c.caption, c.tag, dict(c.attrs), c.level, c.target, c.ns, c.children) for c in full[name].children]
    _map(root, lambda n, p: [] if n.cls == "Reference" and len(n.text().strip()) <= 1 and not any(c.cls in ("URL", "NamedURL") for c in n.walk()) else None)


def mark_math(root):
    for n in root.walk():
        if n.cls in ("Item", "Paragraph", "DefinitionDescription") and [c.cls for c in n.children] == ["Math"]:
            n.attrs["dir"] = "ltr"


def fix_preformatted(root):
    for n in root.find("PreFormatted"):
        out: list[Node] = []
        for c in n.children:
            if c.cls == "Text" and "\n" in c.caption:
                for k, line in enumerate(c.caption.split("\n")):
                    out += ([Node("BreakingReturn", tag="br")] if k else []) + [Node("Text", line)]
            else:
                out.append(c)
        n.children = out


def fix_list_nesting(root):
    def change(n, p):
        if n.cls == "ItemList" and len(n.children) == 1 and [c.cls for c in n.children[0].children] == ["ItemList"]:
            return [Node("DefinitionDescription", tag="dd", children=n.children[0].children)]
        return None

    _map(root, change)


def only_in_print(root):
    _map(root, lambda n, p: [] if "printonly" in _classes(n) and any(c.cls.endswith("Link") or c.cls in ("URL", "NamedURL") for c in n.walk()) else None)


def remove_empty_sections(root):
    def change(n, p):
        if n.cls == "Section":
            rest = n.children[1:]
            if not any(c.text().strip() or any(x.cls in ("ImageLink", "Gallery", "Timeline", "Math") for x in c.walk()) for c in rest):
                return []
        return None

    _map(root, change)


def mark_short_paragraphs(root, characters: int = 80):
    def inside(n, in_table):
        for c in n.children:
            if c.cls == "Paragraph" and not in_table and len(c.text()) < characters and not any(x.cls in BLOCKS for x in c.children):
                c.attrs["short"] = "true"
            inside(c, in_table or c.cls == "Table")

    inside(root, False)


def move_paragraphs(root):
    """A paragraph behind a section goes to the end of that section's last subsection, or of the section itself."""
    for n in list(root.walk()):
        out: list[Node] = []
        for c in n.children:
            if c.cls == "Paragraph" and out and out[-1].cls == "Section":
                into = out[-1]
                while into.children and into.children[-1].cls == "Section":
                    into = into.children[-1]
                into.children.append(c)
            else:
                out.append(c)
        n.children = out


def merge_region_tables(root):
    """All rows of a list of regions stand in one table."""
    for n in root.find("Div"):
        if n.attrs.get("id") == "region_list":
            rows = n.find("Row")
            n.children = [c for c in n.children if c.cls != "Table"] + ([Node("Table", tag="table", children=rows)] if rows else [])


def unnest_last_cells(root, rows: int = 20):
    """What a table's last cell holds comes behind the table, if the cell has a row of its own, is as wide as the table and holds a long table."""

    def change(n, p):
        body = [r for r in n.children if r.cls == "Row"]
        if n.cls != "Table" or not body or len(body[-1].children) != 1:
            return None
        cell, width = body[-1].children[0], max(sum(_span(c) for c in r.children) for r in body)
        if _span(cell) != width or not any(t.cls == "Table" and len(t.children) > rows for t in cell.walk()):
            return None
        moved = Node("Div", tag="div", attrs=dict(cell.attrs), children=cell.children)
        cell.children = []
        return [n, moved]

    for table, parent in _outermost(root, "Table"):
        if parent is not None:
            parent.children = [x for c in parent.children for x in ((change(c, parent) or [c]) if c is table else [c])]


def remove_boilerplate(root):
    _map(root, lambda n, p: [] if n.cls == "Div" and any("boilerplate" in c for c in _classes(n)) else None)


def merge_texts(root):
    for n in root.walk():
        out: list[Node] = []
        for c in n.children:
            if c.cls == "Text" and out and out[-1].cls == "Text":
                out[-1] = Node("Text", out[-1].caption + c.caption)
            else:
                out.append(c)
        n.children = out


STEPS: list[Callable[[Node], None]] = [
    remove_boilerplate, merge_texts, lower_attributes, mark_infoboxes, remove_edit_links, remove_empty_texts, remove_invisible_links, clean_section_captions, remove_childless, remove_no_print,
    unwrap_list_paragraphs, remove_invalid_files, move_paragraphs, simplify_blocks, remove_absolute, remove_scrolling, move_galleries, merge_region_tables, remove_train_templates, fix_nesting, remove_childless,
    unnest_last_cells, unwrap_critical_tables, remove_textless_styles, remove_broken_children, fix_colspans, remove_trailing_rows, split_list_rows, single_column_tables, tables_to_columns, linearize_wide,
    remove_breaks, remove_empty_reference_lists, swap_nodes, remove_big_sections_from_cells, unwrap_container_tables, split_big_cells, limit_captions, remove_repeated_links, fix_lists, fix_sub_sup,
    unwrap_leading_paragraphs, remove_childless, fold_newlines, remove_breaks, remove_see_also, build_definition_lists, restrict_children, fix_references, remove_broken_children, mark_math,
    fix_nesting, fix_preformatted, fix_list_nesting, only_in_print, remove_empty_texts, remove_childless, remove_breaks, remove_empty_sections, mark_short_paragraphs,
]


def clean(root: Node, steps: list[Callable[[Node], None]] | None = None, skip: set[str] = frozenset()) -> Node:
    for step in STEPS if steps is None else steps:
        if step.__name__ in skip:
            continue
        try:
            step(root)
        except Exception as error:  # one document's step, not the table's
            root.attrs["failed"] = (root.attrs.get("failed", "") + f" {step.__name__}: {error}").strip()
    return root


# -- measuring -------------------------------------------------------------------------------------------------------------
def counted(root: Node, selector: str) -> int:
    """Nodes of a class (``Class``), those of it with an attribute (``Class@name``), all nodes (``*``), or characters of text (``#``)."""
    if selector == "#":
        return len(root.text())
    cls, _, name = selector.partition("@")
    return sum((cls == "*" or n.cls == cls) and (not name or name in n.attrs) for n in root.walk())


def effects(docs: DataFrame, cases: dict[str, tuple[str, str]]) -> DataFrame:
    """(doc_id, case, before, after): what a selector counts in a text's tree before and after one step. docs: (doc_id, case, text); cases: case -> (step, selector)."""
    steps = {f.__name__: f for f in STEPS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after = [], []
            for case, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                name, selector = cases[case]
                tree = parsed(text or "")
                before.append(counted(tree, selector))
                after.append(counted(clean(tree, [steps[name]]), selector))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.int64()), pa.array(after, pa.int64())], ["doc_id", "case", "before", "after"])

    return dealt(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "case", "text")).mapInArrow(run, "doc_id string, case string, before long, after long")
