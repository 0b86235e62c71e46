"""One case for each cleaning step: markup that repeats a unit k times, what is counted, and the counts before and after as SQL over k."""

from __future__ import annotations

#: case -> (step, selector, start, unit, end, before, after); the unit stands k times.
CASES: dict[str, tuple[str, str, str, str, str, str, str]] = {
    "boilerplate": ("remove_boilerplate", "Div", "<div>kept</div>\n\n", '<div class="boilerplate seal">gone</div>\n\n', "", "k + 1", "1"),
    "infobox": ("mark_infoboxes", "Table@isInfobox", "", '{| class="infobox"\n| a\n|}\n\n', "{|\n| plain\n|}", "0", "k"),
    "first table": ("mark_infoboxes", "Table@isInfobox", "short text\n\n", "{|\n| a\n|}\n\n", "", "0", "1"),
    "edit links": ("remove_edit_links", "NamedURL", "[http://w/index?title=x show] ", "[http://w/index?action=edit edit] ", "", "k + 1", "1"),
    "empty texts": ("remove_empty_texts", "Text", "", "<div>a</div> ", "", "2 * k", "k"),
    "categories": ("remove_invisible_links", "CategoryLink", "", "[[Category:C]] ", "[[:Category:C]]", "k", "0"),
    "captions": ("clean_section_captions", "Div", "", "== <div>a</div> ==\nx\n", "", "k", "0"),
    "childless": ("remove_childless", "Strong", "", "<b></b> ", "<b>x</b>", "k + 1", "1"),
    "no print": ("remove_no_print", "Div", "", '<div class="noprint">a</div>\n\n', '<div style="display: none">b</div>', "k + 1", "0"),
    "named notes stay": ("remove_no_print", "Reference", '<div class="noprint">', '<ref name="n">a</ref><ref>b</ref>', "</div>", "2 * k", "k"),
    "invalid files": ("remove_invalid_files", "ImageLink", "[[File:a.png]] ", "[[File:a.ogg]] ", "", "k + 1", "1"),
    "paragraphs after sections": ("move_paragraphs", "Section", "", "== a ==\nb\n\n", "", "k", "k"),
    "simple blocks": ("simplify_blocks", "Paragraph", "", "a\n\n", "", "k", "k"),
    "absolute": ("remove_absolute", "Div", '<div style="position: relative">', '<div style="position: absolute">a</div>', "</div>", "k + 1", "1"),
    "scrolling": ("remove_scrolling", "Div", "", '<div style="overflow: auto; height: 900px">a</div>\n\n', '<div style="overflow: auto; height: 20px">a</div>', "k + 1", "1"),
    "galleries": ("move_galleries", "Gallery", "{|\n| ", "<gallery>\nFile:a.png\n</gallery> ", "\n|}", "k", "k"),
    "region lists": ("merge_region_tables", "Table", '<div id="region_list">\n', "<table><tr><td>a</td></tr></table>\n", "</div>", "k", "1"),
    "train tables": ("remove_train_templates", "Table", "", "{|\n| [[File:BSicon_BHF.svg]]\n|}\n\n", "{|\n| a\n|}", "k + 1", "1"),
    "blocks in paragraphs": ("fix_nesting", "Paragraph", "", "a<div>b</div>c\n\n", "", "k", "2 * k"),
    "critical tables": ("unwrap_critical_tables", "Table", "", '{| class="navbox"\n| a || b\n|}\n\n', "{|\n| a\n|}", "k + 1", "1"),
    "textless styles": ("remove_textless_styles", "Strong", "", "<b> </b>x", "<b>y</b>", "k + 1", "1"),
    "broken preformatted": ("remove_broken_children", "Div", "", " a<div>b</div>\n\n", "", "k", "0"),
    "wide spans": ("fix_colspans", "Cell@colspan", "{|\n|-\n| a || b\n", '|-\n| colspan="9" | c\n', "|}", "k", "k"),
    "trailing rows": ("remove_trailing_rows", "Row", "{|\n|-\n| a\n", "|-\n| \n", "|}", "k + 1", "1"),
    "tall tables": ("single_column_tables", "Table", "", "{|\n" + "|-\n| a\n" * 31 + "|}\n\n", "{|\n| a\n|}", "k + 1", "1"),
    "front pages": ("tables_to_columns", "Table", "", '{| id="mp-upper"\n| a || b\n|}\n\n', "", "k", "0"),
    "breaks": ("remove_breaks", "BreakingReturn", "a", "<br/>", "b", "k", "1"),
    "empty note lists": ("remove_empty_reference_lists", "ReferenceList", "", "<references/> ", "", "k", "0"),
    "centred styles": ("swap_nodes", "Center", "", "<u><center>a</center></u> ", "", "k", "k"),
    "repeated links": ("remove_repeated_links", "NamedURL", "<ref>", "[http://a b] ", "</ref>", "k", "1"),
    "long indexes": ("fix_sub_sup", "Sub", "", "<sub>" + "x" * 201 + "</sub> ", "<sub>1</sub>", "k + 1", "1"),
    "newlines": ("fold_newlines", "#", "a", "\nb", "", "1 + 2 * k", "1 + 2 * k"),
    "see also": ("remove_see_also", "Section", "== a ==\nx\n", "== See also ==\n* [[y]]\n", "", "k + 1", "1"),
    "definitions": ("build_definition_lists", "DefinitionList", "<div>", "<dt>a</dt><dd>b</dd>", "</div>", "0", "1"),
    "gallery children": ("restrict_children", "Text", "<gallery>\n", "only text\n", "File:a.png\n</gallery>", "k", "0"),
    "short notes": ("fix_references", "Reference", "", "<ref>x</ref>", "<ref>long enough</ref>", "k + 1", "1"),
    "repeated notes": ("fix_references", "#", '<ref name="n">abc</ref>', '<ref name="n"/>', "", "3", "3 + 3 * k"),
    "formulas": ("mark_math", "Paragraph@dir", "", "<math>a</math>\n\n", "text <math>a</math>", "0", "k"),
    "preformatted lines": ("fix_preformatted", "BreakingReturn", "", " a\n", " b", "0", "k"),
    "list in list": ("fix_list_nesting", "ItemList", "", "** a\n", "", "2", "1"),
    "print only": ("only_in_print", "Div", "", '<div class="printonly">[http://a b]</div>\n\n', '<div class="printonly">text</div>', "k + 1", "1"),
    "empty sections": ("remove_empty_sections", "Section", "== a ==\nx\n", "== b ==\n", "", "k + 1", "1"),
    "short paragraphs": ("mark_short_paragraphs", "Paragraph@short", "", "a short one\n\n", "a long one " + "x" * 90, "0", "k"),
    "items": ("unwrap_leading_paragraphs", "Item", "", "* a\n", "", "k", "k"),
    "lists of text": ("fix_lists", "Item", "<ul>", "a<li>b</li>", "</ul>", "k", "2 * k"),
    "container tables": ("unwrap_container_tables", "Table", "", "<table><tr><td><table><tr><td>a</td><td>b</td></tr></table></td></tr></table>\n\n", "", "2 * k", "k"),
    "wide nested tables": ("linearize_wide", "Table", "", "<table><tr><td>x<table><tr>" + "<td>a</td>" * 16 + "</tr></table></td></tr></table>\n\n", "", "2 * k", "k"),
    "long captions": ("limit_captions", "BreakingReturn", "", "[[File:a.png|" + "x" * 501 + "<br/>y]] ", "", "k", "0"),
    "sections in cells": ("remove_big_sections_from_cells", "Section", "", "{|\n|\n== a ==\n" + "x" * 2001 + "\n|}\n\n", "", "k", "0"),
    "long lists in rows": ("split_list_rows", "Row", "", "{|\n|-\n|\n* a\n* a\n* a\n* a\n* a\n* a\n|}\n\n", "", "k", "6 * k"),
    "big cells": ("split_big_cells", "Row", "", "{|\n|-\n|\n" + "x" * 3001 + "\n\ny\n|}\n\n", "", "k", "2 * k"),
    "ending cells": ("unnest_last_cells", "Div", "", "<table><tr><td>x</td></tr><tr><td><table>" + "<tr><td>a</td></tr>" * 21 + "</table></td></tr></table>\n\n", "", "0", "k"),
    "merged texts": ("merge_texts", "Text", "", "a <!-- c --> ", "", "1", "1"),
    "attributes": ("lower_attributes", "Div@class", "", '<div CLASS="x">a</div>\n\n', "", "k", "k"),
    "lists in paragraphs": ("unwrap_list_paragraphs", "Paragraph", "", "<ul><li>a</li></ul>\n\n", "text", "1", "1"),
}
