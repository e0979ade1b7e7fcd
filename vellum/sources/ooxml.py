"""Readers of the XML parts of a word-processing package.

Parts are read by a pull of expat events. Paragraphs, tables and section
properties are the units of a body: only the unit at hand is held as a tree,
so memory follows the largest unit and not the part. Other elements (insertions,
content controls, smart tags) are looked through; deleted text, tabs, breaks,
symbols and field codes give no text. Fallbacks of alternate content and
tracked former properties are left out, and entities are decoded.
"""

from __future__ import annotations

import codecs
import math
import re
import xml.parsers.expat
from collections.abc import Callable, Iterator

from .guards import PackageError, check_doctype

# Namespaces by the prefix that this module uses for them.
NAMESPACES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://purl.oclc.org/ooxml/wordprocessingml/main": "w",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://purl.oclc.org/ooxml/officeDocument/relationships": "r",
    "http://schemas.openxmlformats.org/markup-compatibility/2006": "mc",
}
MAIN_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
OFF_VALUES = ("false", "0", "off")
U8, U32 = 255, 4294967295
BLOCK = 1 << 16
RUN_PROPERTIES = ("bold", "italic", "underline", "strikethrough", "font_size_half_points", "color", "highlight", "vertical_align")
_HEAD = re.compile(r"\A\ufeff?\s*(<\?xml[^>]*\?>)?")


class Node:
    """An element of a unit: tag, attributes, children (nodes and strings)."""

    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []

    def nodes(self) -> list[Node]:
        return [x for x in self.children if isinstance(x, Node)]

    def val(self) -> str | None:
        return self.attributes.get("w:val")

    def find(self, tag: str) -> Node | None:
        for x in self.children:
            if isinstance(x, Node) and x.tag == tag:
                return x
        return None


def _blocks(data: bytes) -> Iterator[bytes]:
    """A part as UTF-8 without byte order mark, white space and XML declaration at its head, a block at a time."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    head: str | None = ""
    for at in range(0, len(data), BLOCK):
        final = at + BLOCK >= len(data)
        block = decode(data[at : at + BLOCK], final)
        if head is not None:
            block = _HEAD.sub("", head + block)
            if not final and (not block or ("<?xml".startswith(block[:5]) and ">" not in block)):
                head = " " + block  # a byte order mark no longer counts
                continue
            head = None
        yield block.encode()


def units_by_block(part: str, data: bytes, wanted: frozenset[str], within: str | None = None, error: str = "xml_parse") -> Iterator[list[Node]]:
    """Trees of the wanted elements that stand in no other wanted one, inside the element named by within, for each block of the part.

    A truncated part gives what came before its end; a malformed one raises.
    """
    check_doctype(part, data)
    found: list[Node] = []
    stack: list[Node] = []
    # namespaces by prefix, and names that they have given
    scopes: list[tuple[dict[str, str], dict[str, str]]] = [({}, {})]
    inside = 0 if within else 1

    def name(raw: str) -> str:
        scope, known = scopes[-1]
        if raw not in known:
            prefix, colon, local = raw.partition(":")
            known[raw] = f"{scope.get(prefix, prefix)}:{local}" if colon else f"{scope['']}:{raw}" if scope.get("") in ("w", "mc") else raw
        return known[raw]

    def start(raw: str, attributes: dict[str, str]) -> None:
        nonlocal inside
        if [k for k in attributes if k[:5] == "xmlns"]:
            declared = {k.partition(":")[2]: NAMESPACES.get(v, k.partition(":")[2]) for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
            scopes.append((scopes[-1][0] | declared, {}) if declared else scopes[-1])
        else:
            scopes.append(scopes[-1])
        tag = name(raw)
        if within and tag == within:
            inside += 1
        if stack or (inside and tag in wanted):
            node = Node(tag, {(name(k) if ":" in k else k): v for k, v in attributes.items()} if attributes else attributes)
            if stack:
                stack[-1].children.append(node)
            stack.append(node)

    def end(raw: str) -> None:
        nonlocal inside
        if stack:
            node = stack.pop()
            if not stack:
                found.append(node)
        elif within and name(raw) == within:
            inside -= 1
        scopes.pop()

    def text(x: str) -> None:
        if stack and stack[-1].tag == "w:t":
            stack[-1].children.append(x)

    parser = xml.parsers.expat.ParserCreate("UTF-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        for block in _blocks(data):
            parser.Parse(block, False)
            yield found.copy()
            found.clear()
    except xml.parsers.expat.ExpatError as e:
        raise PackageError(error, part, str(e)) from None


def units(part: str, data: bytes, wanted: frozenset[str], within: str | None = None, error: str = "xml_parse") -> Iterator[Node]:
    return (x for found in units_by_block(part, data, wanted, within, error) for x in found)


def check(part: str, data: bytes, error: str = "xml_parse") -> None:
    """Raises what units would, without trees."""
    check_doctype(part, data)
    parser = xml.parsers.expat.ParserCreate("UTF-8")
    try:
        for block in _blocks(data):
            parser.Parse(block, False)
    except xml.parsers.expat.ExpatError as e:
        raise PackageError(error, part, str(e)) from None


def _number(x: str | None, most: int) -> int | None:
    return int(x) if x is not None and re.fullmatch(r"\+?[0-9]+", x) and int(x) <= most else None


def content_types(part: str, data: bytes) -> list[dict]:
    out = []
    for x in units(part, data, frozenset(["Default", "Override"]), error="invalid_content_types"):
        key = x.attributes.get("PartName", "").removeprefix("/") if x.tag == "Override" else x.attributes.get("Extension", "")
        if key and "ContentType" in x.attributes:
            out.append({"kind": x.tag.lower(), "key": key, "content_type": x.attributes["ContentType"]})
    return out


def relationships(part: str, data: bytes) -> list[dict]:
    out = {}
    for x in units(part, data, frozenset(["Relationship"]), error="invalid_relationships"):
        a = x.attributes
        if all(k in a for k in ("Id", "Type", "Target")):
            out[a["Id"]] = {"rel_id": a["Id"], "rel_type": a["Type"], "target": a["Target"], "is_external": a.get("TargetMode", "").lower() == "external"}
    return list(out.values())


def _toggle(node: Node | None) -> bool | None:
    return None if node is None else node.val() not in OFF_VALUES


def run_properties(node: Node | None) -> dict:
    if node is None:
        return dict.fromkeys(RUN_PROPERTIES)
    get = node.find
    val = lambda tag: x.val() if (x := get(tag)) is not None else None
    return {
        "bold": _toggle(get("w:b")), "italic": _toggle(get("w:i")), "underline": _toggle(get("w:u")), "strikethrough": _toggle(get("w:strike")),
        "font_size_half_points": _number(val("w:sz"), U32), "color": val("w:color"), "highlight": val("w:highlight"), "vertical_align": val("w:vertAlign"),
    }


def paragraph_properties(node: Node | None) -> dict:
    get = node.find if node else (lambda tag: None)
    val = lambda tag: x.val() if (x := get(tag)) is not None else None
    numbering = get("w:numPr")
    number = _number(x.val(), U32) if numbering is not None and (x := numbering.find("w:numId")) is not None else None
    level = _number(x.val(), U8) if numbering is not None and (x := numbering.find("w:ilvl")) is not None else None
    return {
        "style_id": val("w:pStyle"), "num_pr": None if number is None else {"num_id": number, "ilvl": level or 0}, "alignment": val("w:jc"),
        "outline_level": _number(val("w:outlineLvl"), U8), "keep_next": _toggle(get("w:keepNext")) or False, "page_break_before": _toggle(get("w:pageBreakBefore")) or False,
    }


def spanned(cells: list[dict], count: int) -> list[dict]:
    """Rows of a table's cells (in order) with the columns and rows they span.

    A cell's column is the sum of the spans before it in its row. One that
    continues another adds a row to the last cell of its column that does not,
    if that one is marked as a restart, and is left out.
    """
    rows: list[dict] = [{"cells": []} for _ in range(count)]
    heads: dict[int, tuple[dict, bool]] = {}
    row, column = -1, 0
    for c in cells:
        if c["row"] != row:
            row, column = c["row"], 0
        if c["v_merge"] == "continue":
            head, merges = heads.get(column, ({}, False))
            if merges:
                head["row_span"] += 1
        else:
            made = {"text": c["text"], "col_span": c["grid_span"], "row_span": 1}
            heads[column] = made, c["v_merge"] == "restart"
            rows[row]["cells"].append(made)
        column += c["grid_span"]
    return rows


class _Body:
    """Items of a body, header or footer, in order."""

    def __init__(self) -> None:
        self.items: list[dict] = []

    def paragraph(self, node: Node, put: Callable[[dict], None]) -> None:
        """Gives a paragraph to put, after those that text boxes in it hold."""
        inlines: list[dict] = []
        refs: list[dict] = []
        link: dict | None = None

        def run(x: Node) -> None:
            texts: list[str] = []
            walk(x, texts)
            part = {"text": "".join(texts) if texts else None, **run_properties(x.find("w:rPr"))}
            if link is None:
                inlines.append({"kind": "run", "rel_id": None, "anchor": None, "text": part["text"], "runs": [part]})
            else:
                link["runs"].append(part)

        def walk(x: Node, texts: list[str] | None) -> None:
            nonlocal link
            for c in x.nodes():
                if c.tag in ("mc:Fallback", "w:pPr", "w:rPr"):
                    continue
                if c.tag == "w:p":
                    self.paragraph(c, put)
                elif c.tag == "w:tbl":
                    self.table(c)
                elif c.tag == "w:t" and texts is not None:
                    texts.extend(t for t in c.children if isinstance(t, str))
                elif c.tag == "w:r" and texts is None:
                    run(c)
                elif c.tag == "w:hyperlink" and texts is None and link is None:
                    link = {"kind": "link", "rel_id": c.attributes.get("r:id"), "anchor": c.attributes.get("w:anchor"), "text": None, "runs": []}
                    walk(c, None)
                    link["text"] = "".join(r["text"] or "" for r in link["runs"])
                    inlines.append(link)
                    link = None
                elif c.tag in ("w:footnoteReference", "w:endnoteReference", "w:commentReference"):
                    if (number := _number(c.attributes.get("w:id"), U32)) is not None:
                        refs.append({"note_kind": c.tag[2:-9], "note_id": number})
                else:
                    walk(c, texts)

        walk(node, None)
        put({"kind": "paragraph", "ppr": paragraph_properties(node.find("w:pPr")), "inlines": inlines, "refs": refs})

    def table(self, node: Node) -> None:
        """A table behind those in its cells."""
        cells: list[dict] = []
        row = -1

        def cell(x: Node, number: int) -> None:
            texts: list[str] = []
            put = lambda p: texts.append("".join(i["text"] or "" for i in p["inlines"] if i["kind"] == "run"))

            def walk(y: Node) -> None:
                for c in y.nodes():
                    if c.tag == "w:p":
                        self.paragraph(c, put)
                    elif c.tag == "w:tbl":
                        self.table(c)
                    elif c.tag not in ("w:tcPr", "mc:Fallback"):
                        walk(c)

            walk(x)
            p = x.find("w:tcPr")
            get = p.find if p else (lambda tag: None)
            span, merge, width = get("w:gridSpan"), get("w:vMerge"), get("w:tcW")
            grid = _number(span.val(), 65535) if span is not None else None
            cells.append({
                "row": row, "cell": number, "grid_span": 1 if grid is None else grid, "v_merge": None if merge is None else "restart" if merge.val() == "restart" else "continue",
                "width": _number(width.attributes.get("w:w"), U32) if width is not None else None, "text": "\n".join(texts),
            })

        def rows(x: Node) -> None:
            nonlocal row
            for c in x.nodes():
                if c.tag == "w:tr":
                    row += 1
                    for number, found in enumerate(list(row_cells(c))):
                        cell(found, number)
                elif c.tag not in ("w:tblPr", "w:tblGrid", "mc:Fallback"):
                    rows(c)

        def row_cells(x: Node) -> Iterator[Node]:
            for c in x.nodes():
                if c.tag == "w:tc":
                    yield c
                elif c.tag not in ("w:tbl", "mc:Fallback"):
                    yield from row_cells(c)

        rows(node)
        properties = node.find("w:tblPr")
        style = properties.find("w:tblStyle") if properties else None
        self.items.append({"kind": "table", "cells": cells, "rows": row + 1, "table": spanned(cells, row + 1), "ppr": {"style_id": style.val() if style is not None else None}})

    def section(self, node: Node) -> None:
        refs = []
        for x in node.nodes():
            if x.tag in ("w:headerReference", "w:footerReference") and "r:id" in x.attributes:
                slot = x.attributes.get("w:type")
                refs.append({"which": x.tag[2:8], "rel_id": x.attributes["r:id"], "slot": slot if slot in ("first", "even") else "default"})
        if node.children:
            self.items.append({"kind": "section", "sections": refs})


def body(part: str, data: bytes, envelope: str) -> list[dict]:
    """Items under an envelope: w:body, w:hdr or w:ftr."""
    return [x for items in body_pieces(part, data, envelope) for x in items]


def body_pieces(part: str, data: bytes, envelope: str, piece_bytes: float = math.inf) -> Iterator[list[dict]]:
    """The same as lists of one item or more, each from about piece_bytes of the part; none for a body without items."""
    out, size = _Body(), 0
    for found in units_by_block(part, data, frozenset(["w:p", "w:tbl", "w:sectPr", "mc:Fallback"]), envelope):
        for x in found:
            if x.tag == "w:p":
                out.paragraph(x, out.items.append)
            elif x.tag == "w:tbl":
                out.table(x)
            elif x.tag == "w:sectPr":
                out.section(x)
        size += BLOCK
        if size >= piece_bytes and out.items:
            yield out.items
            out.items, size = [], 0
    if out.items:
        yield out.items


def styles(part: str, data: bytes) -> tuple[list[dict], dict]:
    """Style rows (the last of an id counts), and the document defaults."""
    found: dict[str, dict] = {}
    defaults = {"ppr": paragraph_properties(None), "rpr": run_properties(None)}
    for x in units(part, data, frozenset(["w:style", "w:docDefaults"])):
        if x.tag == "w:docDefaults":
            p, r = x.find("w:pPrDefault"), x.find("w:rPrDefault")
            defaults = {"ppr": paragraph_properties(p.find("w:pPr") if p else None), "rpr": run_properties(r.find("w:rPr") if r else None)}
            continue
        key, kind = x.attributes.get("w:styleId"), x.attributes.get("w:type")
        if not key or kind not in ("paragraph", "character", "table", "numbering"):
            continue
        val = lambda tag, x=x: y.val() if (y := x.find(tag)) is not None else None
        found.pop(key, None)
        found[key] = {
            "style_id": key, "name": val("w:name") or "", "type": kind, "based_on": val("w:basedOn"), "next_style": val("w:next"),
            "is_default": x.attributes.get("w:default") not in (None, *OFF_VALUES), "ppr": paragraph_properties(x.find("w:pPr")), "rpr": run_properties(x.find("w:rPr")),
        }
    return list(found.values()), defaults


def numbering(part: str, data: bytes) -> tuple[list[dict], list[dict]]:
    """nums and levels: later ids replace earlier ones, but the first level of a number counts."""
    nums: dict[int, dict] = {}
    levels: dict[int, dict[int, dict]] = {}
    for x in units(part, data, frozenset(["w:abstractNum", "w:num"])):
        if x.tag == "w:num":
            key = _number(x.attributes.get("w:numId"), U32)
            of = _number(y.val(), U32) if (y := x.find("w:abstractNumId")) is not None else None
            if key is not None and of is not None:
                overrides = []
                for o in (y for y in x.nodes() if y.tag == "w:lvlOverride"):
                    level = _number(o.attributes.get("w:ilvl"), U8)
                    start = _number(y.val(), U32) if (y := o.find("w:startOverride")) is not None else None
                    if level is not None:
                        overrides.append({"ilvl": level, "start_override": start})
                nums[key] = {"num_id": key, "abstract_num_id": of, "overrides": overrides}
        elif (key := _number(x.attributes.get("w:abstractNumId"), U32)) is not None:
            own = levels[key] = {}
            for y in (y for y in x.nodes() if y.tag == "w:lvl"):
                level = _number(y.attributes.get("w:ilvl"), U8)
                val = lambda tag, y=y: z.val() if (z := y.find(tag)) is not None else None
                if level is not None and level not in own:
                    start = _number(val("w:start"), U32)
                    own[level] = {"abstract_num_id": key, "ilvl": level, "start": 1 if start is None else start, "num_fmt": val("w:numFmt") or "", "level_text": val("w:lvlText") or "", "rpr": run_properties(y.find("w:rPr"))}
    return list(nums.values()), [x for own in levels.values() for x in own.values()]


def notes(part: str, data: bytes, kind: str) -> list[dict]:
    """Footnotes, endnotes or comments; separators and ids out of range are left out."""
    out = {}
    for x in units(part, data, frozenset([f"w:{kind}"])):
        key = _number(x.attributes.get("w:id"), U32)
        if key is None or (kind != "comment" and "w:type" in x.attributes):
            continue
        texts: list[str] = []

        def walk(y: Node, texts: list[str] = texts) -> None:
            for c in y.nodes():
                if c.tag == "w:t":
                    texts.extend(t for t in c.children if isinstance(t, str))
                elif c.tag != "mc:Fallback":
                    walk(c)

        walk(x)
        out[key] = {"note_kind": kind, "note_id": key, "author": x.attributes.get("w:author", "") if kind == "comment" else None, "text": "".join(texts)}
    return list(out.values())
