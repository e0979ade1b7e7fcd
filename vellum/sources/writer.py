"""A writer of small packages from element rows, for round trips and tests."""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dealing import dealt
from .ooxml import MAIN_TYPE

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/word/document.xml" ContentType="{MAIN_TYPE}"/></Types>'
)


def document(body: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{body}</w:body></w:document>'


def paragraph(text: str, properties: str = "") -> str:
    inner = f"<w:pPr>{properties}</w:pPr>" if properties else ""
    return f'<w:p>{inner}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


@functools.cache
def heading_styles() -> str:
    each = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr></w:style>' for k in range(1, 10))
    return f'<w:styles xmlns:w="{W}">{each}</w:styles>'


@functools.cache
def decimal_numbering() -> str:
    each = "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%{k + 1}."/></w:lvl>' for k in range(9))
    return f'<w:numbering xmlns:w="{W}"><w:abstractNum w:abstractNumId="0">{each}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'


def numbering(levels: list[dict], nums: list[dict]) -> str:
    """levels: abstract_num_id, ilvl, start, num_fmt; nums: num_id, abstract_num_id."""
    each = {}
    for x in levels:
        each.setdefault(x["abstract_num_id"], []).append(f'<w:lvl w:ilvl="{x["ilvl"]}"><w:start w:val="{x["start"]}"/><w:numFmt w:val="{x["num_fmt"]}"/><w:lvlText w:val="%{x["ilvl"] + 1}."/></w:lvl>')
    abstract = "".join(f'<w:abstractNum w:abstractNumId="{k}">{"".join(x)}</w:abstractNum>' for k, x in each.items())
    concrete = "".join(f'<w:num w:numId="{x["num_id"]}"><w:abstractNumId w:val="{x["abstract_num_id"]}"/></w:num>' for x in nums)
    return f'<w:numbering xmlns:w="{W}">{abstract}{concrete}</w:numbering>'


def styles(rows: list[dict]) -> str:
    """rows: style_id, name, based_on, and properties of paragraphs and runs as XML."""
    out = []
    for x in rows:
        base = f'<w:basedOn w:val="{x["based_on"]}"/>' if x.get("based_on") else ""
        out.append(f'<w:style w:type="paragraph" w:styleId="{x["style_id"]}"><w:name w:val="{escape(x["name"])}"/>{base}<w:pPr>{x.get("ppr", "")}</w:pPr><w:rPr>{x.get("rpr", "")}</w:rPr></w:style>')
    return f'<w:styles xmlns:w="{W}">{"".join(out)}</w:styles>'


def package(parts: dict[str, str | bytes], types: str | None = TYPES, packing: int = zipfile.ZIP_DEFLATED) -> bytes:
    """A package of the given parts; content types are added unless they are None."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", packing) as z:
        for name, data in ({"[Content_Types].xml": types} | parts if types is not None else parts).items():
            z.writestr(zipfile.ZipInfo(name), data, packing)
    return out.getvalue()


#: What a row of a stream may hold beside kind, level and text; all may be null or absent.
ROW = (
    "pos int, kind string, level int, text string, style string, num_id int, run string, links array<struct<text:string,url:string,anchor:string>>, "
    "notes array<struct<kind:string,id:bigint,author:string,text:string>>, cells array<struct<row:int,cell:int,grid_span:int,v_merge:string,text:string>>, "
    "sections array<struct<which:string,slot:string,texts:array<string>>>"
)


def _table(cells: list[dict]) -> str:
    rows: dict[int, list[str]] = {}
    for c in sorted(cells, key=lambda c: (c["row"], c["cell"])):
        merge = "" if c["v_merge"] is None else "<w:vMerge/>" if c["v_merge"] == "continue" else f'<w:vMerge w:val="{c["v_merge"]}"/>'
        rows.setdefault(c["row"], []).append(f'<w:tc><w:tcPr><w:gridSpan w:val="{c["grid_span"]}"/>{merge}</w:tcPr>{paragraph(c["text"] or "")}</w:tc>')
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(x)}</w:tr>" for _, x in sorted(rows.items())) + "</w:tbl>"


def _notes(kind: str, rows: list[dict]) -> str:
    out = []
    for n in rows:
        author = f" w:author={quoteattr(n['author'] or '')}" if kind == "comment" else ""
        out.append(f'<w:{kind} w:id="{n["id"]}"{author}>{paragraph(n["text"] or "")}</w:{kind}>')
    return f'<w:{kind}s xmlns:w="{W}">{"".join(out)}</w:{kind}s>'


def _relationships(rels: list[tuple[str, str, bool]]) -> str:
    """rels: kind, target and whether it is external, numbered from rel1 on."""
    out = []
    for k, (kind, target, external) in enumerate(rels, 1):
        mode = ' TargetMode="External"' if external else ""
        out.append(f'<Relationship Id="rel{k}" Type="{R}/{kind}" Target={quoteattr(target)}{mode}/>')
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(out)}</Relationships>'


#: A document whose parts hold more goes on in another package: well below the limits on entries, which would refuse it.
VOLUME_BYTES = 48 << 20
VOLUME_PARTS = 4000
_BLOCK = 1 << 16


class Writer:
    """A package that is packed as its rows come: the body at once, parts beside it when it is closed.

    more: parts in place of, or beside, the nine heading styles and decimal numbers.
    """

    def __init__(self, more: dict[str, str | bytes] | None = None):
        self._more = dict(more or {})
        self._out = io.BytesIO()
        self._zip = zipfile.ZipFile(self._out, "w", zipfile.ZIP_DEFLATED)
        self._put("[Content_Types].xml", self._more.pop("[Content_Types].xml", TYPES))
        self._head, self._tail = document("\0").split("\0")
        entry = zipfile.ZipInfo("word/document.xml")
        entry.compress_type = zipfile.ZIP_DEFLATED
        self._body = self._zip.open(entry, "w")
        self._held, self._held_size, self.size = [self._head], 0, 0
        self._rels: list[tuple[str, str, bool]] = []
        self._notes: dict[str, list[dict]] = {}
        self._parts: dict[str, str | bytes] = {}

    def _put(self, name: str, data: str | bytes) -> None:
        self._zip.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)

    def _write(self, xml: str) -> None:
        self._held.append(xml)
        self._held_size += len(xml)
        self.size += len(xml)
        if self._held_size >= _BLOCK:
            self._flush()

    def _flush(self) -> None:
        if "word/document.xml" not in self._more:
            self._body.write("".join(self._held).encode())
        self._held, self._held_size = [], 0

    def _related(self, kind: str, target: str, external: bool) -> str:
        self._rels.append((kind, target, external))
        self.size += 200 + len(target)
        return f"rel{len(self._rels)}"

    def full(self, most: int = VOLUME_BYTES) -> bool:
        return self.size >= most or len(self._parts) >= VOLUME_PARTS

    def add(self, x: dict) -> None:
        """A row as ROW says: heading, list item, paragraph with links and notes, table, section break."""
        if x.get("cells") is not None:
            self._write(_table(x["cells"]))
        elif x.get("sections") is not None:
            self._section(x["sections"])
        else:
            self._paragraph(x)

    def _section(self, sections: list[dict]) -> None:
        refs = []
        for s in sections:
            tag, name = ("hdr" if s["which"] == "header" else "ftr"), f"{s['which']}{len(self._parts) + 1}.xml"
            part = self._parts[f"word/{name}"] = f'<w:{tag} xmlns:w="{W}">{"".join(map(paragraph, s["texts"]))}</w:{tag}>'
            self.size += len(part)
            refs.append(f'<w:{s["which"]}Reference w:type="{s["slot"]}" r:id="{self._related("section", name, False)}"/>')
        self._write(f'<w:sectPr>{"".join(refs)}<w:pgSz w:w="1"/></w:sectPr>')

    def _paragraph(self, x: dict) -> None:
        properties = f'<w:pStyle w:val="{x["style"]}"/>' if x.get("style") else ""
        if x["kind"] == "heading":
            properties = f'<w:pStyle w:val="Heading{x["level"]}"/>'
        elif x["kind"] == "list_item":
            properties += f'<w:numPr><w:ilvl w:val="{x["level"]}"/><w:numId w:val="{x.get("num_id") or 1}"/></w:numPr>'
        inner = [_run(x["text"], x.get("run") or "")]
        for link in x.get("links") or []:
            target = f" w:anchor={quoteattr(link['anchor'])}" if link["anchor"] else ""
            if link["url"]:
                target += f' r:id="{self._related("hyperlink", link["url"], True)}"'
            inner.append(f"<w:hyperlink{target}>{_run(link['text'])}</w:hyperlink>")
        for n in x.get("notes") or []:
            self._notes.setdefault(n["kind"], []).append(n)
            self.size += 200 + len(n["text"] or "")
            inner.append(f'<w:r><w:{n["kind"]}Reference w:id="{n["id"]}"/></w:r>')
        self._write(f"<w:p>{f'<w:pPr>{properties}</w:pPr>' if properties else ''}{''.join(inner)}</w:p>")

    def close(self) -> bytes:
        self._held.append(self._tail)
        self._flush()
        if "word/document.xml" in self._more:
            data = self._more.pop("word/document.xml")
            self._body.write(data.encode() if isinstance(data, str) else data)
        self._body.close()
        parts = {"word/styles.xml": heading_styles(), "word/numbering.xml": decimal_numbering()} | self._parts
        if self._rels:
            parts["word/_rels/document.xml.rels"] = _relationships(self._rels)
        for name, data in (parts | {f"word/{kind}s.xml": _notes(kind, found) for kind, found in self._notes.items()} | self._more).items():
            self._put(name, data)
        self._zip.close()
        return self._out.getvalue()


def _run(text: str | None, run: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{run}</w:rPr>" if run else ""}<w:t xml:space="preserve">{escape(text or "")}</w:t></w:r>'


def of_stream(rows: list[dict], more: dict[str, str | bytes] | None = None) -> bytes:
    """A package of rows as ROW says; more as for Writer."""
    out = Writer(more)
    for x in rows:
        out.add(x)
    return out.close()


def in_order(stream: DataFrame) -> DataFrame:
    """Rows (doc_id and columns of ROW) as the packer takes them: dealt by document and sorted."""
    names = [c for c in (x.strip().split()[0] for x in ROW.split(", ")) if c in stream.columns]
    rows = dealt(stream.select(F.col("doc_id").cast("string").alias("doc_id"), *names), "doc_id")
    return rows.sortWithinPartitions("doc_id", *names)


def packer(more: dict[str, str | bytes] | None = None, volume_bytes: int = VOLUME_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """Makes sorted rows packages (doc_id, content, begin), one at a time."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        out, held, begin, n = None, None, 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for x in batch.slice(k, 256).to_pylist():
                    if out is not None and (x["doc_id"] != held or out.full(volume_bytes)):
                        content, out = out.close(), None
                        yield held, content, begin
                        begin, n = (begin + n if x["doc_id"] == held else 0), 0
                    if out is None:
                        out, held = Writer(more), x["doc_id"]
                    out.add(x)
                    n += 1
        if out is not None:
            yield held, out.close(), begin

    return packed


def write_packages(stream: DataFrame, more: dict[str, str | bytes] | None = None, volume_bytes: int = VOLUME_BYTES) -> DataFrame:
    """Rows (doc_id and columns of ROW) to packages (doc_id, begin, content).

    Rows come sorted and are packed as they come, so a task holds one packed
    package. A document has one; where that would outgrow the limits on entries,
    it goes on in another. begin is the number of rows, each an item, in those
    before, and the readers count on from it.
    """
    packed = packer(more, volume_bytes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, content, begin in packed(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.string()), "begin": pa.array([begin], pa.int64()), "content": pa.array([content], pa.binary())})

    return in_order(stream).mapInArrow(rows, "doc_id string, begin bigint, content binary")
