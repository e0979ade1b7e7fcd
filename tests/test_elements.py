"""Packages built in memory, with exact expectations."""

import pytest

from vellum.operators import chunks, elements, export, images, lists, styles
from vellum.sources import package as pk
from vellum.sources import writer as w

TITLE, PART = (f'<w:pStyle w:val="Heading{k}"/>' for k in (1, 2))
ITEM = '<w:numPr><w:ilvl w:val="{}"/><w:numId w:val="{}"/></w:numPr>'
W = f'xmlns:w="{w.W}"'
FOOT = f'<w:footnotes {W}><w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="4">{w.paragraph("Gauged at low tide.")}</w:footnote><w:footnote w:id="9">{w.paragraph("Two readings")}{w.paragraph(" only.")}</w:footnote></w:footnotes>'
END = f'<w:endnotes {W}><w:endnote w:id="12">{w.paragraph("Harbour log, p. 3.")}</w:endnote></w:endnotes>'
SAID = f'<w:comments {W}><w:comment w:id="31" w:author="R. Okafor">{w.paragraph("Check the datum.")}</w:comment></w:comments>'
RELS = '<Relationships xmlns="r"><Relationship Id="k5" Type="x/hyperlink" Target="https://tides.example.org/b" TargetMode="External"/><Relationship Id="k6" Type="x/header" Target="header3.xml"/><Relationship Id="k7" Type="x/footer" Target="/word/footer2.xml"/></Relationships>'
NUMBERS = f'<w:numbering {W}><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:start w:val="6"/><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="5"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="40"/></w:lvlOverride></w:num></w:numbering>'


def ref(kind, number):
    return f'<w:r><w:{kind}Reference w:id="{number}"/></w:r>'


def run(text):
    return f'<w:r><w:t xml:space="preserve">{text}</w:t></w:r>'


def build(body, **parts):
    names = {"styles": "word/styles.xml", "numbering": "word/numbering.xml", "footnotes": "word/footnotes.xml", "endnotes": "word/endnotes.xml", "comments": "word/comments.xml", "rels": "word/_rels/document.xml.rels", "header": "word/header3.xml", "footer": "word/footer2.xml"}
    return w.package({"word/document.xml": w.document(body), "word/styles.xml": w.heading_styles(), "word/numbering.xml": w.decimal_numbering()} | {names[k]: v for k, v in parts.items()})


def cell(text, properties=""):
    return f"<w:tc><w:tcPr>{properties}</w:tcPr>{w.paragraph(text)}</w:tc>"


def merged(restart, span=1):
    return f'<w:gridSpan w:val="{span}"/><w:vMerge{" w:val=" + chr(34) + "restart" + chr(34) if restart else ""}/>'


SECTION = '<w:sectPr><w:footerReference r:id="k7" w:type="first"/><w:headerReference r:id="k6" w:type="even"/></w:sectPr>'
DOCS = {
    "one_line": build(w.paragraph("The sea wall was raised in 1911.")),
    "parts": build(w.paragraph("Lead") + w.paragraph("Tides", TITLE) + w.paragraph("They turn twice a day.") + w.paragraph("Neap", PART) + w.paragraph("They are low.") + w.paragraph("Spring", PART)),
    "counted": build("".join(w.paragraph(t, ITEM.format(k, 1)) for t, k in (("salt", 0), ("sand", 1), ("silt", 1), ("clay", 0), ("peat", 1)))),
    "not_lists": build(w.paragraph("plain", ITEM.format(0, 0)) + w.paragraph("unknown", ITEM.format(0, 77)) + w.paragraph("no such level", ITEM.format(30, 1))),
    "grid": build(f"<w:tbl><w:tr>{cell('day')}{cell('height', merged(True, 3))}</w:tr><w:tr>{cell('Monday', merged(True))}{cell('', merged(False, 3))}</w:tr><w:tr>{cell('', merged(False))}{cell('4 m')}{cell('5 m')}</w:tr></w:tbl>"),
    "table_in_table": build(f"<w:tbl><w:tr><w:tc><w:tbl><w:tr>{cell('deep')}</w:tr></w:tbl>{w.paragraph('shallow')}</w:tc></w:tr></w:tbl>"),
    "noted": build(f"<w:p>{run('Levels rose')}{ref('comment', 31)}{ref('endnote', 12)}{ref('footnote', 9)}{run(' quickly')}{ref('footnote', 4)}{ref('footnote', 88)}</w:p>", footnotes=FOOT, endnotes=END, comments=SAID),
    "linked": build(f"<w:p>{run('Compare the ')}<w:hyperlink r:id=\"k5\">{run('tide ')}{run('tables')}</w:hyperlink>{run(' and the ')}<w:hyperlink w:anchor=\"map\">{run('map')}</w:hyperlink>{run(' first.')}<w:hyperlink r:id=\"none\">{run('!')}</w:hyperlink></w:p>", rels=RELS),
    "framed": build(w.paragraph("inside") + SECTION, rels=RELS, header=f"<w:hdr {W}>{w.paragraph('Port', TITLE)}{w.paragraph('berths', ITEM.format(0, 1))}{w.paragraph('depths')}</w:hdr>", footer=f"<w:ftr {W}>{w.paragraph('p. 1')}</w:ftr>"),
    "mixed": build(w.paragraph("Kit", TITLE) + "".join(w.paragraph(t, ITEM.format(0, 1)) for t in ("rope", "lamp", "chart")) + w.paragraph("Pack it dry.")),
    "overridden": build("".join(w.paragraph(t, ITEM.format(0, 2)) for t in "ab"), numbering=NUMBERS),
    "entities": build("<w:p><w:r><w:t>cod &amp; ling &#233;</w:t><w:tab/><w:t>x</w:t></w:r></w:p>"),
    "box": build(f"<w:p><w:r><w:t>around</w:t><mc:AlternateContent xmlns:mc='http://schemas.openxmlformats.org/markup-compatibility/2006'><mc:Choice>{w.paragraph('boxed')}</mc:Choice><mc:Fallback>{w.paragraph('boxed again')}</mc:Fallback></mc:AlternateContent></w:r></w:p>"),
    "circular": build(w.paragraph("x", '<w:pStyle w:val="Up"/>'), styles=w.styles([{"style_id": "Up", "name": "up", "based_on": "Down"}, {"style_id": "Down", "name": "down", "based_on": "Up"}])),
    "truncated": w.package({"word/document.xml": w.document(w.paragraph("kept") + w.paragraph("lost"))[:-60]}),
    "malformed": w.package({"word/document.xml": "<w:document><w:body></w:p></w:body></w:document>"}),
    "doctype": w.package({"word/document.xml": "<!DocType x><w:document/>"}),
    "no_types": w.package({"word/document.xml": w.document("")}, None),
    "no_main": w.package({"word/other.xml": "<a/>"}),
    "no_zip": b"not a zip",
    "pictures": w.package({"word/document.xml": w.document(""), "word/media/quay.png": bytes.fromhex("89504E470D0A1A0A") + b"1", "word/media/Crane.jpeg": b"\xff\xd8\xff\xe1", "word/media/zzz": b"GIF87a.", "word/embeddings/x.png": b""}),
    "bombed": w.package({"word/document.xml": w.document(""), "word/media/a.png": bytes.fromhex("89504E470D0A1A0A"), "word/media/b.png": bytes(4 << 20), "word/media/c.png": bytes.fromhex("89504E470D0A1A0A") + b"2"}),
}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in DOCS.items()], "doc_id string, content binary")
    return rows, pk.parse_packages(rows).cache()


@pytest.fixture(scope="module")
def found(corpus):
    rows = {}
    for x in elements.elements(corpus[1]).orderBy("doc_id", "pos").collect():
        rows.setdefault(x.doc_id, []).append(x)
    return rows


def test_paragraphs_and_headings(found):
    assert [(x.kind, x.text, x.parent_heading) for x in found["one_line"]] == [("paragraph", "The sea wall was raised in 1911.", None)]
    assert [(x.kind, x.level) for x in found["parts"]] == [("paragraph", None), ("heading", 1), ("paragraph", None), ("heading", 2), ("paragraph", None), ("heading", 2)]
    assert [x.parent_heading and tuple(x.parent_heading) for x in found["parts"]] == [None, None, (1, "Tides"), None, (2, "Neap"), None]


def test_lists(found, corpus):
    assert [(x.level, x.display_index) for x in found["counted"]] == [(0, 1), (1, 1), (1, 2), (0, 2), (1, 1)]
    assert [x.kind for x in found["not_lists"]] == ["paragraph"] * 3
    assert [x.display_index for x in found["overridden"]] == [6, 7]
    honoured = elements.elements(corpus[1], honor_start_override=True).where("doc_id = 'overridden'").orderBy("pos").collect()
    assert [x.display_index for x in honoured] == [40, 41]


def test_tables(found):
    rows = found["grid"][0].rows
    assert [[(c.text, c.col_span, c.row_span) for c in r.cells] for r in rows] == [[("day", 1, 1), ("height", 3, 2)], [("Monday", 1, 2)], [("4 m", 1, 1), ("5 m", 1, 1)]]
    assert [x.rows[0].cells[0].text for x in found["table_in_table"]] == ["deep", "shallow"]


def test_notes_and_links(found, corpus):
    notes = [("paragraph", None, "Levels rose quickly", None), ("footnote", 9, "Two readings only.", None), ("footnote", 4, "Gauged at low tide.", None), ("endnote", 12, "Harbour log, p. 3.", None), ("comment", 31, "Check the datum.", "R. Okafor")]
    assert [(x.kind, x.note_id, x.text, x.author) for x in found["noted"]] == notes
    link = found["linked"][0]
    assert link.text == "Compare the tide tables and the map first.!" and [tuple(x) for x in link.links] == [("tide tables", "https://tides.example.org/b"), ("map", "#map")]
    every = elements.links(corpus[1]).orderBy("doc_id", "at", "ord").collect()
    assert [(x.doc_id, x.at, x.ord, x.text, x.url) for x in every] == [("linked", 0, 0, "tide tables", "https://tides.example.org/b"), ("linked", 0, 1, "map", "#map")]


def test_sections(found, corpus):
    body, header = found["framed"]
    assert (body.kind, header.kind, header.slot, header.text) == ("paragraph", "header", "even", None)
    assert [(x.kind, x.text, x.display_index, x.parent_heading and x.parent_heading.text) for x in header.content] == [("heading", "Port", None, None), ("list_item", "berths", 1, None), ("paragraph", "depths", None, "Port")]
    # a target with its folder is found only where targets are normalised
    both = elements.elements(corpus[1], normalise_targets=True).where("doc_id = 'framed'").orderBy("pos").collect()
    assert [(x.kind, x.slot) for x in both] == [("paragraph", None), ("header", "even"), ("footer", "first")] and both[2].content[0].text == "p. 1"


def test_text_details(found):
    assert found["entities"][0].text == "cod & ling éx"
    assert [x.text for x in found["box"]] == ["boxed", "around"]
    assert [x.text for x in found["truncated"]] == ["kept"]


def test_exports(corpus):
    table = elements.elements(corpus[1])
    md = {x.doc_id: x.markdown for x in export.to_markdown(table).collect()}
    text = {x.doc_id: x.plain_text for x in export.plain_text(table).collect()}
    assert md["mixed"] == "# Kit\n\n1. rope\n2. lamp\n3. chart\n\nPack it dry." and text["mixed"] == "Kit\n\nrope\nlamp\nchart\n\nPack it dry."
    assert md["linked"] == "Compare the [tide tables](https://tides.example.org/b) and the [map](#map) first.!"
    assert md["grid"] == "| day | height |\n| --- | --- |\n| Monday |\n| 4 m | 5 m |"
    assert md["framed"] == "inside\n\n> [Header]\n> # Port\n> \n> 1. berths\n> \n> depths"
    assert text["noted"] == "Levels rose quickly\n\n[9] Two readings only.\n\n[4] Gauged at low tide.\n\n[endnote 12] Harbour log, p. 3.\n\n[comment 31 by R. Okafor] Check the datum."
    assert md["noted"].split("\n\n")[1:] == ["[^9]: Two readings only.", "[^4]: Gauged at low tide.", "[^endnote12]: Harbour log, p. 3.", "> **Comment 31 (R. Okafor):** Check the datum."]


def test_chunks(corpus):
    table = elements.elements(corpus[1])
    of = lambda profile, doc: [x.text for x in chunks.rag_chunks(table, profile=profile).where(f"doc_id = '{doc}'").orderBy("chunk_id").collect()]
    assert of("default", "parts") == ["Lead", "Tides\n\nThey turn twice a day.", "Neap\n\nThey are low.", "Spring"]
    assert of("minimal", "noted") == ["Levels rose quickly"]
    assert of("academic", "noted") == ["Levels rose quickly (Note 9: Two readings only.) (Note 4: Gauged at low tide.) (Endnote 12: Harbour log, p. 3.)\n\n[comment 31 by R. Okafor] Check the datum."]
    row = chunks.Chunker().with_max_tokens(800).chunk(table).where("doc_id = 'parts' AND chunk_id = 2").first()
    assert [tuple(x) for x in row.heading_context] == [(1, "Tides"), (2, "Neap")] and row.paragraph_indices == [3, 4] and row.element_types == ["heading", "paragraph"]


def test_lookups(corpus):
    rows, parsed = corpus
    has = {x.doc_id: x.has_entry for x in pk.has_entry(rows, "word/comments.xml").collect()}
    assert has["noted"] and not has["linked"] and not has["no_zip"]
    assert {x.doc_id for x in pk.has_part(parsed, "/word/document.xml").where("has_part").collect()} == set(DOCS) - {"no_types", "no_zip"}
    assert pk.default_for_extension(parsed, "rels").where("doc_id = 'one_line'").first().content_type.endswith("relationships+xml")
    assert pk.default_for_extension(parsed, "png").where("doc_id = 'one_line'").first().content_type is None
    assert [(x.doc_id, x.target) for x in pk.relationship(parsed, "k6").orderBy("doc_id").collect()] == [("framed", "header3.xml"), ("linked", "header3.xml")]
    assert pk.relationships_of_type(parsed, "hyper").where("doc_id = 'linked'").count() == 1 and pk.relationships_of_type(parsed, "x/").where("doc_id = 'linked'").count() == 3
    assert [(x.note_kind, x.note_id) for x in pk.notes(parsed, "footnote").collect()] == [("footnote", 4), ("footnote", 9)]
    assert [x.kind for x in pk.raw_body(parsed).where("doc_id = 'framed'").orderBy("item_ord").collect()] == ["paragraph", "section"]
    assert pk.style_table(parsed).where("doc_id = 'one_line'").count() == 9
    assert [tuple(x)[1:5] for x in pk.numbering_defs(parsed).where("doc_id = 'overridden'").collect()] == [(2, 0, 6, "decimal")]
    assert pk.section_part(parsed, "word/header3.xml").where("doc_id = 'framed'").count() == 3
    n = {x.doc_id: x for x in pk.counts(parsed).collect()}
    assert (n["noted"].n_notes, n["noted"].n_rels, n["framed"].n_part_items, n["no_zip"].n_items) == (4, 0, 2, 0)


def test_oversized(spark):
    table = spark.createDataFrame([("d", 0, "paragraph", "One two three four. Five six seven eight! Nine ten eleven twelve?")], "doc_id string, pos int, kind string, text string")
    table = table.selectExpr("*", "cast(null as int) level", "cast(null as bigint) note_id", "cast(null as string) author", "cast(null as array<struct<cells:array<struct<text:string,col_span:int,row_span:int>>>>) rows")
    rows = chunks.rag_chunks(table, 5).orderBy("chunk_id").collect()
    assert [x.text for x in rows] == ["One two three four.", "Five six seven eight!", "Nine ten eleven twelve?"] and all(x.is_oversized and x.paragraph_indices == [0] for x in rows)


def test_errors_and_modes(corpus):
    rows, parsed = corpus
    kinds = {x.doc_id: (x.stage, x.kind) for x in pk.errors(parsed).collect()}
    assert kinds == {"malformed": ("elements", "xml_parse"), "doctype": ("elements", "xml_parse"), "no_types": ("open", "missing_part"), "no_main": ("open", "missing_part"), "no_zip": ("open", "zip")}
    assert [tuple(x) for x in elements.style_errors(parsed).collect()] == [("circular", "circular_style")]
    assert pk.parse_packages(rows, "DROPMALFORMED").count() == rows.count() - 5
    with pytest.raises(Exception, match="no_zip|malformed|doctype|no_types|no_main"):
        pk.parse_packages(rows, "FAILFAST").collect()


def test_images(corpus):
    of = lambda doc, **o: [(x.path, x.content_type, x.error and x.error.kind) for x in images.images(corpus[0], **o).where(f"doc_id = '{doc}'").orderBy("path").collect()]
    assert of("pictures") == [("word/media/Crane.jpeg", "image/jpeg", None), ("word/media/quay.png", "image/png", None), ("word/media/zzz", "image/gif", None)]
    assert of("bombed") == [("word/media/b.png", None, "zip_bomb")] and of("no_zip") == [(None, None, "zip")] and of("parts") == []
    assert of("bombed", whole=False) == [("word/media/a.png", "image/png", None), ("word/media/b.png", None, "zip_bomb"), ("word/media/c.png", "image/png", None)]


def test_nested_lists(spark):
    items = spark.createDataFrame([("d", k, "list_item", str(k), level, "decimal", 1) for k, level in enumerate((0, 1, 0, 1, 2))] + [("d", 5, "paragraph", "", None, None, None), ("d", 6, "list_item", "6", 1, "bullet", None)], "doc_id string, pos int, kind string, text string, level int, list_type string, display_index bigint")
    rows = lists.nested_lists(items).orderBy("pos").collect()
    assert [(x.list_id, x.pos, x.parent_pos, x.depth) for x in rows] == [(0, 0, None, 0), (0, 1, 0, 1), (0, 2, None, 0), (0, 3, 2, 1), (0, 4, 3, 2), (1, 6, None, 0)]


def test_style_chains(spark):
    ppr = "struct<style_id:string,num_pr:struct<num_id:bigint,ilvl:int>,alignment:string,outline_level:int,keep_next:boolean,page_break_before:boolean>"
    def chain(doc, length):
        return [(doc, f"s{k}", f"s{k}", f"s{k + 1}" if k + 1 < length else None, 3 if k == length - 1 else None) for k in range(length)]
    rows = spark.createDataFrame(chain("ok", 64) + chain("deep", 71) + [("loop", "A", "A", "B", None), ("loop", "B", "B", "A", None)], "doc_id string, style_id string, name string, based_on string, o int")
    rows = rows.selectExpr("doc_id", "style_id", "name", "based_on", f"cast(named_struct('style_id', cast(null as string), 'num_pr', null, 'alignment', null, 'outline_level', o, 'keep_next', false, 'page_break_before', false) as {ppr}) ppr", f"cast(null as {pk.RPR}) rpr")
    got = {(x.doc_id, x.style_id): (x.error, x.outline_level) for x in styles.resolve_styles(rows).collect()}
    assert got["ok", "s0"] == (None, 3) and got["deep", "s0"][0] == "style_chain_too_deep" and got["deep", "s7"] == (None, 3) and got["loop", "A"][0] == "circular_style"


def test_run_formatting(spark):
    sheet = f'<w:styles xmlns:w="{w.W}"><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:styleId="B"><w:rPr><w:b/><w:i/></w:rPr></w:style></w:styles>'
    body = '<w:p><w:pPr><w:pStyle w:val="B"/></w:pPr><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t>x</w:t></w:r></w:p>'
    rows = spark.createDataFrame([("d", bytearray(build(body, styles=sheet)))], "doc_id string, content binary")
    f = styles.run_formatting(pk.parse_packages(rows)).first().formatting
    assert (f.bold, f.italic, f.underline, f.font_size_half_points) == (False, True, False, 22)
