"""Documents that become several pieces or packages, against the same ones in one."""

import copy
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.operators import elements, styles
from vellum.plans import package_queries, queries
from vellum.sources import guards, ooxml, package, writer

N = 6000
SHEET = writer.styles([{"style_id": "H0", "name": "heading 2"}, {"style_id": "H1", "name": "own", "based_on": "H0", "ppr": '<w:outlineLvl w:val="3"/>', "rpr": "<w:b/>"}])


@pytest.fixture(scope="module")
def stream(spark):
    """Two documents of all that needs a lookup: styles, list levels, links, notes, section parts."""
    p = F.col("id").cast("int")
    none = F.lit(None)
    link = F.array(F.struct(F.lit("l").alias("text"), F.concat(F.lit("https://x.org/"), p).alias("url"), none.cast("string").alias("anchor")))
    note = F.array(F.struct(F.lit("footnote").alias("kind"), F.col("id").alias("id"), none.cast("string").alias("author"), F.concat(F.lit("n"), p).alias("text")))
    part = F.array(F.struct(F.lit("header").alias("which"), F.lit("first").alias("slot"), F.array(F.concat(F.lit("h"), p)).alias("texts")))
    kind = F.when(p % 1000 == 999, "section").when(p % 3 == 0, "list_item").otherwise("paragraph")
    rows = spark.range(N).select(
        F.lit("long").alias("doc_id"), p.alias("pos"), kind.alias("kind"), (p % 2).alias("level"), F.concat(F.lit("text "), p).alias("text"), F.when(p % 7 == 1, "H1").when(p % 700 == 2, "H0").alias("style"),
        F.when(p % 50 == 4, link).alias("links"), F.when(p % 50 == 5, note).alias("notes"), F.when(p % 1000 == 999, part).alias("sections"),
    )
    return rows.union(rows.where("pos < 5").withColumn("doc_id", F.lit("short"))).cache()


def rows_of(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def read(stream, piece_bytes, volume_bytes=writer.VOLUME_BYTES):
    return package.parse_packages(writer.write_packages(stream, {"word/styles.xml": SHEET}, volume_bytes), piece_bytes=piece_bytes)


def test_pieces_and_packages(stream):
    whole = read(stream, math.inf)
    want = rows_of(elements.elements(whole))
    formats = rows_of(styles.run_formatting(whole))
    assert len(want) == N + 5 + N // 50 and {x[2] for x in want} >= {"heading", "list_item", "header", "footnote"}
    for piece_bytes, volume_bytes in ((ooxml.BLOCK, writer.VOLUME_BYTES), (package.PIECE_BYTES, 200_000), (ooxml.BLOCK, 100_000)):
        got = read(stream, piece_bytes, volume_bytes)
        assert rows_of(elements.elements(got)) == want
        assert rows_of(styles.run_formatting(got)) == formats
        assert [x.item_ord for x in package.raw_body(got).where("doc_id = 'long'").orderBy("item_ord").collect()] == list(range(N))


def test_written_and_parsed_by_one_worker(spark, stream):
    """What one worker packs and parses is what two make of it; a package is parsed before the next is packed."""
    for piece_bytes, volume_bytes in ((package.PIECE_BYTES, writer.VOLUME_BYTES), (ooxml.BLOCK, 100_000)):
        got = package.write_and_parse(stream, {"word/styles.xml": SHEET}, piece_bytes, volume_bytes)
        assert rows_of(got) == rows_of(read(stream, piece_bytes, volume_bytes))
    for name in ("docx_roundtrip_elements", "docx_roundtrip_chunks", "docx_markdown"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1, plan
    taken = []
    row = {"pos": 0, "kind": "paragraph", "level": None}
    batches = (taken.append(k) or pa.RecordBatch.from_pylist([row | {"doc_id": f"{k}{n}", "text": "x" * 300_000} for n in range(9)]) for k in range(9))
    parsed = package._parse_rows(package._arrow(package.PARSED), package.PIECE_BYTES, writer.packer())(batches)
    assert next(parsed).num_rows and len(taken) < 9
    assert sum(x.num_rows for x in parsed) and len(taken) == 9


def test_rows_are_bounded(stream):
    """No row holds a long document; lookups come with the items that need them, and once for the package."""
    got = read(stream, package.PIECE_BYTES).cache()
    pieces = got.where("doc_id = 'long'").selectExpr("size(items) n", "size(rels) rels", "last").collect()
    assert len(pieces) >= 3 and max(x.n for x in pieces) < N // 2 and all(x.rels < N // 100 for x in pieces if not x.last)
    n = {x.doc_id: x for x in package.counts(got).collect()}
    assert (n["long"].n_items, n["long"].n_rels, n["long"].n_notes, n["long"].n_part_items, n["short"].n_items) == (N, N // 50 + N // 1000, N // 50, N // 1000, 5)
    assert package.relationships(got).where("doc_id = 'long'").count() == N // 50 + N // 1000


def test_late_faults(spark):
    """A fault at the end of a long body, or in the style of its last paragraph, leaves no elements of it."""
    body = "".join(writer.paragraph(f"text {k}") for k in range(8000))
    loop = writer.styles([{"style_id": "A", "name": "a", "based_on": "B"}, {"style_id": "B", "name": "b", "based_on": "A"}])
    made = [("bad", {"word/document.xml": writer.document(body + "</w:x>")}), ("loop", {"word/document.xml": writer.document(body + writer.paragraph("x", '<w:pStyle w:val="A"/>')), "word/styles.xml": loop})]
    got = package.parse_packages(spark.createDataFrame([(k, bytearray(writer.package(v))) for k, v in made], "doc_id string, content binary"))
    assert elements.elements(got).count() == 0
    assert [(x.doc_id, x.kind) for x in package.errors(got).collect()] == [("bad", "xml_parse")]
    assert [tuple(x) for x in elements.style_errors(got).collect()] == [("loop", "circular_style")]


def test_blocks():
    """Blocks of a part are what one decoding of the whole gives."""
    heads = (b"", b"\xef\xbb\xbf", b" " * 70000, b"\xef\xbb\xbf" + b"\n" * 65533, b'\xef\xbb\xbf <?xml version="1.0"?>', b" " * 65533 + b'<?xml version="1.0"?>')
    for head in heads:
        data = head + b"<a>" + "é€".encode() * 40000 + b"\xff\xc3</a>\xe2\x82"
        want = ooxml._HEAD.sub("", data.decode("utf-8", "replace"))
        assert b"".join(ooxml._blocks(data)).decode() == want
    ooxml.check("p", b"<a><b>")
    with pytest.raises(guards.PackageError):
        ooxml.check("p", b"<a></b>")


def test_described_at_once(spark, stream):
    """What manifests, entries and counts say comes from one reading of each package."""
    made = writer.write_packages(stream, volume_bytes=1 << 30)
    rows = made.select("doc_id", "content").union(spark.createDataFrame([("no_zip", bytearray(b"x")), ("no_types", bytearray(writer.package({"word/document.xml": "<a/>"}, None)))], "doc_id string, content binary")).cache()
    got = package.parse_packages(rows)
    for entry, part in (("word/document.xml", "/word/document.xml"), ("word/footnotes.xml", "word/none.xml")):
        want = package.counts(got).join(package.has_entry(rows, entry), "doc_id").join(package.has_part(got, part), "doc_id").join(package.default_for_extension(got, "xml"), "doc_id")
        assert rows_of(package.described(got, entry, part, "xml").select(*want.columns)) == rows_of(want)
    plan = package_queries.docx_parts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_equal_parts_are_read_once(monkeypatch):
    """Packages of one template share what is read from it; short bodies are read once, and nothing that was read before is changed."""
    content = writer.of_stream([{"pos": k, "kind": "heading", "level": 1, "text": f"t{k}"} for k in range(9)])
    monkeypatch.setattr(package, "_styles", package._shared(ooxml.styles))
    fresh = list(package.parse_package("a", content))
    kept = copy.deepcopy(fresh)
    calls = []
    real = ooxml.units_by_block
    monkeypatch.setattr(ooxml, "units_by_block", lambda part, *a, **b: calls.append(part) or real(part, *a, **b))
    again = list(package.parse_package("a", content))
    assert calls == ["word/document.xml"] and again == kept == fresh
    other = writer.package({"word/document.xml": writer.document(writer.paragraph("x")), "word/styles.xml": SHEET})
    (row,) = package.parse_package("b", other)
    assert [x["style_id"] for x in row["styles"]] == ["H0", "H1"] and [x["style_id"] for x in fresh[0]["styles"]] == [f"Heading{k}" for k in range(1, 10)]
