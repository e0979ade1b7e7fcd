"""Queries over packages: rows of the tables are written into packages, and what the readers make of them is returned."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import elements, export, images, styles
from ..sources import package, writer
from .queries import order_cells, table, with_notes

#: Style sheets of the queries below; unknown ids are used, too.
FORMATS = [
    {"style_id": "S0", "name": "base", "rpr": '<w:b/><w:sz w:val="20"/>'},
    {"style_id": "S1", "name": "second", "based_on": "S0", "rpr": "<w:i/>"},
    {"style_id": "S2", "name": "third", "based_on": "S1", "rpr": '<w:b w:val="false"/><w:color w:val="FF0000"/>'},
]
HEADINGS = [
    {"style_id": "H0", "name": "Heading 2"},
    {"style_id": "H1", "name": "own", "ppr": '<w:outlineLvl w:val="3"/>'},
    {"style_id": "H2", "name": "derived", "based_on": "H1"},
    {"style_id": "H3", "name": "body", "ppr": '<w:outlineLvl w:val="9"/>'},
    {"style_id": "H4", "name": "HEADING 7"},
]
LEVELS = [{"abstract_num_id": a, "ilvl": k, "start": s, "num_fmt": f} for a, s, f in ((0, 3, "decimal"), (1, 1, "bullet"), (2, 1, "lowerRoman")) for k in (0, 1)]
NUMS = [{"num_id": k + 1, "abstract_num_id": k} for k in range(3)]
BOMB = 4 << 20


def parsed(stream: DataFrame, more: dict | None = None) -> DataFrame:
    return package.parse_packages(writer.write_packages(stream, more))


def text_of(c: str):
    return F.col(c).cast("string").alias("doc_id")


def docx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of 200 documents."""
    cells = order_cells(spark, sf_dir).groupBy("t").agg(F.collect_list(F.struct("row", "cell", "grid_span", "v_merge", "text")).alias("cells"))
    stream = cells.select((F.col("t") % 200).cast("string").alias("doc_id"), F.col("t").cast("int").alias("pos"), F.lit("table").alias("kind"), "cells")
    rows = elements.elements(parsed(stream)).select("doc_id", "pos", F.posexplode("rows").alias("row", "r"))
    return rows.select("doc_id", "pos", "row", F.posexplode("r.cells").alias("k", "c")).select("doc_id", "pos", "row", "k", "c.text", "c.col_span", "c.row_span")


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as paragraphs with the notes that follow them."""
    rows = with_notes(spark, sf_dir)
    note = F.col("kind").isin("footnote", "endnote", "comment")
    doc = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("host", F.last(F.when(~note, F.col("pos")), ignorenulls=True).over(doc))
    found = F.struct("pos", "kind", F.col("note_id").alias("id"), "author", "text")
    hosts = rows.groupBy("doc_id", "host").agg(F.min_by("kind", "pos").alias("kind"), F.min_by("text", "pos").alias("text"), F.array_sort(F.collect_list(F.when(note, found))).alias("n"))
    notes = F.transform("n", lambda x: F.struct(x["kind"].alias("kind"), x["id"].alias("id"), x["author"].alias("author"), x["text"].alias("text")))
    return hosts.select("doc_id", F.col("host").alias("pos"), "kind", F.lit(1).alias("level"), "text", notes.alias("notes"))


def docx_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of all kinds behind the paragraphs that refer to them, as Markdown and as plain text."""
    found = elements.elements(parsed(noted(spark, sf_dir)))
    return found.select("doc_id", "pos", "kind", "text", "note_id", "author", export.rendered(found, "markdown").alias("markdown"), export.rendered(found, "plain").alias("plain"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' titles as paragraphs that end with a link on their first word: to the address, to a place, or to nothing."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("t"))
    word = F.get(F.split("t", " "), F.lit(0))
    none = F.lit(None).cast("string")
    link = F.struct(word.alias("text"), F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(none).alias("url"), F.when(F.col("page_id") % 3 == 1, F.lit("top")).otherwise(none).alias("anchor"))
    return pages.select(text_of("page_id"), F.lit(0).alias("pos"), F.lit("paragraph").alias("kind"), F.concat("t", F.lit(" ")).alias("text"), F.array(link).alias("links"))


def docx_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = elements.elements(parsed(linked(spark, sf_dir)))
    return found.select("doc_id", "text", F.size("links").alias("n_links"), F.get("links", F.lit(0))["url"].alias("url"), export.rendered(found, "markdown").alias("markdown"))


def docx_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.relationships_of_type(parsed(linked(spark, sf_dir)), "/hyperlink").select("doc_id", "rel_id", "target", "is_external")


def docx_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What manifests, entries and counts say of packages with and without relationships."""
    found = package.described(parsed(linked(spark, sf_dir)), "word/_rels/document.xml.rels", "/word/document.xml", "xml")
    return found.select("doc_id", "n_items", "n_rels", "n_styles", F.col("has_entry").alias("has_rels"), F.col("has_part").alias("has_main"), "content_type")


def docx_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as paragraphs of their nation's document, which ends with headers and a footer."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").select(text_of("c_nationkey"), F.col("c_custkey").cast("int").alias("pos"), F.lit("paragraph").alias("kind"), F.col("c_name").alias("text"))
    part = lambda which, slot, *texts: F.struct(F.lit(which).alias("which"), F.lit(slot).alias("slot"), F.array(*texts).alias("texts"))
    sections = F.array(part("footer", "even", F.col("r_name")), part("header", "default", F.col("n_name"), F.col("r_name")), part("header", "first", F.col("n_name")))
    ends = nations.select(text_of("n_nationkey"), F.lit((1 << 31) - 1).alias("pos"), F.lit("section").alias("kind"), sections.alias("sections"))
    found = elements.elements(parsed(rows.unionByName(ends, allowMissingColumns=True)))
    return found.select("doc_id", "pos", "kind", "slot", "text", F.size(F.coalesce("content", F.array())).alias("n_content"), export.rendered(found, "markdown").alias("markdown"))


def part_paragraphs(spark: SparkSession, sf_dir: str, prefix: str, kinds: int) -> DataFrame:
    """Parts as paragraphs of 50 documents, with styles by their size."""
    rows = table(spark, sf_dir, "part")
    place = ((F.col("p_partkey") % 50).cast("string").alias("doc_id"), F.col("p_partkey").cast("int").alias("pos"))
    style = F.concat(F.lit(prefix), (F.col("p_size") % kinds).cast("string"))
    return rows.select(*place, F.lit("paragraph").alias("kind"), F.col("p_name").alias("text"), style.alias("style"), "p_size")


def docx_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = F.array(*map(F.lit, ('<w:b w:val="0"/>', "<w:i/>", '<w:u w:val="single"/>', '<w:sz w:val="30"/>', "")))
    stream = part_paragraphs(spark, sf_dir, "S", 4).withColumn("run", F.get(direct, F.col("p_size") % 5))
    found = styles.run_formatting(parsed(stream, {"word/styles.xml": writer.styles(FORMATS)}))
    f = F.col("formatting")
    return found.select("doc_id", "item_ord", "text", f["bold"].alias("bold"), f["italic"].alias("italic"), f["underline"].alias("underline"), f["font_size_half_points"].alias("size"), f["color"].alias("color"))


def docx_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = elements.elements(parsed(part_paragraphs(spark, sf_dir, "H", 5), {"word/styles.xml": writer.styles(HEADINGS)}))
    return found.select("doc_id", "pos", "kind", "level", "text", F.col("parent_heading.text").alias("h_text"))


def docx_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of lists of three formats, which run beside each other in 40 documents."""
    rows = table(spark, sf_dir, "orders")
    place = ((F.col("o_custkey") % 40).cast("string").alias("doc_id"), F.col("o_orderkey").cast("int").alias("pos"))
    number = ((F.col("o_custkey") % 3 % 2).cast("int").alias("level"), (1 + F.col("o_orderkey") % 3).cast("int").alias("num_id"))
    stream = rows.select(*place, F.lit("list_item").alias("kind"), *number, F.col("o_orderpriority").alias("text"))
    found = elements.elements(parsed(stream, {"word/numbering.xml": writer.numbering(LEVELS, NUMS)}))
    return found.select("doc_id", "pos", "kind", "level", "list_type", "display_index", export.rendered(found, "markdown").alias("markdown"))


def _with_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [writer.package({"word/document.xml": writer.document("")} | {x["name"]: x["data"] for x in media}) for media in batch["media"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, pa.binary())], ["doc_id", "content"])


def docx_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images of 20 packages; their first bytes go by their number."""
    begins = ("89504E470D0A1A0A", "FFD8FF", "474946383761", "424D", "524946460000000057454250", "00")
    data = F.concat(F.get(F.array(*(F.unhex(F.lit(x)) for x in begins)), (F.col("vec_id") % 6).cast("int")), F.encode(F.col("vec_id").cast("string"), "UTF-8"))
    media = F.struct(F.concat(F.lit("word/media/image"), F.col("vec_id").cast("string")).alias("name"), data.alias("data"))
    rows = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 20).cast("string").alias("doc_id")).agg(F.collect_list(media).alias("media"))
    found = images.images(rows.mapInArrow(_with_media, "doc_id string, content binary"))
    return found.select("doc_id", "path", "content_type", F.octet_length("bytes").cast("long").alias("size"), F.col("error.kind").alias("error"))


def _broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = writer.paragraph("x", '<w:pStyle w:val="A"/>')
    loop = writer.styles([{"style_id": "A", "name": "a", "based_on": "B"}, {"style_id": "B", "name": "b", "based_on": "A"}])
    made = [
        writer.package({"word/document.xml": writer.document(text)}), b"not an archive", writer.package({"word/document.xml": writer.document(text)}, None), writer.package({"word/other.xml": "<a/>"}),
        writer.package({"word/document.xml": "<w:document><w:body></w:p></w:body></w:document>"}), writer.package({"word/document.xml": "<!DOCTYPE a><w:document/>"}), writer.package({"word/document.xml": " " * BOMB}),
        writer.package({"word/document.xml": writer.document(text), "word/styles.xml": loop}),
    ]
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([made[k] for k in batch["variant"].to_pylist()], pa.binary())], ["doc_id", "content"])


def docx_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as packages, of which seven in eight are broken in one way each."""
    rows = table(spark, sf_dir, "supplier").select(text_of("s_suppkey"), (F.col("s_suppkey") % 8).cast("int").alias("variant"))
    found = package.parse_packages(rows.mapInArrow(_broken, "doc_id string, content binary"))
    return package.errors(found).select("doc_id", "stage", "kind").union(elements.style_errors(found).select("doc_id", F.lit("elements"), "kind"))


QUERIES = {f.__name__: f for f in (docx_tables, docx_notes, docx_links, docx_rels, docx_parts, docx_sections, docx_formatting, docx_headings, docx_lists, docx_images, docx_errors)}
