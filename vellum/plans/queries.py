"""Queries that apply each operator of the engine to whole tables, with DuckDB SQL for the same rows.

The tables hold no packages, so element streams are derived by fixed rules: a
line of a document's text is an element, its kind follows from its place.
``docx_*`` queries write the same streams into packages and read them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks, elements, export, lists, numbering, styles, tables
from ..sources import guards, package
from ..sources.dealing import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element a line: of each seven a heading, three decimal list items and three paragraphs."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("n"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    kind = F.when(F.col("pos") % 7 == 0, "heading").when((F.col("pos") % 7).between(1, 3), "list_item").otherwise("paragraph")
    level = F.when(F.col("pos") % 7 == 0, 1 + (F.col("n") + F.col("pos")) % 3).when((F.col("pos") % 7).between(1, 3), F.col("pos") % 3)
    return rows.select("doc_id", "pos", kind.alias("kind"), "text", level.cast("int").alias("level"))


def nulls(**kinds: str) -> list:
    return [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream as elements, through the classifier."""
    rows = stream(spark, sf_dir)
    is_list = F.col("kind") == "list_item"
    one = F.lit(1).cast("bigint")
    number = F.struct(one.alias("num_id"), F.col("level").alias("ilvl"), one.alias("start"), F.lit("decimal").alias("num_fmt"))
    rows = rows.select(
        "doc_id",
        F.lit("").alias("scope"),
        F.col("pos").alias("at"),
        F.lit("paragraph").alias("kind"),
        "text",
        F.when(is_list, number).alias("list"),
        F.when(F.col("kind") == "heading", F.col("level")).alias("heading"),
        F.array().cast(elements.LINKS).alias("links"),
    )
    known = ("kind", "text", "level", "parent_heading", "links", "list_type", "num_fmt", "display_index")
    return elements.classify(rows, ["at"]).select("doc_id", F.col("at").alias("pos"), *known, *nulls(rows=elements.ROWS, note_id="bigint", author="string", url="string"))


def with_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations: those of the assistant are footnotes of what stands before them, every fifth a comment."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), "turn", "role", "text")
    doc = Window.partitionBy("doc_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", (F.row_number().over(doc) - 1).cast("int"))
    of_odd = F.when(F.col("pos") % 4 == 1, "footnote").otherwise("endnote")
    kind = F.when(F.col("pos") % 5 == 4, "comment").when(F.col("pos") % 2 == 1, of_odd).when(F.col("pos") % 4 == 0, "heading").otherwise("paragraph")
    note = F.col("kind").isin("footnote", "endnote", "comment")
    return rows.withColumn("kind", kind).select(
        "doc_id",
        "pos",
        "kind",
        "text",
        F.when(F.col("kind") == "heading", F.lit(1)).alias("level"),
        F.array().cast(elements.LINKS).alias("links"),
        F.when(note, F.col("pos").cast("bigint")).alias("note_id"),
        F.when(F.col("kind") == "comment", F.col("role")).alias("author"),
        *nulls(list_type="string", display_index="bigint", rows=elements.ROWS, url="string"),
    )


# -- queries ------------------------------------------------------------------


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("n", "sentence"))


def packed_fragments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(T.estimate_tokens(F.col("text")) > 800)
    return docs.select("doc_id", F.posexplode(T.pack_sentences(T.split_sentences(F.col("text")), 800)).alias("n", "fragment"))


def parent_heading(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", "pos", "kind", F.col("parent_heading.level").alias("h_level"), F.col("parent_heading.text").alias("h_text"))


def list_numbering(spark, sf_dir):
    return classified(spark, sf_dir).where("kind = 'list_item'").select("doc_id", "pos", "level", "list_type", "display_index")


def heading_stack(spark, sf_dir):
    rows = chunks.chunk_rows(classified(spark, sf_dir))
    return rows.select("doc_id", "pos", F.array_join(F.transform("stack", lambda x: F.concat(x["level"].cast("string"), F.lit(":"), x["text"])), " > ").alias("stack"))


def chunk_groups(spark, sf_dir):
    rows = chunks.chunk_rows(classified(spark, sf_dir), 60)
    return rows.select("doc_id", "pos", "over", F.col("grp").cast("bigint").alias("grp"))


def list_nesting(spark, sf_dir):
    return lists.nested_lists(classified(spark, sf_dir)).select("doc_id", "pos", "parent_pos")


def list_runs(spark, sf_dir):
    return lists.nested_lists(classified(spark, sf_dir)).groupBy("doc_id", "list_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("items"))


def _chunks(rows: DataFrame, max_tokens: int, profile: str) -> DataFrame:
    found = chunks.rag_chunks(rows, max_tokens, profile)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    stack = F.array_join(F.transform("heading_context", lambda x: F.concat(x["level"].cast("string"), F.lit(":"), x["text"])), " > ")
    return found.select("doc_id", "chunk_id", "text", joined("paragraph_indices").alias("indices"), joined("element_types").alias("types"), stack.alias("context"), "token_estimate", "is_oversized")


def rag_chunks_default(spark, sf_dir):
    return _chunks(classified(spark, sf_dir), 800, "default")


def rag_chunks_small(spark, sf_dir):
    return _chunks(classified(spark, sf_dir), 60, "technical")


def rag_chunks_minimal(spark, sf_dir):
    return _chunks(with_notes(spark, sf_dir), 800, "minimal")


def rag_chunks_academic(spark, sf_dir):
    return _chunks(with_notes(spark, sf_dir), 800, "academic")


def markdown_elements(spark, sf_dir):
    return export.markdown_elements(classified(spark, sf_dir)).select("doc_id", "pos", "markdown")


def markdown_docs(spark, sf_dir):
    return export.to_markdown(classified(spark, sf_dir))


def plain_text_docs(spark, sf_dir):
    return export.plain_text(with_notes(spark, sf_dir))


def order_cells(spark, sf_dir):
    """Orders as tables, two lines a row; the return flag says which cells merge downwards."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("k", F.row_number().over(line) - 1)
    merge = F.when(F.col("l_returnflag") == "R", "restart").when(F.col("l_returnflag") == "A", "continue")
    places = (F.floor(F.col("k") / 2).cast("int").alias("row"), (F.col("k") % 2).cast("int").alias("cell"))
    return rows.select(F.col("l_orderkey").alias("t"), *places, (1 + F.col("l_linenumber") % 2).cast("int").alias("grid_span"), merge.alias("v_merge"), F.col("l_linestatus").alias("text"))


def table_spans(spark, sf_dir):
    return tables.table_cells(order_cells(spark, sf_dir), ["t"])


def table_markdown(spark, sf_dir):
    cells = order_cells(spark, sf_dir).select("t", "row", "cell", F.lit(1).alias("grid_span"), F.lit(None).cast("string").alias("v_merge"), "text")
    rows = tables.table_rows(cells, ["t"]).select("t", tables.rows_of(F.col("_cells"), F.array_max(F.transform("_cells", lambda c: c["row"])) + 1).alias("rows"))
    return rows.select("t", T.table_markdown(F.col("rows")).alias("markdown"), T.table_text(F.col("rows")).alias("plain"))


def style_resolution(spark, sf_dir):
    """Parts as styles, each based on the part of half its number; brands of one bound document."""
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") % 16).alias("d"), F.floor(F.col("p_partkey") / 16).cast("bigint").alias("k"), "p_name", "p_size")
    outline = F.when(F.col("p_size") % 3 == 0, F.col("p_size") % 10).cast("int")
    ppr = F.struct(*nulls(style_id="string", num_pr="struct<num_id:bigint,ilvl:int>", alignment="string"), outline.alias("outline_level"), F.lit(False).alias("keep_next"), F.lit(False).alias("page_break_before"))
    base = F.when(F.col("k") > 0, F.floor(F.col("k") / 2).cast("bigint").cast("string"))
    names = (F.col("d").cast("string").alias("doc_id"), F.col("k").cast("string").alias("style_id"), F.col("p_name").alias("name"))
    rows = part.select(*names, base.alias("based_on"), ppr.alias("ppr"), *nulls(rpr=package.RPR))
    return styles.resolve_styles(rows).select("doc_id", "style_id", F.col("depth").cast("int").alias("depth"), "outline_level", T.heading_of_outline(F.col("outline_level")).alias("heading_level"))


def list_formats(spark, sf_dir):
    """Orders as numbers of customers, their priorities as formats: concrete numbers joined with abstract levels."""
    nums = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).cast("string").alias("doc_id"), F.col("o_orderkey").alias("num_id"), (F.col("o_orderkey") % 7).alias("abstract_num_id"))
    fmt = F.element_at(F.array(*(F.lit(x) for x in ("decimal", "bullet", "lowerRoman", "none", "upperLetter"))), (F.col("id") % 5 + 1).cast("int"))
    keys = ((F.floor(F.col("id") / 7)).cast("bigint").cast("string").alias("doc_id"), (F.col("id") % 7).alias("abstract_num_id"), F.lit(0).alias("ilvl"))
    levels = spark.range(700).select(*keys, (F.col("id") % 3).alias("start"), fmt.alias("num_fmt"), F.lit("%1.").alias("level_text")).where("abstract_num_id < 6")
    found = numbering.level_formats(nums, levels)
    return found.select("doc_id", "num_id", "start", "num_fmt", T.list_type(F.col("num_fmt")).alias("list_type"))


def link_markdown(spark, sf_dir):
    """Pages' addresses as links on the second word of their text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("t"))
    word = F.get(F.split("t", " "), F.lit(1))
    url = elements.link_url(F.when(F.col("page_id") % 3 == 0, F.col("url")), F.when(F.col("page_id") % 3 == 1, F.lit("top")))
    spans = F.when(word.isNotNull() & url.isNotNull(), F.array(F.struct(word.alias("text"), url.alias("url")))).otherwise(F.array().cast(elements.LINKS))
    return pages.select("page_id", T.linked_markdown(F.col("t"), spans).alias("markdown"))


def image_types(spark, sf_dir):
    """First bytes by the number of an embedding."""
    begins = ("89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "424D00", "52494646000000005745425056", "0000")
    data = F.element_at(F.array(*(F.unhex(F.lit(x)) for x in begins)), (F.col("vec_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", T.image_type(data).alias("content_type"))


def zip_guards(spark, sf_dir):
    """Orders as entries: what the guards on size and ratio say of them."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * 1000).cast("bigint").alias("size"), (F.col("o_orderkey") % 200000).alias("packed"))
    return rows.select("o_orderkey", (guards.too_large(F.col("size")) | guards.too_packed(F.col("size"), F.col("packed"))).alias("bomb"))


def _parsed(spark, sf_dir):
    return package.write_and_parse(stream(spark, sf_dir))


def docx_roundtrip_elements(spark, sf_dir):
    found = elements.elements(_parsed(spark, sf_dir))
    return found.select("doc_id", "pos", "kind", "text", "level", "display_index", F.col("parent_heading.text").alias("h_text"))


def docx_roundtrip_chunks(spark, sf_dir):
    return _chunks(elements.elements(_parsed(spark, sf_dir)), 800, "default")


def docx_markdown(spark, sf_dir):
    return export.to_markdown(elements.elements(_parsed(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    token_estimate, sentences, packed_fragments, parent_heading, list_numbering, heading_stack, chunk_groups, list_nesting, list_runs, rag_chunks_default, rag_chunks_small, rag_chunks_minimal, rag_chunks_academic,
    markdown_elements, markdown_docs, plain_text_docs, table_spans, table_markdown, style_resolution, list_formats, link_markdown, image_types, zip_guards, docx_roundtrip_elements, docx_roundtrip_chunks, docx_markdown,
)}
