"""Heading-aware chunks of documents for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, pack_sentences, plain, split_sentences

MAX_TOKENS = 800
PROFILES = ("default", "academic", "technical", "minimal")
LEVELS = 9


def apply_profile(elements: DataFrame, profile: str) -> DataFrame:
    """The elements that a profile chunks, renumbered; source_pos keeps the old places.

    minimal drops notes and comments. academic writes footnotes and endnotes
    into the text before them, if that is a paragraph, list item or heading,
    and loses them otherwise.
    """
    rows = elements.withColumn("source_pos", F.col("pos"))
    if profile in ("default", "technical"):
        return rows
    doc = Window.partitionBy("doc_id").orderBy("pos")
    number = (F.row_number().over(doc) - 1).cast("int")
    if profile == "minimal":
        return rows.where(~F.col("kind").isin("footnote", "endnote", "comment")).withColumn("pos", number)
    if profile != "academic":
        raise ValueError(profile)
    note = F.col("kind").isin("footnote", "endnote")
    rows = rows.withColumn("_host", F.last(F.when(~note, F.col("pos")), ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    label = F.when(F.col("kind") == "footnote", "Note ").otherwise("Endnote ")
    suffix = F.when(note, F.struct("pos", F.concat(F.lit(" ("), label, F.col("note_id").cast("string"), F.lit(": "), "text", F.lit(")")).alias("s")))
    host = Window.partitionBy("doc_id", "_host")
    rows = rows.withColumn("_notes", F.array_join(F.transform(F.array_sort(F.collect_list(suffix).over(host)), lambda x: x["s"]), ""))
    takes = F.col("kind").isin("paragraph", "list_item", "heading")
    rows = rows.where(~note).withColumn("text", F.when(takes, F.concat("text", "_notes")).otherwise(F.col("text")))
    return rows.withColumn("pos", number).drop("_host", "_notes")


def chunk_rows(elements: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Elements to be chunked with their text, estimate, heading stack and chunk group.

    All windows share one partitioning, by document. The heading stack holds
    those levels whose last heading comes after the last of every smaller
    level, the current one included.
    """
    rows = elements.where(~F.col("kind").isin("header", "footer"))
    source = F.col("source_pos" if "source_pos" in elements.columns else "pos").alias("source_pos")
    rows = rows.select("doc_id", "pos", source, "kind", "level", F.coalesce(plain(F.col("kind"), F.col), F.lit("")).alias("text"))
    rows = rows.withColumn("n", estimate_tokens(F.col("text")))
    heading = F.col("kind") == "heading"
    rows = rows.withColumn("over", ~heading & (F.col("n") > max_tokens))
    doc = Window.partitionBy("doc_id").orderBy("pos")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(heading & (F.col("level") == k), F.struct("pos", "level", "text"))).over(upto) for k in range(1, LEVELS + 1)]
    kept = []
    for k, x in enumerate(last):
        before = [F.coalesce(y["pos"], F.lit(-1)) for y in last[:k]]
        kept.append(F.when(x["pos"] > F.greatest(F.lit(-1), F.lit(-1), *before), F.struct(x["level"].alias("level"), x["text"].alias("text"))))
    rows = rows.withColumn("stack", F.filter(F.array(*kept), lambda x: x.isNotNull()))
    begins = F.lag("pos").over(doc).isNotNull() & (heading | F.col("over") | F.coalesce(F.lag("over").over(doc), F.lit(False)))
    return rows.withColumn("grp", F.sum(begins.cast("int")).over(upto))


def rag_chunks(elements: DataFrame, max_tokens: int = MAX_TOKENS, profile: str = "default") -> DataFrame:
    """doc_id, chunk_id, text, paragraph_indices, element_types, heading_context, token_estimate, is_oversized, source_positions.

    Elements gather under a heading without a cap; one that alone exceeds the
    budget is split at sentences. Headings are never split.
    """
    rows = chunk_rows(apply_profile(elements, profile), max_tokens)
    # an oversized element is alone in its group; chunks before a group are its number and what such elements have beyond one
    rows = rows.withColumn("pieces", F.when(F.col("over"), pack_sentences(split_sentences(F.col("text")), max_tokens)))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("more", F.coalesce(F.sum(F.when(F.col("over"), F.size("pieces") - 1)).over(before), F.lit(0)))
    rows = rows.withColumn("text", F.when(F.col("over"), F.lit(None)).otherwise(F.col("text")))  # its pieces stand for it
    parts = F.array_sort(F.collect_list(F.struct("pos", "kind", "text", "source_pos", "stack")))
    groups = rows.groupBy("doc_id", "grp").agg(parts.alias("p"), F.max("over").alias("over"), F.max("more").alias("more"), F.first("pieces", ignorenulls=True).alias("pieces"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    fragments = F.when(F.col("over"), F.col("pieces")).otherwise(F.array(text))
    pieces = groups.select("doc_id", "grp", "more", "p", "over", F.posexplode(fragments).alias("k", "text"))
    pieces = pieces.withColumn("chunk_id", (F.col("grp") + F.col("more") + F.col("k")).cast("int"))
    return pieces.select(
        "doc_id", "chunk_id", "text", F.transform("p", lambda x: x["pos"]).alias("paragraph_indices"), F.transform("p", lambda x: x["kind"]).alias("element_types"),
        F.get("p", F.size("p") - 1)["stack"].alias("heading_context"), estimate_tokens(F.col("text")).alias("token_estimate"), F.col("over").alias("is_oversized"), F.transform("p", lambda x: x["source_pos"]).alias("source_positions"),
    )


class Chunker:
    """Chunking options that can be set one by one."""

    def __init__(self, max_tokens: int = MAX_TOKENS, profile: str = "default"):
        self.max_tokens, self.profile = max_tokens, profile

    def with_max_tokens(self, max_tokens: int) -> Chunker:
        return Chunker(max_tokens, self.profile)

    def with_profile(self, profile: str) -> Chunker:
        return Chunker(self.max_tokens, profile)

    def chunk(self, elements: DataFrame) -> DataFrame:
        return rag_chunks(elements, self.max_tokens, self.profile)
