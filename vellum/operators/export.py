"""Plain text and Markdown of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined, markdown, plain, section_markdown, section_plain


def _render(elements: DataFrame, leaf, section) -> Column:
    kind = F.col("kind")
    own = leaf(kind, F.col)
    if "content" not in elements.columns:
        return F.coalesce(own, F.lit(""))
    inner = F.transform(F.coalesce("content", F.array()), lambda c: F.struct(c["kind"].alias("kind"), F.coalesce(leaf(c["kind"], lambda n: c[n]), F.lit("")).alias("text")))
    whole = F.when(kind.isin("header", "footer"), section(F.initcap(kind), joined(inner)))
    return F.coalesce(whole, own, F.lit(""))


def rendered(elements: DataFrame, form: str) -> Column:
    """Each element as Markdown or plain text, as a column over the elements."""
    return _render(elements, markdown, section_markdown) if form == "markdown" else _render(elements, plain, section_plain)


def _documents(elements: DataFrame, leaf, section, name: str) -> DataFrame:
    rows = elements.select("doc_id", "pos", "kind", _render(elements, leaf, section).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "kind", "text")))
    return rows.groupBy("doc_id").agg(parts.alias("p")).select("doc_id", joined(F.transform("p", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text")))).alias(name))


def plain_elements(elements: DataFrame) -> DataFrame:
    return elements.select("doc_id", "pos", "kind", _render(elements, plain, section_plain).alias("plain"))


def markdown_elements(elements: DataFrame) -> DataFrame:
    return elements.select("doc_id", "pos", "kind", _render(elements, markdown, section_markdown).alias("markdown"))


def plain_text(elements: DataFrame) -> DataFrame:
    """doc_id, plain_text."""
    return _documents(elements, plain, section_plain, "plain_text")


def to_markdown(elements: DataFrame) -> DataFrame:
    """doc_id, markdown."""
    return _documents(elements, markdown, section_markdown, "markdown")
