"""Scalar functions on texts and elements, as column expressions.

White space is Unicode white space; a token estimate is three halves of the
words, rounded up; a sentence ends after . ! or ? before one space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "(?U)\\S+"
EDGES = "(?U)^\\s+|\\s+$"


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def estimate_tokens(text: Column) -> Column:
    return F.floor((3 * F.regexp_count(text, F.lit(WORD)) + 1) / 2).cast("long")


def split_sentences(text: Column) -> Column:
    pieces = F.transform(F.split(text, "(?<=[.!?]) ", -1), lambda x: F.regexp_replace(x, EDGES, ""))
    return F.filter(pieces, lambda x: x != "")


def pack_sentences(sentences: Column, max_tokens: int) -> Column:
    """Greedy fragments of sentences: a new one begins where the estimates would exceed the budget."""
    sized = F.transform(sentences, lambda s: F.struct(s.alias("s"), estimate_tokens(s).alias("n")))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        full = (a["now"] != "") & (a["n"] + x["n"] > max_tokens)
        kept = F.struct(a["out"].alias("out"), F.when(a["now"] == "", x["s"]).otherwise(F.concat(a["now"], F.lit(" "), x["s"])).alias("now"), (a["n"] + x["n"]).alias("n"))
        return F.when(full, F.struct(F.array_append(a["out"], a["now"]).alias("out"), x["s"].alias("now"), x["n"].alias("n"))).otherwise(kept)

    return F.aggregate(sized, empty, step, lambda a: F.when(a["now"] != "", F.array_append(a["out"], a["now"])).otherwise(a["out"]))


def table_text(rows: Column) -> Column:
    """Cells joined by bars, rows by line feeds."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r["cells"], lambda c: c["text"]), " | ")), "\n")


def table_markdown(rows: Column) -> Column:
    """The first row as header; spans are ignored and nothing is escaped."""

    def line(row: Column) -> Column:
        return F.when(F.size(row["cells"]) == 0, F.lit("|")).otherwise(F.concat(F.lit("| "), F.array_join(F.transform(row["cells"], lambda c: c["text"]), " | "), F.lit(" |")))

    def whole(r: Column) -> Column:
        head = F.get(r, F.lit(0))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(head["cells"])))
        return F.array_join(F.concat(F.array(line(head), rule), F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), line)), "\n")

    return F.when(F.size(rows) > 0, let(rows, whole)).otherwise("")


def linked_markdown(text: Column, links: Column) -> Column:
    """Each link's text, found left to right, as a Markdown link; a link whose text is not found is left out."""
    start = F.struct(F.lit("").alias("out"), text.alias("rest"))

    def step(a: Column, x: Column) -> Column:
        found = F.greatest(F.call_function("locate", x["text"], a["rest"]), F.lit(1))
        out = F.concat(a["out"], F.substr(a["rest"], F.lit(1), found - 1), F.lit("["), x["text"], F.lit("]("), x["url"], F.lit(")"))
        moved = F.struct(out.alias("out"), F.substr(a["rest"], found + F.length(x["text"])).alias("rest"))
        return F.when((F.call_function("locate", x["text"], a["rest"]) > 0) | (x["text"] == ""), moved).otherwise(a)

    return F.when(F.size(links) > 0, F.aggregate(links, start, step, lambda a: F.concat(a["out"], a["rest"]))).otherwise(text)


def heading_markdown(level: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6))), F.lit(" "), text)


def list_item_markdown(text: Column, level: Column, list_type: Column, index: Column) -> Column:
    mark = F.when((list_type == "decimal") & index.isNotNull(), F.concat(index.cast("string"), F.lit("."))).otherwise("-")
    return F.concat(F.repeat(F.lit("  "), level), mark, F.lit(" "), text)


def section_markdown(title: Column, body: Column) -> Column:
    lines = F.transform(F.split(F.regexp_replace(body, "\\n$", ""), "\\r?\\n", -1), lambda x: F.concat(F.lit("\n> "), x))
    return F.concat(F.lit("> ["), title, F.lit("]"), F.when(body == "", "").otherwise(F.array_join(lines, "")))


def section_plain(title: Column, body: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit("]"), F.when(body == "", "").otherwise(F.concat(F.lit("\n"), body)))


def list_type(num_fmt: Column) -> Column:
    """decimal, bullet, lower_roman, none; all else is other, with num_fmt beside it."""
    return F.when(num_fmt.isin("decimal", "bullet", "none"), num_fmt).when(num_fmt == "lowerRoman", "lower_roman").otherwise("other")


def heading_of_outline(outline: Column) -> Column:
    return F.when(outline.between(0, 8), outline + 1).cast("int")


def heading_of_name(name: Column) -> Column:
    """A style named "heading 1" to "heading 9", in any case."""
    found = F.regexp_extract(F.lower(name), "^heading ([1-9])", 1)
    return F.when(found != "", found.cast("int"))


def image_type(data: Column) -> Column:
    """The content type that the first bytes tell."""
    begins = lambda hexed: F.startswith(data, F.unhex(F.lit(hexed)))
    webp = begins("52494646") & (F.substr(data, F.lit(9), F.lit(4)) == F.unhex(F.lit("57454250")))
    return (
        F.when(begins("89504E470D0A1A0A"), "image/png").when(begins("FFD8FF"), "image/jpeg").when(begins("474946383761") | begins("474946383961"), "image/gif")
        .when(begins("424D"), "image/bmp").when(webp, "image/webp").otherwise("application/octet-stream")
    )


# -- one element as text; columns as in the elements table ---------------------


def plain(kind: Column, e) -> Column:
    """Plain text of a leaf element; e(name) gives its columns."""
    number = e("note_id").cast("string")
    return (
        F.when(kind.isin("paragraph", "heading", "list_item", "hyperlink"), e("text")).when(kind == "table", table_text(e("rows")))
        .when(kind == "footnote", F.concat(F.lit("["), number, F.lit("] "), e("text"))).when(kind == "endnote", F.concat(F.lit("[endnote "), number, F.lit("] "), e("text")))
        .when(kind == "comment", F.concat(F.lit("[comment "), number, F.lit(" by "), e("author"), F.lit("] "), e("text")))
    )


def markdown(kind: Column, e) -> Column:
    """Markdown of a leaf element."""
    number = e("note_id").cast("string")
    return (
        F.when(kind == "paragraph", linked_markdown(e("text"), e("links"))).when(kind == "heading", heading_markdown(e("level"), e("text")))
        .when(kind == "list_item", list_item_markdown(e("text"), e("level"), e("list_type"), e("display_index"))).when(kind == "table", table_markdown(e("rows")))
        .when(kind == "footnote", F.concat(F.lit("[^"), number, F.lit("]: "), e("text"))).when(kind == "endnote", F.concat(F.lit("[^endnote"), number, F.lit("]: "), e("text")))
        .when(kind == "comment", F.concat(F.lit("> **Comment "), number, F.lit(" ("), e("author"), F.lit("):** "), e("text")))
        .when(kind == "hyperlink", F.concat(F.lit("["), e("text"), F.lit("]("), e("url"), F.lit(")")))
    )


def joined(parts: Column) -> Column:
    """Rendered elements as one text: list items that follow each other stand tight, others apart.

    parts: array<struct<kind, text>> in order. Nothing separates while all before is empty.
    """

    def whole(p: Column, first: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            tight = (x["kind"] == "list_item") & (F.get(p, i - 1)["kind"] == "list_item")
            return F.concat(F.when((i == 0) | (first == 0) | (i < first), "").when(tight, "\n").otherwise("\n\n"), x["text"])

        return F.array_join(F.transform(p, piece), "")

    return let(parts, lambda p: let(F.array_position(F.transform(p, lambda x: x["text"] != ""), True), lambda first: whole(p, first)))
