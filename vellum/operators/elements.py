"""Packages to the ordered stream of semantic elements.

Lookups within a document (styles, numbering, links, notes, header and footer
parts) are resolved inside its staging row, before anything is exploded: they
move no data. What is left are ordered scans under one partitioning by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_of_name, heading_of_outline, let, list_type
from ..sources.dealing import dealt
from ..sources.package import ITEM
from . import numbering, styles

LINKS = "array<struct<text:string,url:string>>"
ROWS = "array<struct<cells:array<struct<text:string,col_span:int,row_span:int>>>>"
LEAF = f"kind:string,text:string,level:int,list_type:string,num_fmt:string,display_index:bigint,parent_heading:struct<level:int,text:string>,links:{LINKS},rows:{ROWS},note_id:bigint,author:string,url:string"
CONTENT = f"array<struct<{LEAF}>>"
_LEAF_NAMES = ("kind", "text", "level", "list_type", "num_fmt", "display_index", "parent_heading", "links", "rows", "note_id", "author", "url")
COLUMNS = ("doc_id", "pos", "kind", "text", "level", "parent_heading", "links", "list_type", "num_fmt", "display_index", "rows", "note_id", "author", "url", "slot", "content")


def link_url(rel_target: Column, anchor: Column) -> Column:
    """The relationship's target if there is one, else the place in the document, else null."""
    return F.coalesce(F.nullif(rel_target, F.lit("")), F.concat(F.lit("#"), anchor))


def _placed(normalise_targets: bool) -> Column:
    """Items of the body, and behind each section break the items of the parts it refers to.

    Places count on from the packages and pieces before.
    """
    before = F.col("begin") + F.col("first")
    targets = F.map_from_entries(F.transform("rels", lambda r: F.struct(r["rel_id"], r["target"])))
    bodies = F.map_from_entries(F.transform("part_items", lambda p: F.struct(p["part"], p["items"])))

    def at(scope, host, klass, ref, slot, k, item) -> Column:
        names = ("scope", "host", "class", "ref", "slot", "at", "item")
        return F.struct(*(x.alias(n) for x, n in zip((scope, host, klass, ref, slot, k.cast("long"), item), names, strict=True)))

    def of_section(item: Column, i: Column, which: str, klass: int, t: Column, b: Column) -> Column:
        refs = F.filter(item["sections"], lambda s: s["which"] == which)

        def one(s: Column, n: Column) -> Column:
            target = F.try_element_at(t, s["rel_id"])
            if normalise_targets:
                target = F.regexp_replace(F.regexp_replace(target, "^/word/", ""), "^\\.\\./word/|^\\./", "")
            part = F.concat(F.lit("word/"), target)
            scope = F.concat_ws(":", i.cast("string"), F.lit(which), n.cast("string"))
            head = at(scope, i, F.lit(klass), n, s["slot"], F.lit(-1), F.lit(None).cast(ITEM))
            items = F.when(part.rlike(f"^word/{which}[0-9]+\\.xml$"), F.try_element_at(b, part))
            content = F.transform(items, lambda x, k: at(scope, i, F.lit(klass), n, s["slot"], k, x))
            return F.when(items.isNotNull(), F.concat(F.array(head), content))

        return F.flatten(F.filter(F.transform(refs, one), lambda x: x.isNotNull()))

    def every(t: Column, b: Column) -> Column:
        def each(item: Column, i: Column) -> Column:
            i = before + i
            own = F.array(at(F.lit(""), i, F.lit(0), F.lit(0), F.lit(None).cast("string"), i, item))
            sections = F.concat(of_section(item, i, "header", 1, t, b), of_section(item, i, "footer", 2, t, b))
            return F.when(item["kind"] == "section", sections).otherwise(own)

        return F.flatten(F.transform("items", each))

    return let(targets, lambda t: let(bodies, lambda b: every(t, b)))


def _resolved(placed: Column, honor_start_override: bool) -> Column:
    """Placed items with their style, list level, links and notes looked up."""
    return let(placed, lambda items: _looked_up(items, honor_start_override))


def _looked_up(items: Column, honor_start_override: bool) -> Column:
    known = styles.style_map(F.col("styles"))
    nums = F.map_from_entries(F.transform("nums", lambda n: F.struct(n["num_id"], n)))
    levels = F.map_from_entries(F.transform("levels", lambda x: F.struct(F.struct(x["abstract_num_id"].alias("a"), x["ilvl"].alias("l")), x)))
    targets = F.map_from_entries(F.transform("rels", lambda r: F.struct(r["rel_id"], r["target"])))
    notes = F.map_from_entries(F.transform("notes", lambda n: F.struct(F.struct(n["note_kind"].alias("k"), n["note_id"].alias("i")), F.struct(n["author"].alias("author"), n["text"].alias("text")))))

    def every(s: Column, chains: Column, n: Column, lv: Column, t: Column, nt: Column) -> Column:
        def each(x: Column) -> Column:
            item, ppr = x["item"], x["item"]["ppr"]

            def with_chain(chain: Column) -> Column:
                number = F.coalesce(ppr["num_pr"], chain["num_pr"], F.col("defaults.ppr.num_pr"))
                outline = F.coalesce(ppr["outline_level"], chain["outline_level"], F.col("defaults.ppr.outline_level"))
                heading = F.coalesce(heading_of_outline(outline), heading_of_name(F.try_element_at(s, ppr["style_id"])["name"]))

                def with_num(num: Column) -> Column:
                    level = F.try_element_at(lv, F.struct(num["abstract_num_id"].alias("a"), number["ilvl"].alias("l")))

                    def found(v: Column) -> Column:
                        start = numbering.start_with_override(v, num["overrides"], honor_start_override)
                        return F.struct(number["num_id"].alias("num_id"), v["ilvl"].alias("ilvl"), start.alias("start"), v["num_fmt"].alias("num_fmt"))

                    return let(level, lambda v: F.when(v.isNotNull(), found(v)))

                listed = F.when(number.isNotNull(), let(F.try_element_at(n, number["num_id"]), with_num))
                return F.struct(listed.alias("list"), heading.cast("int").alias("heading"), chain["error"].alias("error"))

            link = lambda i: F.struct(i["text"].alias("text"), link_url(F.when(i["rel_id"].isNotNull(), F.try_element_at(t, i["rel_id"])), i["anchor"]).alias("url"))
            links = F.filter(F.transform(F.filter(item["inlines"], lambda i: i["kind"] == "link"), link), lambda i: i["url"].isNotNull())
            key = lambda r: F.struct(r["note_kind"].alias("k"), r["note_id"].alias("i"))
            note = lambda r: F.struct(r["note_kind"].alias("kind"), r["note_id"].alias("note_id"), F.try_element_at(nt, key(r)).alias("n"))
            found = F.filter(F.transform(item["refs"], note), lambda r: r["n"].isNotNull())
            of_kind = lambda k: F.filter(found, lambda r: r["kind"] == k)
            ordered = F.concat(*(of_kind(k) for k in ("footnote", "endnote", "comment")))
            is_paragraph = item["kind"] == "paragraph"
            style = F.when(is_paragraph, let(F.try_element_at(chains, ppr["style_id"]), with_chain))
            fields = (
                *(x[f].alias(f) for f in ("scope", "host", "class", "ref", "slot", "at")), item["kind"].alias("kind"), style.alias("style"), links.alias("links"), ordered.alias("notes"),
                F.array_join(F.transform(item["inlines"], lambda i: F.coalesce(i["text"], F.lit(""))), "").alias("text"), item["table"].alias("rows"),
            )
            return F.struct(*fields)

        return F.transform(items, each)

    used = lambda s: styles.chains_of(s, F.transform(items, lambda x: x["item"]["ppr"]["style_id"]))
    looked_up = lambda s, c: let(nums, lambda n: let(levels, lambda lv: let(targets, lambda t: let(notes, lambda nt: every(s, c, n, lv, t, nt)))))
    return let(known, lambda s: let(used(s), lambda c: looked_up(s, c)))


def resolved_items(parsed: DataFrame, honor_start_override: bool = False, normalise_targets: bool = False) -> DataFrame:
    """doc_id and an array of placed and resolved items for each piece of the packages that parsed."""
    good = parsed.where("open_error IS NULL AND element_error IS NULL")
    return good.select("doc_id", _resolved(_placed(normalise_targets), honor_start_override).alias("items"))


def _style_error(items: Column) -> Column:
    return F.get(F.filter(F.transform(items, lambda x: x["style"]["error"]), lambda e: e.isNotNull()), F.lit(0))


def style_errors(parsed: DataFrame) -> DataFrame:
    """doc_id, kind of packages whose paragraphs use a circular or too deep style chain; they have no elements."""
    return resolved_items(parsed).select("doc_id", _style_error(F.col("items")).alias("kind")).where("kind IS NOT NULL")


def classify(items: DataFrame, order: Sequence[str] = ("scope", "at")) -> DataFrame:
    """Rows (doc_id, scope, at, kind, text, list, heading, links) to elements' columns.

    Numbering comes before headings, so a numbered heading is a list item. A
    paragraph carries the last heading before it; a list item and a table do
    not, and do not end it. The order is one of a document's rows in which those
    of a scope stand by at; only the body's, of scope "", may have others between.
    """
    scope = ["doc_id", "scope"]
    kind = F.when(F.col("kind") != "paragraph", F.col("kind"))
    kind = kind.when(F.col("list").isNotNull(), "list_item").when(F.col("heading").isNotNull(), "heading").otherwise("paragraph")
    rows = items.withColumn("kind", kind)
    rows = rows.select("*", "list.num_id", "list.ilvl", "list.start", "list.num_fmt").withColumn("list_type", F.when(F.col("kind") == "list_item", list_type(F.col("num_fmt"))))
    rows = numbering.list_indexes(rows, scope, ["at"])
    before = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    of_body = F.col("scope") == ""
    last = lambda here: F.last(F.when((F.col("kind") == "heading") & here, F.struct("scope", F.col("heading").alias("level"), "text")), ignorenulls=True).over(before)
    rows = rows.withColumn("_heading", F.when(of_body, last(of_body)).otherwise(last(~of_body)))
    heading = F.when(F.col("_heading.scope") == F.col("scope"), F.struct("_heading.level", "_heading.text"))
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    return rows.select(
        "*",
        F.when(is_("heading"), F.col("heading")).when(is_("list_item"), F.col("ilvl")).cast("int").alias("level"),
        F.when(is_("paragraph"), heading).alias("parent_heading"),
        F.when(is_("paragraph"), F.col("links")).alias("_links"),
        F.when(is_("list_item"), F.col("display_index")).alias("_index"),
        F.when(is_("list_item"), F.col("num_fmt")).alias("_fmt"),
    ).drop("links", "display_index", "num_fmt", "_heading").withColumnsRenamed({"_links": "links", "_index": "display_index", "_fmt": "num_fmt"})


def elements(parsed: DataFrame, honor_start_override: bool = False, normalise_targets: bool = False) -> DataFrame:
    """The element stream of parsed packages, ordered by (doc_id, pos).

    Rows are dealt by document once; every window below is within a document,
    so nothing else is shuffled, and parsed is read once. But for list indexes,
    the windows share one sort, by place: a task holds its rows in few sorts.
    """
    good = parsed.where("open_error IS NULL AND element_error IS NULL")
    # in one expression, so that the items are resolved once
    sound = let(_resolved(_placed(normalise_targets), honor_start_override), lambda x: F.when(_style_error(x).isNull(), x))
    rows = dealt(good.select("doc_id", F.inline(sound)), "doc_id")
    place = ["host", "class", "ref", "at"]
    found = classify(rows.select("*", "style.list", "style.heading").drop("style"), place)

    none = {"note_id": "bigint", "author": "string", "url": "string", "level": "int", "list_type": "string", "num_fmt": "string", "display_index": "bigint"}
    none |= {"parent_heading": "struct<level:int,text:string>", "links": LINKS, "rows": ROWS}
    null = lambda c: F.lit(None).cast(none[c]).alias(c)

    def leaf(sub: Column, known: dict[str, Column]) -> Column:
        return F.struct(sub.alias("sub"), *(known[c].alias(c) if c in known else null(c) for c in _LEAF_NAMES))

    own = {c: F.col(c) for c in ("kind", "level", "list_type", "num_fmt", "display_index", "parent_heading", "links")}
    own |= {"text": F.when(F.col("kind") != "table", F.col("text")), "rows": F.col("rows").cast(ROWS)}
    note = lambda n, k: leaf(k + 1, {"kind": n["kind"], "text": n["n"]["text"], "note_id": n["note_id"], "author": n["n"]["author"]})
    each = F.concat(F.array(leaf(F.lit(0), own)), F.transform(F.coalesce("notes", F.array()), note))
    found = found.withColumn("_each", each)

    # a section's head row takes up the rows of its part, in order
    section = Window.partitionBy("doc_id", *place[:-1]).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_part, is_head = F.col("class") > 0, F.col("at") < 0
    leaves = F.transform("_each", lambda x: F.struct(*(x[c].alias(c) for c in _LEAF_NAMES)))
    content = F.flatten(F.collect_list(F.when(is_part & ~is_head, leaves)).over(section))
    # places count the rows before and their notes, so they are known before the rows are made
    before = Window.partitionBy("doc_id").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.when(~is_part | is_head, F.size("_each")).otherwise(0)).over(before), F.lit(0))
    found = found.withColumn("_first", first).withColumn("content", F.when(is_part, content).cast(CONTENT)).where(~is_part | is_head)
    flat = found.select("doc_id", "class", "slot", "_first", "content", F.inline("_each"))
    kind = F.when(F.col("class") == 1, "header").when(F.col("class") == 2, "footer").otherwise(F.col("kind"))
    return flat.withColumn("kind", kind).withColumn("pos", (F.col("_first") + F.col("sub")).cast("int")).select(*COLUMNS)


def links(parsed: DataFrame) -> DataFrame:
    """All links, also those of headings and list items: doc_id, scope, at, ord, text, url."""
    rows = resolved_items(parsed).select("doc_id", F.inline("items")).select("doc_id", "scope", "at", F.posexplode("links").alias("ord", "link"))
    return rows.select("doc_id", "scope", "at", "ord", "link.text", "link.url")
