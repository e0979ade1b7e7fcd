"""Style inheritance: properties merged along based-on chains, root first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import let
from ..sources import guards
from ..sources.dealing import dealt

MAX_DEPTH = guards.MAX_CHAIN
RUN_FIELDS = ("font_size_half_points", "color", "bold", "italic", "underline", "strikethrough")

_STATE = (
    "struct<cur:string,seen:array<string>,error:string,num_pr:struct<num_id:bigint,ilvl:int>,outline_level:int,"
    "rpr:struct<bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,font_size_half_points:bigint,color:string>>"
)
_RPR = ("bold", "italic", "underline", "strikethrough", "font_size_half_points", "color")


def style_map(styles: Column) -> Column:
    return F.map_from_entries(F.transform(F.coalesce(styles, F.array()), lambda s: F.struct(s["style_id"], s)))


def resolve_chain(known: Column, style_id: Column) -> Column:
    """Walks from a style to its root; nearer styles win, field by field.

    The result's error is circular_style or style_chain_too_deep, else null. A
    parent that is not known ends the chain, unless the limit is reached first.
    """
    start = F.struct(style_id.alias("cur"), F.array().cast("array<string>").alias("seen"), *(F.lit(None).alias(x) for x in ("error", "num_pr", "outline_level", "rpr"))).cast(_STATE)

    def step(a: Column, _: Column) -> Column:
        def visit(s: Column) -> Column:
            rpr = F.struct(*(F.coalesce(a["rpr"][x], s["rpr"][x]).alias(x) for x in _RPR))
            fields = (
                s["based_on"].alias("cur"),
                F.array_append(a["seen"], a["cur"]).alias("seen"),
                F.lit(None).alias("error"),
                F.coalesce(a["num_pr"], s["ppr"]["num_pr"]).alias("num_pr"),
                F.coalesce(a["outline_level"], s["ppr"]["outline_level"]).alias("outline_level"),
                rpr.alias("rpr"),
            )
            return F.when(s.isNotNull(), F.struct(*fields).cast(_STATE)).otherwise(ended(None))

        def ended(error: str | None) -> Column:
            kept = (a[c].alias(c) for c in ("num_pr", "outline_level", "rpr"))
            return F.struct(F.lit(None).alias("cur"), a["seen"].alias("seen"), F.lit(error).alias("error"), *kept).cast(_STATE)

        return (
            F.when(a["cur"].isNull(), a).when(F.size(a["seen"]) >= MAX_DEPTH, ended("style_chain_too_deep")).when(F.array_contains(a["seen"], a["cur"]), ended("circular_style"))
            .otherwise(let(F.try_element_at(known, a["cur"]), visit))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(MAX_DEPTH)), start, step)


def chains_of(known: Column, style_ids: Column) -> Column:
    """A map of the style ids that occur to their resolved chains: each chain is walked once, however many items use it."""
    used = F.array_distinct(F.filter(style_ids, lambda x: x.isNotNull()))
    return F.map_from_entries(F.transform(used, lambda x: F.struct(x, resolve_chain(known, x))))


_ROW = "doc_id string, style_id string, name string, based_on string, num_pr struct<num_id:bigint,ilvl:int>, outline_level int, bold boolean, italic boolean, underline boolean, strikethrough boolean, font_size_half_points bigint, color string"
RESOLVED = (
    "doc_id string, style_id string, name string, depth int, error string, num_pr struct<num_id:bigint,ilvl:int>, outline_level int, "
    "rpr struct<bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,font_size_half_points:bigint,color:string>"
)
_UNKNOWN, _ENDS = -2, -1
_SLICE = 1 << 14


def _walk(base: np.ndarray, given: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of styles by number: depths, faults (0 none, 1 circular, 2 too deep), and the nearest style that gives each field, or -1.

    base has each style's parent, or _ENDS, or _UNKNOWN. All chains take a step together.
    """
    n = len(base)
    depth, fault = np.zeros(n, np.int32), np.zeros(n, np.int8)
    nearest = {f: np.full(n, -1, np.int64) for f in given}
    walker = at = np.arange(n)
    for hop in range(MAX_DEPTH):
        depth[walker] = hop + 1
        for f, has in given.items():
            found = has[at] & (nearest[f][walker] < 0)
            nearest[f][walker[found]] = at[found]
        at = base[at]
        goes_on = at >= 0 if hop + 1 < MAX_DEPTH else at != _ENDS
        walker, at = walker[goes_on], at[goes_on]
    # these go on beyond the limit; one that came by a style again had met all of its chain
    for k in range(0, len(walker), _SLICE):
        some = walker[k : k + _SLICE]
        path = np.empty((MAX_DEPTH, len(some)), np.int64)
        path[0] = some
        for hop in range(1, MAX_DEPTH):
            path[hop] = base[path[hop - 1]]
        path.sort(axis=0)
        depth[some] = 1 + (path[1:] != path[:-1]).sum(axis=0)
        fault[some] = np.where(depth[some] < MAX_DEPTH, 1, 2)
    return depth, fault, nearest


def _of_document(rows: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The styles of one document with their chains resolved."""
    rows = rows.combine_chunks()
    ids = rows["style_id"]
    if ids.null_count or pc.count_distinct(ids).as_py() < len(ids):
        raise ValueError(f"document {rows['doc_id'][0]}: a style id is null or occurs twice")
    base = pc.index_in(rows["based_on"], value_set=ids)
    base = pc.if_else(pc.is_null(rows["based_on"]), _ENDS, pc.fill_null(base, _UNKNOWN)).to_numpy().astype(np.int64)
    fields = ("num_pr", "outline_level", *_RPR)
    depth, fault, nearest = _walk(base, {f: pc.is_valid(rows[f]).to_numpy() for f in fields})
    for k in range(0, len(rows), _SLICE):
        part = slice(k, k + _SLICE)
        own = rows.slice(k, _SLICE)
        found = {f: rows[f].take(pa.array(nearest[f][part], mask=nearest[f][part] < 0)).combine_chunks() for f in fields}
        error = pa.array(["circular_style", "style_chain_too_deep"]).take(pa.array(fault[part].astype(np.int64) - 1, mask=fault[part] == 0))
        rpr = pa.StructArray.from_arrays([found[f] for f in _RPR], fields=list(schema.field("rpr").type))
        columns = [*(own[c].combine_chunks() for c in ("doc_id", "style_id", "name")), pa.array(depth[part]), error, found["num_pr"], found["outline_level"], rpr]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _of_documents(schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            ends = [k for k in range(1, len(ids)) if ids[k] != ids[k - 1]]
            for begin, end in zip([0, *ends], [*ends, len(ids)], strict=True):
                if held and held[-1]["doc_id"][0].as_py() != ids[begin]:
                    yield from _of_document(pa.Table.from_batches(held), schema)
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from _of_document(pa.Table.from_batches(held), schema)

    return rows


def resolve_styles(styles: DataFrame) -> DataFrame:
    """Rows of styles (doc_id, style_id, name, based_on, ppr, rpr) with their chains resolved.

    doc_id, style_id, name, depth, error, num_pr, outline_level, rpr. Each
    document's styles meet as columns of one task, by number: its time and
    memory follow their count, and a chain costs no shuffle a hop.
    """
    rows = styles.select("doc_id", "style_id", "name", "based_on", "ppr.num_pr", "ppr.outline_level", *(f"rpr.{f}" for f in _RPR))
    schemas = [StructType.fromDDL(x) for x in (_ROW, RESOLVED)]
    rows = dealt(rows.select(*(F.col(f.name).cast(f.dataType) for f in schemas[0])), "doc_id")
    found = rows.sortWithinPartitions("doc_id").mapInArrow(_of_documents(to_arrow_schema(schemas[1])), schemas[1])
    return found.withColumn("doc_id", F.col("doc_id").cast(styles.schema["doc_id"].dataType))


def resolve_style_arrays(each: DataFrame) -> DataFrame:
    """The same for rows of (doc_id, styles array), as packages are parsed into."""
    return resolve_styles(each.select("doc_id", F.inline("styles")))


def merge_layers(*layers: Column) -> Column:
    """Run properties of several layers, lowest first: the highest that sets a field wins; unset toggles are off."""
    top = list(reversed(layers))
    toggles = ("bold", "italic", "underline", "strikethrough")
    return F.struct(*(F.coalesce(*(x[f] for x in top), *((F.lit(False),) if f in toggles else ())).alias(f) for f in RUN_FIELDS))


def run_formatting(parsed: DataFrame) -> DataFrame:
    """Effective formatting of each run of body paragraphs: defaults, style chain, list level, direct.

    doc_id, item_ord, inline_ord, run_ord, text, formatting.
    """

    def runs(chains: Column) -> Column:
        def of_item(item: Column, i: Column) -> Column:
            def of_style(chain: Column) -> Column:
                number = F.coalesce(item["ppr"]["num_pr"], chain["num_pr"], F.col("defaults.ppr.num_pr"))
                named = lambda x: F.exists(F.col("nums"), lambda y: (y["num_id"] == number["num_id"]) & (y["abstract_num_id"] == x["abstract_num_id"]))
                found = F.filter(F.col("levels"), lambda x: (x["ilvl"] == number["ilvl"]) & named(x))

                def of_level(level: Column) -> Column:
                    def one(r: Column, j: Column, k: Column) -> Column:
                        formatting = merge_layers(F.col("defaults.rpr"), chain["rpr"], level["rpr"], r)
                        return F.struct(i.alias("item_ord"), j.alias("inline_ord"), k.alias("run_ord"), r["text"].alias("text"), formatting.alias("formatting"))

                    return F.flatten(F.transform(item["inlines"], lambda x, j: F.transform(x["runs"], lambda r, k: one(r, j, k))))

                return let(F.get(found, F.lit(0)), of_level)

            return let(F.try_element_at(chains, item["ppr"]["style_id"]), of_style)

        numbered = F.transform("items", lambda item, i: F.struct(item.alias("item"), ((F.col("begin") + F.col("first")).cast("int") + i).alias("i")))
        return F.flatten(F.transform(F.filter(numbered, lambda x: x["item"]["kind"] == "paragraph"), lambda x: of_item(x["item"], x["i"])))

    used = lambda m: chains_of(m, F.transform("items", lambda x: x["ppr"]["style_id"]))
    return parsed.where("open_error IS NULL AND element_error IS NULL").select("doc_id", F.inline(let(let(style_map(F.col("styles")), used), runs)))
