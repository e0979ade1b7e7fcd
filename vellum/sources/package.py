"""Word packages as rows: a scan, unpacking under limits, and parsing into nested staging columns.

Only unzipping and XML events run in Python, once for each package; everything
after is DataFrame expressions over the staging columns. A package with a long
body becomes several rows, its pieces, so that no row grows with the body; each
has the lookups that its items need, and the last has all. Media are unpacked by
an operator of their own, so that text queries do not read images.
"""

from __future__ import annotations

import functools
import io
import math
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import guards, ooxml, writer
from .guards import PackageError

RPR = "struct<bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,font_size_half_points:bigint,color:string,highlight:string,vertical_align:string>"
PPR = "struct<style_id:string,num_pr:struct<num_id:bigint,ilvl:int>,alignment:string,outline_level:int,keep_next:boolean,page_break_before:boolean>"
RUN = "struct<text:string," + RPR.removeprefix("struct<")
ITEM = (
    f"struct<kind:string,ppr:{PPR},inlines:array<struct<kind:string,rel_id:string,anchor:string,text:string,runs:array<{RUN}>>>,refs:array<struct<note_kind:string,note_id:bigint>>,"
    "rows:int,cells:array<struct<row:int,cell:int,grid_span:int,v_merge:string,width:bigint,text:string>>,table:array<struct<cells:array<struct<text:string,col_span:int,row_span:int>>>>,sections:array<struct<which:string,rel_id:string,slot:string>>>"
)
ERROR = "struct<kind:string,part:string,detail:string>"
PARSED = (
    f"doc_id string, begin bigint, first bigint, last boolean, entries array<string>, open_error {ERROR}, element_error {ERROR}, items array<{ITEM}>, "
    f"part_items array<struct<part:string,items:array<{ITEM}>>>, "
    f"styles array<struct<style_id:string,name:string,type:string,based_on:string,next_style:string,is_default:boolean,ppr:{PPR},rpr:{RPR}>>, "
    f"defaults struct<ppr:{PPR},rpr:{RPR}>, nums array<struct<num_id:bigint,abstract_num_id:bigint,overrides:array<struct<ilvl:int,start_override:bigint>>>>, "
    f"levels array<struct<abstract_num_id:bigint,ilvl:int,start:bigint,num_fmt:string,level_text:string,rpr:{RPR}>>, "
    "notes array<struct<note_kind:string,note_id:bigint,author:string,text:string>>, rels array<struct<rel_id:string,rel_type:string,target:string,is_external:boolean>>, "
    "content_types array<struct<kind:string,key:string,content_type:string>>"
)
PARTS = "doc_id string, part_name string, size bigint, compressed_size bigint, bytes binary, error " + ERROR
_SECTION_PART = re.compile(r"word/(header|footer)[0-9]+\.xml")


class Archive:
    """A package in memory, read under the limits."""

    def __init__(self, content: bytes):
        try:
            self._zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, NotImplementedError, EOFError) as e:
            raise PackageError("zip", "", str(e)) from None
        self.names = [x.filename for x in self._zip.infolist() if not x.is_dir()]
        guards.check_count(len(self._zip.infolist()))
        self.total = 0

    def info(self, name: str) -> zipfile.ZipInfo:
        guards.check_path(name)
        try:
            return self._zip.getinfo(name)
        except KeyError:
            raise PackageError("missing_part", name, "no such entry") from None

    def read(self, name: str) -> bytes:
        x = self.info(name)
        guards.check_entry(name, x.file_size, x.compress_size, self.total)
        try:
            with self._zip.open(x) as f:
                data = f.read(x.file_size + 1)
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError) as e:
            raise PackageError("zip", name, str(e)) from None
        except Exception as e:  # zlib.error has no common base with the others
            raise PackageError("zip", name, str(e)) from None
        if len(data) > x.file_size:
            raise PackageError("zip_bomb", name, "longer than declared")
        self.total += len(data)
        return data

    def optional(self, name: str) -> bytes | None:
        """None where the entry is absent or unreadable, which counts as absent."""
        try:
            return self.read(name)
        except PackageError:
            return None


#: Bytes of a main part whose items make one row.
PIECE_BYTES = 4 * ooxml.BLOCK
#: Parts of at most so many bytes are kept with what was read from them, the last few of a kind.
SHARED_BYTES, SHARED = 1 << 16, 8


def _shared(read: Callable) -> Callable:
    """A reader that reads equal parts once, as documents of one template have them; nobody may change what it gives."""
    kept = functools.lru_cache(SHARED)(read)
    return lambda part, data: (kept if len(data) <= SHARED_BYTES else read)(part, data)


_content_types, _styles, _numbering = map(_shared, (ooxml.content_types, ooxml.styles, ooxml.numbering))


def _broken_chains(styles: list[dict]) -> bool:
    """Whether any style's chain is circular or too long to be followed."""
    base = {s["style_id"]: s["based_on"] for s in styles}
    depth: dict[str | None, int] = {}
    for key in base:
        path: list[str] = []
        while key in base and key not in depth and len(path) <= guards.MAX_CHAIN:
            path.append(key)
            key = base[key]
        for n, x in enumerate(reversed(path), 1 if key not in depth else 1 + depth[key]):
            depth[x] = n
    # an unknown parent of a chain of full length is beyond the limit, too
    return any(n >= guards.MAX_CHAIN for n in depth.values())


def _needed(items: list[dict], known: dict) -> dict:
    """Those of a package's lookups that some of its items refer to."""
    targets = {r["target"].rpartition("/")[2] for x in items for s in x.get("sections") or [] for r in known["rels"] if r["rel_id"] == s["rel_id"]}
    parts = [p for p in known["part_items"] if p["part"].rpartition("/")[2] in targets] if targets else []
    items = [*items, *(x for p in parts for x in p["items"])]
    base = {s["style_id"]: s for s in known["styles"]}
    used: set[str] = set()
    for x in items:
        key = (x.get("ppr") or {}).get("style_id")
        while key in base and key not in used:
            used.add(key)
            key = base[key]["based_on"]
    styles = [s for s in known["styles"] if s["style_id"] in used]
    numbers = [p["num_pr"]["num_id"] for p in (*(x.get("ppr") or {} for x in items), *(s["ppr"] for s in styles), (known["defaults"] or {}).get("ppr") or {}) if p.get("num_pr")]
    wanted = set(numbers)
    nums = [n for n in known["nums"] if n["num_id"] in wanted]
    abstract = {n["abstract_num_id"] for n in nums}
    rel_ids = {i["rel_id"] for x in items for i in x.get("inlines") or []} | {s["rel_id"] for x in items for s in x.get("sections") or []}
    note_ids = {(r["note_kind"], r["note_id"]) for x in items for r in x.get("refs") or []}
    return {
        "styles": styles, "defaults": known["defaults"], "nums": nums, "levels": [x for x in known["levels"] if x["abstract_num_id"] in abstract], "part_items": parts,
        "notes": [n for n in known["notes"] if (n["note_kind"], n["note_id"]) in note_ids], "rels": [r for r in known["rels"] if r["rel_id"] in rel_ids],
    }


def parse_package(doc_id: str | None, content: bytes | None, begin: int = 0, piece_bytes: float = PIECE_BYTES) -> Iterator[dict]:
    """Rows of staging columns, one for each piece of the body. Errors in opening, and in what elements need, are apart.

    begin is the number of items in the document's packages before, first that in the pieces before. A package with a style
    chain that fails is one row: its items fail together.
    """
    return (row for _, row in _sized_rows(doc_id, content, begin, piece_bytes))


def _sized_rows(doc_id: str | None, content: bytes | None, begin: int, piece_bytes: float) -> Iterator[tuple[int, dict]]:
    """The rows with about the bytes that each was read from: those of the package, whose names of entries it has, and of XML as unpacked."""
    packed = 1024 + len(content or b"")
    row: dict = {"doc_id": doc_id, "begin": begin, "first": 0, "last": True, "open_error": None, "element_error": None}
    try:
        if content is None:
            raise PackageError("io", "", "no content")
        archive = Archive(content)
        row["entries"] = [x for x in archive.names if guards.safe_path(x)]
        types = _content_types("[Content_Types].xml", archive.read("[Content_Types].xml"))
        row["content_types"] = types
        main = min((x["key"] for x in types if x["kind"] == "override" and x["content_type"] == ooxml.MAIN_TYPE), default=None)
        if main is None:
            raise PackageError("missing_part", "word/document.xml", "no main document part is declared")
        document = archive.read(main)
    except PackageError as e:
        yield packed, row | {"open_error": e.row()}
        return
    optional = archive.optional
    known: dict = {}
    short = None
    try:
        if len(document) <= ooxml.BLOCK:
            short = list(ooxml.body_pieces(main, document, "w:body"))
        else:  # too long to be held while its faults are looked for
            ooxml.check(main, document)
    except PackageError as e:
        yield packed, row | {"element_error": e.row()}
        return
    try:
        known["styles"], known["defaults"] = _styles("word/styles.xml", x) if (x := optional("word/styles.xml")) is not None else ([], None)
        known["nums"], known["levels"] = _numbering("word/numbering.xml", x) if (x := optional("word/numbering.xml")) is not None else ([], [])
        known["notes"] = [n for kind in ("footnote", "endnote", "comment") if (x := optional(f"word/{kind}s.xml")) is not None for n in ooxml.notes(f"word/{kind}s.xml", x, kind)]
        known["rels"] = ooxml.relationships("word/_rels/document.xml.rels", x) if (x := optional("word/_rels/document.xml.rels")) is not None else []
        known["part_items"] = [
            {"part": name, "items": ooxml.body(name, x, "w:hdr" if m[1] == "header" else "w:ftr")}
            for name in sorted(set(archive.names)) if (m := _SECTION_PART.fullmatch(name)) and (x := optional(name)) is not None
        ]
    except PackageError as e:
        row["element_error"] = e.row()
    whole = row["element_error"] is not None or (len(document) > piece_bytes and _broken_chains(known["styles"]))
    first, held, most = 0, None, math.inf if whole else piece_bytes
    for items in short if short is not None else ooxml.body_pieces(main, document, "w:body", most):
        if held is not None:
            yield int(most), row | _needed(held, known) | {"content_types": None, "entries": None, "last": False, "first": first, "items": held}
            first += len(held)
        held = items
    yield packed + archive.total - len(document) + int(min(len(document), most)), row | known | {"first": first, "items": held or []}


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


BATCH_BYTES = 2 << 20


def _in_batches(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows that come with their sizes, about BATCH_BYTES of them or one row at a time."""
    held, size = [], 0
    for n, row in rows:
        if held and size + n > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of packages, one at a time."""
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(x.as_py() for x in row)


def _parse_rows(schema: pa.Schema, piece_bytes: float, contents: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]] = _contents):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches((x for doc_id, content, begin in contents(batches) for x in _sized_rows(doc_id, content, begin, piece_bytes)), schema)

    return rows


def packages(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """doc_id, path, modification_time, length, content of the packages under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "path", F.col("modificationTime").alias("modification_time"), "length", "content")


def parse_packages(source: DataFrame, mode: str = "PERMISSIVE", piece_bytes: float = PIECE_BYTES) -> DataFrame:
    """Packages (doc_id, content; begin, if documents go on over several packages) to staging columns; mode as for Spark's own readers."""
    begin = (F.col("begin") if "begin" in source.columns else F.lit(0)).cast("long").alias("begin")
    parsed = source.select(F.col("doc_id").cast("string").alias("doc_id"), "content", begin).mapInArrow(_parse_rows(_arrow(PARSED), piece_bytes), PARSED)
    failed = F.coalesce("open_error", "element_error")
    if mode == "DROPMALFORMED":
        return parsed.where(failed.isNull())
    if mode == "FAILFAST":
        stop = F.raise_error(F.concat(F.lit("package "), F.col("doc_id"), F.lit(": "), failed["kind"], F.lit(" "), failed["part"]))
        return parsed.withColumn("doc_id", F.when(failed.isNotNull(), stop.cast("string")).otherwise(F.col("doc_id")))
    if mode != "PERMISSIVE":
        raise ValueError(mode)
    return parsed


def write_and_parse(stream: DataFrame, more: dict[str, str | bytes] | None = None, piece_bytes: float = PIECE_BYTES, volume_bytes: int = writer.VOLUME_BYTES) -> DataFrame:
    """The staging columns of writer.write_packages' packages; the worker that packed one parses it before it packs the next.

    So a core runs one worker, and no packages go to the JVM and back.
    """
    return writer.in_order(stream).mapInArrow(_parse_rows(_arrow(PARSED), piece_bytes, writer.packer(more, volume_bytes)), PARSED)


def _package_parts(doc_id: str | None, content: bytes | None, wanted: re.Pattern, with_bytes: bool, whole: bool) -> Iterator[tuple[int, dict]]:
    row = {"doc_id": doc_id, "part_name": None, "size": None, "compressed_size": None, "bytes": None, "error": None}
    try:
        archive = Archive(content or b"")
        names = sorted(x for x in set(archive.names) if wanted.search(x))
        if whole:  # all or nothing: each entry is read once before any is given
            for name in names:
                archive.read(name)
            archive = Archive(content or b"")
    except PackageError as e:
        yield 0, row | {"part_name": e.part or None, "error": e.row()}
        return
    for name in names:
        try:
            x = archive.info(name)
            data = archive.read(name) if with_bytes else None
            yield len(data or b""), row | {"part_name": name, "size": x.file_size, "compressed_size": x.compress_size, "bytes": data}
        except PackageError as e:
            yield 0, row | {"part_name": name, "error": e.row()}


def parts(source: DataFrame, pattern: str = "", with_bytes: bool = True, whole: bool = False) -> DataFrame:
    """Entries of packages whose name a pattern finds, by name.

    An entry that cannot be read has a row with its error, and the others
    follow; a package that cannot be opened has one row with the error. With
    whole, a package of which any such entry cannot be read has only that row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(pattern)
        yield from _in_batches((x for doc_id, content in _contents(batches) for x in _package_parts(doc_id, content, wanted, with_bytes, whole)), schema)

    schema = _arrow(PARTS)
    return source.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(rows, PARTS)


def has_entry(source: DataFrame, name: str) -> DataFrame:
    """doc_id, has_entry of packages (doc_id, content)."""
    rows = parts(source, with_bytes=False).groupBy("doc_id")
    return rows.agg(F.coalesce(F.max(F.col("error").isNull() & (F.col("part_name") == name)), F.lit(False)).alias("has_entry"))


def whole(parsed: DataFrame) -> DataFrame:
    """One row for each package, with all of its lookups."""
    return parsed.where("last")


def content_types(parsed: DataFrame) -> DataFrame:
    return whole(parsed).select("doc_id", F.inline("content_types"))


def _names_entry(name: str) -> Column:
    return F.coalesce(F.array_contains("entries", name), F.lit(False)).alias("has_entry")


def _names_part(part_name: str) -> Column:
    name = part_name.lstrip("/")
    return F.coalesce(F.exists("content_types", lambda x: (x["kind"] == "override") & (x["key"] == name)), F.lit(False)).alias("has_part")


def _default_type(extension: str) -> Column:
    found = F.filter("content_types", lambda x: (x["kind"] == "default") & (x["key"] == extension))
    return F.try_element_at(found, F.lit(-1))["content_type"].alias("content_type")


def _counts() -> list[Column]:
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return [(F.col("first").cast("int") + n("items")).alias("n_items"), *(n(c).alias(f"n_{c}") for c in ("styles", "nums", "notes", "rels", "part_items"))]


def described(parsed: DataFrame, entry: str, part_name: str, extension: str) -> DataFrame:
    """counts, has_entry, has_part and default_for_extension of each package at once, from one reading."""
    return whole(parsed).select("doc_id", *_counts(), _names_entry(entry), _names_part(part_name), _default_type(extension))


def has_part(parsed: DataFrame, part_name: str) -> DataFrame:
    """doc_id, has_part: whether the manifest names the part, given with or without a slash before it."""
    return whole(parsed).select("doc_id", _names_part(part_name))


def default_for_extension(parsed: DataFrame, extension: str) -> DataFrame:
    """doc_id, content_type that the manifest gives an extension, or null; of several the last."""
    return whole(parsed).select("doc_id", _default_type(extension))


def main_part(parsed: DataFrame) -> DataFrame:
    """The main document part of each package: the least name of its content type."""
    rows = content_types(parsed).where((F.col("kind") == "override") & (F.col("content_type") == ooxml.MAIN_TYPE))
    return rows.groupBy("doc_id").agg(F.min("key").alias("part_name"))


def relationships(parsed: DataFrame) -> DataFrame:
    return whole(parsed).select("doc_id", F.inline("rels"))


def relationship(parsed: DataFrame, rel_id: str) -> DataFrame:
    """The relationship of an id, of each package that has it."""
    return relationships(parsed).where(F.col("rel_id") == rel_id)


def relationships_of_type(parsed: DataFrame, part_of_type: str) -> DataFrame:
    """Relationships whose type contains a text."""
    return relationships(parsed).where(F.contains("rel_type", F.lit(part_of_type)))


def notes(parsed: DataFrame, kind: str | None = None) -> DataFrame:
    """Footnotes, endnotes and comments, or those of one kind."""
    rows = whole(parsed).select("doc_id", F.inline("notes"))
    return rows if kind is None else rows.where(F.col("note_kind") == kind)


def raw_body(parsed: DataFrame) -> DataFrame:
    """doc_id, item_ord and the raw items of the main part."""
    rows = parsed.select("doc_id", (F.col("begin") + F.col("first")).cast("int").alias("first"), F.posexplode("items").alias("k", "item"))
    return rows.select("doc_id", (F.col("first") + F.col("k")).alias("item_ord"), "item.*")


def style_table(parsed: DataFrame) -> DataFrame:
    return whole(parsed).select("doc_id", F.inline("styles"))


def numbering_defs(parsed: DataFrame) -> DataFrame:
    """Concrete numbers with the levels of the abstract ones they name: doc_id, num_id, ilvl, start, num_fmt, level_text."""

    def of(n):
        own = F.filter("levels", lambda x: x["abstract_num_id"] == n["abstract_num_id"])
        return F.transform(own, lambda x: F.struct(n["num_id"].alias("num_id"), *(x[c].alias(c) for c in ("ilvl", "start", "num_fmt", "level_text"))))

    return whole(parsed).select("doc_id", F.inline(F.flatten(F.transform("nums", of))))


def section_part(parsed: DataFrame, part_name: str) -> DataFrame:
    """doc_id, item_ord and the raw items of a header or footer part, of each package that has it."""
    found = F.get(F.filter("part_items", lambda p: p["part"] == part_name), F.lit(0))["items"]
    return whole(parsed).select("doc_id", F.posexplode(found).alias("item_ord", "item")).select("doc_id", "item_ord", "item.*")


def counts(parsed: DataFrame) -> DataFrame:
    """How many items, styles, numbers, notes, relationships and section parts each package has; 0 for those that failed."""
    return whole(parsed).select("doc_id", *_counts())


def errors(parsed: DataFrame) -> DataFrame:
    """doc_id, stage (open or elements), kind, part, detail of packages that failed."""
    rows = [whole(parsed).where(F.col(c).isNotNull()).select("doc_id", F.lit(s).alias("stage"), f"{c}.*") for c, s in (("open_error", "open"), ("element_error", "elements"))]
    return rows[0].union(rows[1])
