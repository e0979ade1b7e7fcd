"""Guards, the scan, streaming and random differential tests."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import chunks, lists, numbering
from vellum.sources import guards, ooxml, package, writer
from vellum.streaming.documents import package_stream, write_stream


def test_guards():
    guards.check_entry("a", guards.MAX_ENTRY_BYTES, 10**6, 0)
    for size, packed, total in ((guards.MAX_ENTRY_BYTES + 1, 10**8, 0), (10**6, 999, 0), (10**8, 10**7, 450 * 1024 * 1024)):
        with pytest.raises(guards.PackageError, match="zip_bomb"):
            guards.check_entry("a", size, packed, total)
    with pytest.raises(guards.PackageError, match="zip_entry_limit"):
        guards.check_count(10_001)
    for bad in ("/etc/x", "\\\\x", "a/../b", "..", "a\\..\\b"):
        with pytest.raises(guards.PackageError, match="zip_path_traversal"):
            guards.check_path(bad)
    for good in ("word/document.xml", "a..b/c", "...", "word/..x"):
        guards.check_path(good)
    with pytest.raises(guards.PackageError):
        guards.check_doctype("p", b" <!doctype x>")
    guards.check_doctype("p", b" " * 5000 + b"<!DOCTYPE x>")


def test_parts_of_the_manifest():
    types = ooxml.content_types("t", b'<Types><Default Extension="tiff" ContentType="image/tiff"/><Override PartName="/story/main.xml" ContentType="q"/><Override PartName="/no/type.xml"/></Types>')
    assert [x["key"] for x in types] == ["tiff", "story/main.xml"]
    rels = ooxml.relationships("r", b'<Relationships><Relationship Id="a" Type="t" Target="x" TargetMode="external"/><Relationship Id="b" Type="t"/></Relationships>')
    assert [(x["rel_id"], x["is_external"]) for x in rels] == [("a", True)]
    with pytest.raises(guards.PackageError, match="invalid_relationships"):
        ooxml.relationships("r", b"<a></b>")


def test_numbering_rules():
    data = f'<w:numbering xmlns:w="{writer.W}"><w:abstractNum w:abstractNumId="21"><w:lvl w:ilvl="2"><w:start w:val="14"/><w:numFmt w:val="upperLetter"/></w:lvl><w:lvl w:ilvl="2"><w:start w:val="70"/></w:lvl></w:abstractNum><w:num w:numId="8"><w:abstractNumId w:val="21"/></w:num><w:num w:numId="8"><w:abstractNumId w:val="34"/><w:lvlOverride w:ilvl="2"><w:startOverride w:val="19"/></w:lvlOverride></w:num></w:numbering>'
    nums, levels = ooxml.numbering("n", data.encode())
    assert [(x["start"], x["num_fmt"]) for x in levels] == [(14, "upperLetter")] and nums == [{"num_id": 8, "abstract_num_id": 34, "overrides": [{"ilvl": 2, "start_override": 19}]}]


def test_scan_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.docx").write_bytes(writer.of_stream([{"kind": "heading", "level": 1, "text": f"T{k}"}, {"kind": "paragraph", "level": None, "text": "body"}]))
    assert package.parts(package.packages(spark, str(folder))).where("part_name = 'word/document.xml' AND size > 0").count() == 3
    assert package.packages(spark, str(folder)).count() == 3
    query = write_stream(package_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(x.text for x in spark.read.parquet(str(tmp_path / "out")).collect()) == ["T0\n\nbody", "T1\n\nbody", "T2\n\nbody"]


def test_parts_list_and_main(spark):
    rows = spark.createDataFrame([("a", bytearray(writer.of_stream([])))], "doc_id string, content binary")
    assert [x.part_name for x in package.parts(rows, with_bytes=False).orderBy("part_name").collect()] == ["[Content_Types].xml", "word/document.xml", "word/numbering.xml", "word/styles.xml"]
    assert package.main_part(package.parse_packages(rows)).first().part_name == "word/document.xml"


def test_random_counters_nesting_and_chunks(spark):
    rng, rows = random.Random(3), []
    for d in range(30):
        for p in range(rng.randint(1, 40)):
            kind = rng.choice(["list_item", "list_item", "paragraph", "heading"])
            level = rng.randint(1, 9) if kind == "heading" else rng.randint(0, 8) if kind == "list_item" else None
            rows.append((f"d{d}", p, kind, "w " * rng.choice([0, 1, 3, 9]), level, rng.randint(1, 2)))
    df = spark.createDataFrame(rows, "doc_id string, pos int, kind string, text string, level int, num_id int").cache()
    items = df.where("kind = 'list_item'").select("doc_id", "pos", "num_id", F.col("level").alias("ilvl"), F.lit(3).alias("start"), F.lit("decimal").alias("list_type"))
    got = {(x.doc_id, x.pos): x.display_index for x in numbering.list_indexes(items, ["doc_id"], ["pos"]).collect()}
    parents = {(x.doc_id, x.pos): (x.parent_pos, x.depth) for x in lists.nested_lists(df.withColumn("list_type", F.lit("")).withColumn("display_index", F.lit(0))).collect()}
    none = "cast(null as {}) {}".format
    full = df.selectExpr("*", none("bigint", "note_id"), none("string", "author"), none("array<struct<cells:array<struct<text:string,col_span:int,row_span:int>>>>", "rows"))
    made = {}
    for x in chunks.rag_chunks(full, 10).orderBy("doc_id", "chunk_id").collect():
        made.setdefault(x.doc_id, []).append((x.paragraph_indices, [tuple(h) for h in x.heading_context], x.is_oversized))
    for d in range(30):
        own = [r for r in rows if r[0] == f"d{d}"]
        counters, stack, open_items = {}, [], []
        want, held, heads = [], [], []
        for _, p, kind, text, level, num in own:
            if kind == "list_item":
                counters = {k: v for k, v in counters.items() if not (k[0] == num and k[1] > level)}
                counters[num, level] = counters.get((num, level), 2) + 1
                assert got[f"d{d}", p] == counters[num, level]
                while open_items and open_items[-1][1] >= level:
                    open_items.pop()
                assert parents[f"d{d}", p] == (open_items[-1][0] if open_items else None, len(open_items))
                open_items.append((p, level))
            else:
                open_items = []
            n = (3 * len(text.split()) + 1) // 2
            if kind == "heading":
                if held:
                    want.append((held, list(heads), False))
                heads = [h for h in heads if h[0] < level] + [(level, text)]
                held = [p]
            elif n > 10:
                if held:
                    want.append((held, list(heads), False))
                want.append(([p], list(heads), True))
                held = []
            else:
                held = [*held, p]
        if held:
            want.append((held, list(heads), False))
        assert made[f"d{d}"] == want
