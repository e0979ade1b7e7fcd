"""Chains of many styles, against the walk in a package's row and against a plain walk."""

import random

from pyspark.sql import functions as F

from vellum.functions.text import let
from vellum.operators import styles

TYPES = "doc_id string, style_id string, name string, based_on string, ppr struct<num_pr:struct<num_id:bigint,ilvl:int>,outline_level:int>, rpr struct<bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,font_size_half_points:bigint,color:string>"


def chain(doc, length, end):
    return [(doc, f"s{k}", f"s{k + 1}" if k + 1 < length else end) for k in range(length)]


def test_against_the_walk_in_a_row(spark):
    rng = random.Random(5)
    pairs = [(f"d{d}", f"s{k}", rng.choice([None, "none", *(f"s{j}" for j in range(30))])) for d in range(8) for k in range(30)]
    for n in (62, 63, 64, 65, 66, 80):
        for name, end in (("end", None), ("unknown", "?"), ("loop", "s0"), ("tail", "s9")):
            pairs += chain(f"{name}{n}", n, end)
    pairs += [(None, "s0", "s1"), (None, "s1", None)]
    maybe = lambda x: rng.choice([None, None, x])
    rows = [(d, s, f"n{s}", b, maybe((maybe((rng.randint(1, 3), 0)), maybe(rng.randint(0, 9)))), maybe((maybe(True), maybe(False), None, maybe(True), maybe(rng.randint(1, 40)), maybe(f"c{s}")))) for d, s, b in pairs]
    df = spark.createDataFrame(rows, TYPES)
    each = df.groupBy("doc_id").agg(F.collect_list(F.struct("style_id", "name", "based_on", "ppr", "rpr")).alias("styles"))
    one = let(styles.style_map(F.col("styles")), lambda m: F.transform("styles", lambda s: F.struct(s["style_id"].alias("style_id"), s["name"].alias("name"), styles.resolve_chain(m, s["style_id"]).alias("r"))))
    want = each.select("doc_id", F.inline(one)).select("doc_id", "style_id", "name", F.size("r.seen").alias("depth"), "r.error", "r.num_pr", "r.outline_level", "r.rpr")
    got = styles.resolve_styles(df)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    kinds = {x.error for x in got.collect()}
    assert kinds == {None, "circular_style", "style_chain_too_deep"}


def test_many_styles(spark):
    """A document of many styles: seconds, where a search of all of them at each step took hours."""
    n = 300_000
    rows = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("string").alias("style_id"), F.lit("x").alias("name"), F.when(F.col("id") > 0, F.floor(F.col("id") / 2).cast("string")).alias("based_on"), F.struct(F.lit(None).cast("struct<num_id:bigint,ilvl:int>").alias("num_pr"), F.when(F.col("id") % 5 == 0, F.col("id") % 10).cast("int").alias("outline_level")).alias("ppr"), F.lit(None).cast(TYPES.split(" rpr ")[1]).alias("rpr"))
    got = {x.style_id: x for x in styles.resolve_styles(rows).select("style_id", "depth", "outline_level").collect()}
    assert len(got) == n
    for k in range(0, n, 997):
        path = [k >> j for j in range(k.bit_length() + 1)] if k else [0]
        assert got[str(k)].depth == len(path) and got[str(k)].outline_level == next((x % 10 for x in path if x % 5 == 0), None)
