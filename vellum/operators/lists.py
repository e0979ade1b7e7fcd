"""Runs of list items as nested lists, in rows that name their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 9


def nested_lists(elements: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, list_id, pos, parent_pos, depth, text, level, list_type, display_index.

    Items that follow one another are a list; any other element ends it. An
    item's parent is the nearest one before it in its list with a smaller
    level: the latest of the last places of the smaller levels. Items beyond the
    format's levels are few, and are collected.
    """
    doc = Window.partitionBy("doc_id").orderBy("pos")
    rows = elements.withColumn("_others", F.sum((F.col("kind") != "list_item").cast("int")).over(doc)).where("kind = 'list_item'")
    run = Window.partitionBy("doc_id", "_others")
    rows = rows.withColumn("list_id", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_others")) - 1).cast("int"))
    before = run.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("pos"))).over(before) for k in range(levels)]
    deep = F.collect_list(F.when(F.col("level") >= levels, F.struct("level", (-F.col("pos")).alias("back")))).over(before)
    rows = rows.withColumn("_last", F.array(*last)).withColumn("_deep", deep)
    # by level, the last place of each first
    deeper = F.transform(F.array_sort(F.filter("_deep", lambda x: x["level"] < F.col("level"))), lambda x: -x["back"])
    smaller = F.concat(F.slice("_last", F.lit(1), F.least(F.col("level"), F.lit(levels))), deeper)
    parent = F.array_max(F.filter(smaller, lambda x: x.isNotNull()))
    rows = rows.withColumn("parent_pos", parent.cast("int"))
    # an item's ancestors are those smaller levels whose last place comes behind the last of every still smaller one
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"))
    chain = F.aggregate(smaller, start, lambda a, x: F.when(x > a["at"], F.struct((a["n"] + 1).alias("n"), x.cast("int").alias("at"))).otherwise(a), lambda a: a["n"])
    rows = rows.withColumn("depth", chain)
    return rows.select("doc_id", "list_id", "pos", "parent_pos", "depth", "text", "level", "list_type", "display_index")
