"""List counters, without a loop over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 9


def list_indexes(items: DataFrame, scope: list[str], order: list[str], levels: int = LEVELS) -> DataFrame:
    """Adds display_index to list items (scope, order, num_id, ilvl, start, list_type).

    A counter of a level starts anew when an item of a smaller level of the
    same number comes between: from the level's count so far goes what it was at
    the last such item, so that one order serves all levels. Bullets and none have
    no index. Levels are those of the format, 0 to 8; items beyond are few, and are
    collected to be counted.
    """
    level = F.col("ilvl")
    upto = Window.partitionBy(*scope, "num_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counts = F.array(*(F.sum((level == k).cast("int")).over(upto) for k in range(levels)))
    out = items.withColumn("_counts", counts).withColumn("_shallow", F.sum((level < levels).cast("int")).over(upto))
    before = F.array(*(F.max(F.when(level < k, F.get("_counts", F.lit(k)))).over(upto) for k in range(levels)))
    beyond = (level < 0) | (level >= levels)
    out = out.withColumn("_before", before).withColumn("_deep", F.collect_list(F.when(beyond, F.struct("ilvl", "_shallow"))).over(upto))

    def step(n: Column, x: Column) -> Column:
        anew = (x["ilvl"] < level) | ((level >= levels) & (x["_shallow"] != F.col("_shallow")))
        return F.when(anew, F.lit(0)).when(x["ilvl"] == level, n + 1).otherwise(n)

    number = F.when(beyond, F.aggregate("_deep", F.lit(0), step)).otherwise(F.get("_counts", level) - F.coalesce(F.get("_before", level), F.lit(0)))
    index = F.col("start") + number - 1
    return out.withColumn("display_index", F.when(~F.col("list_type").isin("bullet", "none"), index).cast("long")).drop("_counts", "_shallow", "_before", "_deep")


def level_formats(nums: DataFrame, levels: DataFrame) -> DataFrame:
    """doc_id, num_id, ilvl, start, num_fmt, level_text: concrete numbers joined with their abstract levels."""
    return nums.join(levels, ["doc_id", "abstract_num_id"]).select("doc_id", "num_id", "ilvl", "start", "num_fmt", "level_text")


def start_with_override(level: Column, overrides: Column, honor: bool) -> Column:
    """A level's start; with honor, the number's own startOverride before it."""
    if not honor:
        return level["start"]
    own = F.filter(overrides, lambda o: (o["ilvl"] == level["ilvl"]) & o["start_override"].isNotNull())
    return F.coalesce(F.get(own, F.lit(0))["start_override"], level["start"])
