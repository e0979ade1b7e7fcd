"""Dealing rows into partitions whose number grows with the source, so that a task's share does not."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of source files for each partition; only sources of less than half a partition are left to Spark, which merges by
#: the bytes shuffled: tables of short rows pack so well that a merged task would hold millions of them.
PART_BYTES = 8 << 20
_UNKNOWN = 1 << 56


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, as the planner knows them; 0 where it does not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(x for x in sizes if x < _UNKNOWN)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with rows of equal keys in one partition; larger sources are dealt into more partitions, which are not merged again."""
    size = source_bytes(df)
    if size <= PART_BYTES // 2:
        return df.repartition(*keys)
    return df.repartition(max(-(-size // PART_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
