"""The shared folder of a session, tables written into it to cut lineage, and dealing of packed parts.

Flows of packed arrays are dealt by part number: partition k holds part k and
nothing else, so a task holds one part, whose size is bounded by the number of
parts, which grows with the input.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 32 << 20
_UNKNOWN = 1 << 56


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a single machine where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads do not recompute it, and survive lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Tables of one computation, which it drops as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self._spark, name)
        df.write.parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for x in tables:
            if id(x) in self._paths:
                drop(self._spark, self._paths.pop(id(x))[0])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, as the planner knows them; 0 where it does not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(x for x in sizes if x < _UNKNOWN)


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """How many parts to deal what is made of df into: the session's partitions, or more for larger sources."""
    return max(partitions(df.sparkSession), -(-source_bytes(df) // part_bytes))


def dealt(df: DataFrame, parts: int, part: str = "part") -> DataFrame:
    """df with rows of part k in partition k."""
    return df.repartitionById(parts, F.col(part).cast("int"))


Fold = Callable[[np.ndarray, np.ndarray], None]


def plus(total: np.ndarray, x: np.ndarray) -> None:
    total += x


def either(total: np.ndarray, x: np.ndarray) -> None:
    np.bitwise_or(total, x, out=total)


def _folded(kind: str, total_kind: str, fold: Fold):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, data in zip(batch["row"].to_pylist(), batch["data"], strict=True):
                x = np.frombuffer(data.as_buffer(), kind)
                if row in held:
                    fold(held[row], x)
                else:
                    held[row] = x.astype(total_kind)
        if held:
            yield pa.RecordBatch.from_pydict({"row": pa.array(held, pa.int32()), "data": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    return rows


ARRAY = "row int, data binary"


def as_rows(array: np.ndarray, width: int) -> pa.RecordBatch:
    """An array as rows (row, data) of width values each; rows of zeros are left out."""
    each = array.reshape(-1, width)
    keep = np.flatnonzero(each.any(axis=1))
    return pa.RecordBatch.from_pydict({"row": pa.array(keep, pa.int32()), "data": pa.array([each[k].tobytes() for k in keep], pa.binary())})


def total_of(rows: DataFrame, size: int, width: int, kind: str, total_kind: str, fold: Fold = plus) -> np.ndarray:
    """The sum of arrays of one fixed size that tasks give as rows (row, data).

    A task of the sum holds its rows' totals only and adds arrays as they
    come, however many tasks there were. The total, of fixed size, is returned.
    """
    count = size // width
    spread = min(count, max(partitions(rows.sparkSession), 1))
    folded = dealt(rows.withColumn("part", F.col("row") % spread), spread).select("row", "data").mapInArrow(_folded(kind, total_kind, fold), ARRAY)
    out = np.zeros((count, width), total_kind)
    for row, data in folded.collect():
        out[row] = np.frombuffer(data, total_kind)
    return out.reshape(-1)


def by_part(process: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]], columns: tuple[str, ...]):
    """For mapInArrow over dealt rows: process(part, its rows as tuples of the columns)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, *row in zip(*(batch[c].to_pylist() for c in ("part", *columns)), strict=True):
                held.setdefault(part, []).append(tuple(row))
        while held:
            yield from process(*held.popitem())

    return rows
