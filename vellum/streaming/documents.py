"""Packages as they arrive: the batch operators over micro-batches of files.

Parsing knows one package at a time, so a stream of files needs no state: each
micro-batch runs the whole pipeline for its packages and is written once, under
its batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.chunks import rag_chunks
from ..operators.elements import elements
from ..sources.package import parse_packages

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def package_stream(spark: SparkSession, path: str, glob: str = "*.docx", max_files: int | None = None) -> DataFrame:
    """doc_id, path, modification_time, length, content of packages that come to stand under a path."""
    source = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    return source.load(path).select(F.col("path").alias("doc_id"), "path", F.col("modificationTime").alias("modification_time"), "length", "content")


def chunk_batch(parsed: DataFrame) -> DataFrame:
    return rag_chunks(elements(parsed))


def write_stream(packages: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = chunk_batch) -> DataStreamWriter:
    """A writer that appends transform's rows of parsed packages; a batch that is tried again replaces what it wrote."""

    def each(batch: DataFrame, batch_id: int) -> None:
        transform(parse_packages(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return packages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
