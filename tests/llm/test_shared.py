"""The shared folder, dealt parts, and sums of arrays."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import shared


def test_folder_must_be_named_on_a_cluster():
    unset = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    with pytest.raises(RuntimeError):
        shared.folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert shared.folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file://")


def test_dealt(spark):
    rows = shared.dealt(spark.range(70).select((F.col("id") % 7).alias("part"), "id"), 7).withColumn("at", F.spark_partition_id())
    assert all(r.part == r.at for r in rows.collect())
    seen = {r.k: r.n for r in shared.dealt(rows, 7).mapInArrow(shared.by_part(lambda k, x: iter([pa.RecordBatch.from_pydict({"k": [k], "n": [len(x)]})]), ("id",)), "k long, n long").collect()}
    assert seen == dict.fromkeys(range(7), 10)


def test_parts_grow_with_the_source(spark, tmp_path):
    spark.range(50_000).repartition(1).write.parquet(f"file://{tmp_path}/t")
    table = spark.read.parquet(f"file://{tmp_path}/t").select("id")
    size = shared.source_bytes(table)
    assert size > 100_000 and shared.parts_for(table, 10_000) == -(-size // 10_000) and shared.parts_for(table) == shared.partitions(spark)
    assert shared.parts_for(spark.createDataFrame([(1,)], "id long")) == shared.partitions(spark)


@pytest.mark.parametrize("fold", [shared.plus, shared.either])
def test_total_of(spark, fold):
    def rows(batches):
        for batch in batches:
            for k in batch["id"].to_pylist():
                x = np.zeros(24, np.uint32)
                x[k % 24] = k
                yield shared.as_rows(x, 8)

    got = shared.total_of(spark.range(100).repartition(5).mapInArrow(rows, shared.ARRAY), 24, 8, "u4", "i8", fold)
    want = [[k for k in range(100) if k % 24 == j] for j in range(24)]
    assert got.tolist() == [sum(x) if fold is shared.plus else int(np.bitwise_or.reduce(x)) for x in want]


def test_tables_are_dropped(spark):
    own = shared.Tables(spark)
    kept, gone = own.written(spark.range(3).toDF("a"), "kept"), own.written(spark.range(3).toDF("a"), "gone")
    path = gone.inputFiles()[0]
    own.drop(gone, gone)
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|FileNotFound"):
        spark.read.parquet(path).count()
