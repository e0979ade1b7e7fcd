"""Partitions grow with the source."""

from pyspark.sql import functions as F

from vellum.plans import queries
from vellum.sources import dealing


def test_parts_follow_the_source(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(path)
    df = spark.read.parquet(path)
    size = dealing.source_bytes(df)
    assert size > 500_000 and dealing.source_bytes(spark.range(3)) < size
    monkeypatch.setattr(dealing, "PART_BYTES", size // 40)
    out = dealing.dealt(df, "id")
    assert out.rdd.getNumPartitions() >= 40 and out.count() == 20000
    assert dealing.dealt(df, "id").where("id = 7").select(F.spark_partition_id()).count() == 1


def test_tables_are_dealt_by_source(spark, monkeypatch):
    """All windows of a table's cells run within that one dealing."""
    monkeypatch.setattr(dealing, "PART_BYTES", 1 << 10)
    found = queries.table_spans(spark, "/root/testdata/sf0.001")
    want = -(-dealing.source_bytes(found) // dealing.PART_BYTES)
    assert found.rdd.getNumPartitions() == want > 4
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_elements_are_dealt_by_source(spark, monkeypatch):
    """Packages are written, and elements of them found, in partitions that grow with the source."""
    monkeypatch.setattr(dealing, "PART_BYTES", 1 << 10)
    found = queries.docx_roundtrip_chunks(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    want = -(-dealing.source_bytes(found) // dealing.PART_BYTES)
    assert want > 4 and plan.count("RepartitionByExpression [doc_id#") == 2 and plan.count(f"], {want}") == 2, plan


def test_elements_and_chunks_share_sorts(spark):
    """A task's memory is that of its sorts: one packs, one counts lists, one places elements, one cuts chunks; fragments count without another."""
    sorts = lambda found: found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count(" Sort [")
    assert sorts(queries.docx_roundtrip_elements(spark, "/root/testdata/sf0.001")) == 3
    assert sorts(queries.docx_roundtrip_chunks(spark, "/root/testdata/sf0.001")) == 4
    assert sorts(queries.rag_chunks_small(spark, "/root/testdata/sf0.001")) == 1  # list indexes are not asked for


def test_short_rows_are_not_merged(spark, tmp_path, monkeypatch):
    """A source of less than a partition, whose many rows take few bytes, keeps Spark's number of partitions."""
    path = str(tmp_path / "t")
    spark.range(20000).select(F.lit("a").alias("x"), "id").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    monkeypatch.setattr(dealing, "PART_BYTES", dealing.source_bytes(df) + 1)
    assert dealing.dealt(df, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    monkeypatch.setattr(dealing, "PART_BYTES", 3 * dealing.source_bytes(df))
    assert dealing.dealt(df, "id").rdd.getNumPartitions() == 1
