"""Tables: column positions, and rows that vertically merged cells span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def table_cells(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells (key, row, cell, grid_span, v_merge, text) with col_span and row_span; continuations are dropped.

    A cell's column is the sum of the spans before it in its row. In a column,
    each cell that does not continue another begins an island; one marked as a
    restart spans the continuations of its island. Both windows are within one
    table, so they run under one shuffle by its key.
    """
    in_row = Window.partitionBy(*key, "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    in_column = Window.partitionBy(*key, "_col").orderBy("row", "cell")
    island = Window.partitionBy(*key, "_col", "_island")
    goes_on = F.coalesce(F.col("v_merge") == "continue", F.lit(False))
    out = cells.withColumn("_col", F.coalesce(F.sum("grid_span").over(in_row), F.lit(0)))
    out = out.withColumn("_island", F.sum((~goes_on).cast("int")).over(in_column))
    more = F.sum(goes_on.cast("int")).over(island)
    out = out.withColumn("row_span", (1 + F.when(F.col("v_merge") == "restart", more).otherwise(0)).cast("int"))
    return out.where(~goes_on).select(*key, "row", "cell", "text", F.col("grid_span").alias("col_span"), "row_span")


def table_rows(cells: DataFrame, key: list[str]) -> DataFrame:
    """One row for each table: key, cells in order, ready for ``rows_of``."""
    spans = table_cells(cells, key)
    return spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", "cell", "text", "col_span", "row_span"))).alias("_cells"))


def rows_of(cells, count):
    """array<struct<cells>> of a table with count rows; rows whose cells all continue others are empty."""
    empty = F.array().cast("array<struct<row:int,cell:int,text:string,col_span:int,row_span:int>>")
    cell = lambda c: F.struct(*(c[x].alias(x) for x in ("text", "col_span", "row_span")))
    own = lambda r: F.transform(F.filter(F.coalesce(cells, empty), lambda c: c["row"] == r), cell)
    none = F.array().cast("array<struct<cells:array<struct<text:string,col_span:int,row_span:int>>>>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda r: F.struct(own(r).alias("cells")))).otherwise(none)
