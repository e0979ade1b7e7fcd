"""Embedded images of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import image_type
from ..sources.package import parts


def images(packages: DataFrame, whole: bool = True) -> DataFrame:
    """doc_id, path, bytes, content_type, error of entries under word/media/, by path within each package.

    A package of which one image cannot be read has a row with the error in
    place of its images; without whole, only that image's row has an error.
    Packages that cannot be opened have a row with the error, too. Order the
    result by doc_id and path where a total order is wanted.
    """
    found = parts(packages, "^word/media/", whole=whole)
    return found.select("doc_id", F.col("part_name").alias("path"), "bytes", F.when(F.col("error").isNull(), image_type(F.col("bytes"))).alias("content_type"), "error")
