"""Folders of page images as rows, in natural order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from komagrid.functions import text as t


def read_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content, name of the image files below a path."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(path).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    return files.where(t.is_image(F.col("name")))


def in_natural_order(files: DataFrame, column: str = "name") -> DataFrame:
    return files.orderBy(t.natural_key(F.col(column)), column)
