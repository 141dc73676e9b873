"""Lists of asset files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .markdown import relative_name


def read_assets(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(relative_name(path).alias("path"), "length")
