"""A folder of posts that is watched: the batch expressions on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.markdown import parsed, relative_name


def watch_posts(spark: SparkSession, path: str) -> DataFrame:
    """A stream of posts, a row for each new file; a file that is written anew under its name is not read again."""
    files = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return parsed(files.select(relative_name(path).alias("name"), "value"))


def running_tag_counts(stream: DataFrame) -> DataFrame:
    """(name, count) so far, for output modes complete and update. State: a number for each tag."""
    return stream.select(F.explode("tags").alias("name")).groupBy("name").agg(F.count("*").alias("count"))
