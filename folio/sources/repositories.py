"""Repository cards from a JSON snapshot; nothing is fetched while a query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.markdown import directives, repository
from folio.functions.text import compact_number, first_truthy, without_emoji_codes

SNAPSHOT = "full_name string, description string, language string, forks long, stargazers_count long, license struct<spdx_id: string>"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path)


def cards(posts: DataFrame, snapshot: DataFrame, doc: str = "slug", body: str = "body") -> DataFrame:
    """A row for each `::github{repo="owner/name"}` of the posts with what the snapshot knows; valid is false for other forms of repo."""
    asked = directives(posts, doc, body).where("kind = 'leaf' and name = 'github'").select("doc", F.try_element_at("attributes", F.lit("repo")).alias("repo"))
    asked = asked.withColumn("r", repository(F.col("repo")))
    found = asked.join(snapshot.dropDuplicates(["full_name"]), F.col("repo") == F.col("full_name"), "left")
    return found.select(
        "doc", "repo", "r.valid", "r.owner", F.col("r.name").alias("name"),
        first_truthy(without_emoji_codes(F.coalesce("description", F.lit(""))), "Description not set").alias("description"),
        "language", compact_number(F.col("forks")).alias("forks"), compact_number(F.col("stargazers_count")).alias("stars"),
        first_truthy(F.col("license.spdx_id"), "no-license").alias("license"),
    )
